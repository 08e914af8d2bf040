"""larkspur: a relational analytics engine on Apache Spark."""
