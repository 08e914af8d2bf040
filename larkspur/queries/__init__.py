"""Named queries by group."""
