"""Versioned tables: inserts, updates, deletes, constraints, views, transactions, persistence.

A table is a list of DataFrames, one a version; each statement makes a new one from the last, so older versions stay readable
and rolling back is going back to the catalog as it was. Statements are logical rewrites; nothing runs until a result is asked
for, other than constraint checks, which ask whether a violation exists.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import ordering


class ConstraintError(ValueError):
    """A statement would break a constraint."""


class SerializationError(ValueError):
    """A transaction met a change of another one that its isolation level forbids."""


@dataclass
class ForeignKey:
    """Actions: restrict, cascade, set null, set default."""

    columns: list[str]
    table: str
    references: list[str]
    on_delete: str = "restrict"
    on_update: str = "restrict"


@dataclass
class Schema:
    """Constraints and defaults of a table."""

    primary_key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)
    serial: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)
    triggers: dict[str, dict] = field(default_factory=dict)


# Violations, each a DataFrame of offending rows ------------------------------------------------------------------------------


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.where(bad)


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a null never clash."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def key_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Primary key: duplicates, and keys with a null."""
    nulls = null_violations(df, columns).groupBy(*columns).agg(F.count("*").alias("n"))
    return duplicate_keys(df, columns).unionByName(nulls)


def orphans(df: DataFrame, columns: list[str], parent: DataFrame, references: list[str]) -> DataFrame:
    """Rows whose key is not among the parent's; a null in the key passes."""
    known = parent.select(*[F.col(r).alias(f"_ref{i}") for i, r in enumerate(references)]).distinct()
    on = [F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(columns)]
    return df.dropna(subset=columns).join(known, on, "left_anti")


def check_violations(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which the condition is false; unknown passes."""
    return df.where(f"NOT coalesce(({condition}), true)")


# Statements as rewrites ------------------------------------------------------------------------------------------------------


def update(df: DataFrame, assignments: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
    """All right-hand sides read the old row; unknown conditions leave a row as it is."""
    condition = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    new = {c: F.expr(v) if isinstance(v, str) else v for c, v in assignments.items()}
    kinds = dict(df.dtypes)
    return df.select(*[F.when(condition, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column | str | None = None) -> DataFrame:
    if where is None:
        return df.limit(0)
    condition = F.expr(where) if isinstance(where, str) else where
    return df.where(~F.coalesce(condition, F.lit(False)))


def completed(new: DataFrame, like: DataFrame, schema: Schema, start: int = 0) -> DataFrame:
    """New rows with the table's columns: defaults for missing ones, the next numbers for the serial one."""
    out = new
    for c, kind in like.dtypes:
        if c not in new.columns:
            out = out.withColumn(c, F.expr(schema.defaults[c]).cast(kind) if c in schema.defaults else F.lit(None).cast(kind))
    if schema.serial:
        rows = out.where(F.col(schema.serial).isNull()).drop(schema.serial)
        numbered = ordering.numbered(rows, [F.col(c).asc_nulls_last() for c in rows.columns], schema.serial)
        out = out.where(F.col(schema.serial).isNotNull()).unionByName(numbered.withColumn(schema.serial, F.col(schema.serial) + start))
    return out.select(*[F.col(c).cast(k).alias(c) for c, k in like.dtypes])


def matching(child: DataFrame, columns: list[str], keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of the child whose key is among ``keys`` (or, left_anti, is not); a key with a null matches nothing."""
    named = keys.toDF(*[f"_ref{i}" for i in range(len(columns))])
    return child.join(named, [F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(columns)], how)


Query = str | Callable[[], DataFrame]


class Database:
    """Tables, views, types, prepared statements and transactions of one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.versions: dict[str, list[DataFrame]] = {}
        self.schemas: dict[str, Schema] = {}
        self.views: dict[str, Query] = {}
        self.materialized: dict[str, tuple[Query, str]] = {}
        self.types: dict[str, list] = {}
        self.prepared: dict[str, str] = {}
        self.savepoints: list[tuple[str | None, dict]] = []

    # tables

    def create_table(self, name: str, rows: DataFrame, schema: Schema | None = None, if_not_exists: bool = False) -> None:
        if name in self.versions:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        self.versions[name], self.schemas[name] = [rows], schema or Schema()
        try:
            self._validate(name, rows)
        except ConstraintError:
            self.drop_table(name)
            raise

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if self.versions.pop(name, None) is None and not if_exists:
            raise KeyError(name)
        self.schemas.pop(name, None)

    def table(self, name: str) -> DataFrame:
        """Current version of a table, a view expanded anew, or the stored rows of a materialized view."""
        if name in self.views:
            return self._run(self.views[name])
        if name in self.materialized:
            return self.spark.read.parquet(self.materialized[name][1])
        return self.versions[name][-1]

    def describe(self, name: str) -> list[tuple[str, str]]:
        return self.table(name).dtypes

    def described(self, name: str) -> DataFrame:
        """``describe`` as rows: place, column_name, data_type."""
        rows = [(i, c, t) for i, (c, t) in enumerate(self.describe(name), 1)]
        return self.spark.createDataFrame(rows, "place int, column_name string, data_type string")

    def save(self, name: str, path: str) -> None:
        """Write the current version with the table's options (such as compression)."""
        self.table(name).write.mode("overwrite").options(**self.schemas[name].options).parquet(path)

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """A query in which {name} stands for a table or view."""
        names = {n: self.table(n) for n in (*self.versions, *self.views, *self.materialized) if "{" + n + "}" in text}
        return self.spark.sql(text, args=args, **names)

    def _run(self, query: Query) -> DataFrame:
        return self.sql(query) if isinstance(query, str) else query()

    # ALTER TABLE

    def alter_table(
        self, name: str, *, add: dict[str, tuple[str, str | None]] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, types: dict[str, str] | None = None,
        defaults: dict[str, str | None] | None = None, options: dict[str, str] | None = None, constraints: Schema | None = None, to: str | None = None,
    ) -> None:
        """Add columns (type, default), drop, rename or cast them, set or drop defaults, set options, add constraints, rename the table.

        Constraints that name a dropped column go with it; those on a renamed column follow it, in other tables too. Existing rows
        must meet added constraints.
        """
        df, s = self.table(name), copy.deepcopy(self.schemas[name])
        for c, (kind, default) in (add or {}).items():
            if c in df.columns:
                raise ValueError(f"{name} has a column {c}")
            df = df.withColumn(c, F.expr(default or "null").cast(kind))
            if default:
                s.defaults[c] = default
        for c in drop or []:
            df = df.drop(c)
            s.primary_key = [] if c in s.primary_key else s.primary_key
            s.not_null, s.unique = [x for x in s.not_null if x != c], [u for u in s.unique if c not in u]
            s.foreign_keys = [k for k in s.foreign_keys if c not in k.columns]
            s.indexes = {n: i for n, i in s.indexes.items() if c not in i["columns"]}
            s.defaults.pop(c, None)
            s.serial = None if s.serial == c else s.serial
        for old, new in (rename or {}).items():
            df = df.withColumnRenamed(old, new)
            other = lambda x, old=old, new=new: [new if y == old else y for y in x]
            s.primary_key, s.not_null, s.unique = other(s.primary_key), other(s.not_null), [other(u) for u in s.unique]
            for k in s.foreign_keys:
                k.columns = other(k.columns)
            for i in s.indexes.values():
                i["columns"] = other(i["columns"])
            if old in s.defaults:
                s.defaults[new] = s.defaults.pop(old)
            s.serial = new if s.serial == old else s.serial
            for child in self.schemas.values():
                for k in child.foreign_keys:
                    if k.table == name:
                        k.references = other(k.references)
        for c, kind in (types or {}).items():
            df = df.withColumn(c, F.col(c).cast(kind))
        for c, default in (defaults or {}).items():
            if default is None:
                s.defaults.pop(c, None)
            else:
                s.defaults[c] = default
        s.options |= options or {}
        if constraints:
            s.primary_key = constraints.primary_key or s.primary_key
            s.not_null, s.unique, s.checks, s.foreign_keys = s.not_null + constraints.not_null, s.unique + constraints.unique, s.checks + constraints.checks, s.foreign_keys + constraints.foreign_keys
        self._validate(name, df, s)
        self.versions[name].append(df)
        self.schemas[name] = s
        if to:
            self.versions[to], self.schemas[to] = self.versions.pop(name), self.schemas.pop(name)
            for child in self.schemas.values():
                for k in child.foreign_keys:
                    k.table = to if k.table == name else k.table

    # statements

    def insert(self, name: str, rows: DataFrame, validate: bool = True) -> DataFrame:
        """Append rows; all constraints are checked, for batches too."""
        old, schema = self.table(name), self.schemas[name]
        start = 0
        if schema.serial:
            start = old.agg(F.coalesce(F.max(schema.serial), F.lit(0))).first()[0]
        new = completed(rows, old, schema, int(start))
        out = old.unionByName(new)
        if validate:
            self._validate(name, out, new=new)
        self.versions[name].append(out)
        return out

    def update(self, name: str, assignments: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
        """New version of the table; rows of other tables that refer to changed keys are refused or follow, by their ``on_update``."""
        old = self.table(name)
        out = update(old, assignments, where)
        staged = {name: out}
        changed = {tuple(k.references) for s in self.schemas.values() for k in s.foreign_keys if k.table == name and set(k.references) & set(assignments)}
        for references in changed:
            before = [F.col(r).alias(f"_old{i}") for i, r in enumerate(references)]
            both = update(old.select("*", *before), assignments, where).select(*[f"_old{i}" for i in range(len(references))], *references).distinct()
            moved = both.where(" OR ".join(f"NOT (_old{i} <=> `{r}`)" for i, r in enumerate(references)))
            self._follow(name, list(references), moved.select(*[f"_old{i}" for i in range(len(references))]), moved, staged)
        return self._apply(name, staged)

    def delete(self, name: str, where: Column | str | None = None) -> DataFrame:
        """Rows go; rows of other tables that refer to them are refused or go as well, by their ``on_delete``, through all levels."""
        staged = {name: delete(self.table(name), where)}
        for references in {tuple(k.references) for s in self.schemas.values() for k in s.foreign_keys if k.table == name}:
            self._follow(name, list(references), self._gone(self.table(name), staged[name], list(references)), None, staged)
        return self._apply(name, staged)

    def _gone(self, old: DataFrame, new: DataFrame, references: list[str]) -> DataFrame:
        """Keys of the old rows that the new ones lack."""
        return matching(old.select(*references).dropna().distinct(), references, new.select(*references).dropna().distinct(), "left_anti")

    def _follow(self, parent: str, references: list[str], gone: DataFrame, moved: DataFrame | None, staged: dict[str, DataFrame]) -> None:
        """Apply the actions of the tables that refer to keys that are gone from ``parent`` (or moved, with the new keys)."""
        for child, schema in list(self.schemas.items()):
            for key in schema.foreign_keys:
                if key.table != parent or key.references != references:
                    continue
                now = staged.get(child, self.versions[child][-1])
                if matching(now, key.columns, gone).isEmpty():
                    continue
                action = key.on_delete if moved is None else key.on_update
                if action == "restrict":
                    raise ConstraintError(f"{child} refers to rows of {parent} that would go")
                if action == "cascade" and moved is None:
                    new = matching(now, key.columns, gone, "left_anti")
                else:
                    n = range(len(key.columns))
                    if moved is not None and action == "cascade":
                        marked = moved.toDF(*[f"_ref{i}" for i in n], *[f"_new{i}" for i in n])
                        values = [F.col(f"_new{i}") for i in n]
                    else:
                        marked = gone.toDF(*[f"_ref{i}" for i in n])
                        values = [F.expr(schema.defaults.get(c, "null") if action == "set default" else "null") for c in key.columns]
                    kinds = dict(now.dtypes)
                    met = now.join(marked.withColumn("_hit", F.lit(True)), [F.col(c) == F.col(f"_ref{i}") for i, c in enumerate(key.columns)], "left")
                    set_ = dict(zip(key.columns, values, strict=True))
                    new = met.select(*[F.when(F.col("_hit"), set_[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in now.columns])
                staged[child] = new
                for below in {tuple(k.references) for s in self.schemas.values() for k in s.foreign_keys if k.table == child}:
                    if moved is None and action == "cascade" or set(below) & set(key.columns):
                        self._follow(child, list(below), self._gone(now, new, list(below)), None, staged)

    def _apply(self, name: str, staged: dict[str, DataFrame]) -> DataFrame:
        """Check every changed table, then make all of them current."""
        for table, df in staged.items():
            self._validate(table, df, staged=staged)
        for table, df in staged.items():
            self.versions[table].append(df)
        return staged[name]

    def _validate(self, name: str, df: DataFrame, schema: Schema | None = None, new: DataFrame | None = None, staged: dict[str, DataFrame] | None = None) -> None:
        """Refuse rows that break a constraint; with ``new``, only these are looked at where old rows cannot matter."""
        s, rows = schema or self.schemas[name], df if new is None else new
        parent = lambda t: df if t == name else (staged or {}).get(t, None) if t in (staged or {}) else self.table(t)
        found: list[tuple[str, DataFrame]] = [("not null", null_violations(rows, s.not_null))] if s.not_null else []
        if s.primary_key:
            found.append(("primary key", key_violations(df, s.primary_key)))
        found += [(f"unique {u}", duplicate_keys(df, u)) for u in s.unique]
        found += [(f"check {c}", check_violations(rows, c)) for c in s.checks]
        found += [(f"foreign key {k.columns}", orphans(rows, k.columns, parent(k.table), k.references)) for k in s.foreign_keys]
        for what, bad in found:
            if not bad.isEmpty():
                raise ConstraintError(f"{name}: {what}")

    # transactions

    _STATE = ("versions", "schemas", "views", "materialized", "types", "prepared")

    def _state(self) -> dict:
        """All definitions and current versions; DataFrames are immutable, so they are shared."""
        return {"versions": {n: list(v) for n, v in self.versions.items()}, **{k: copy.deepcopy(getattr(self, k)) if k == "schemas" else {n: list(v) if isinstance(v, list) else v for n, v in getattr(self, k).items()} for k in self._STATE[1:]}}

    def _restore(self, state: dict) -> None:
        for k, v in Database._copied(state).items():
            setattr(self, k, v)

    @staticmethod
    def _copied(state: dict) -> dict:
        return {k: copy.deepcopy(v) if k == "schemas" else {n: list(x) if isinstance(x, list) else x for n, x in v.items()} for k, v in state.items()}

    def begin(self, isolation: str = "read committed") -> Transaction:
        """A transaction beside others on this database."""
        return Transaction(self, isolation)

    def savepoint(self, label: str) -> None:
        self.savepoints.append((label, self._state()))

    def rollback(self, label: str | None = None) -> None:
        """To a savepoint, or to the oldest one (the beginning): rows, and tables, views and types made, changed or dropped since."""
        at = 0 if label is None else max(i for i, (x, _) in enumerate(self.savepoints) if x == label)
        self._restore(self.savepoints[at][1])
        del self.savepoints[at + (label is not None) :]

    def release(self, label: str) -> None:
        """Forget a savepoint and those after it; their changes stay."""
        at = max(i for i, (x, _) in enumerate(self.savepoints) if x == label)
        del self.savepoints[at:]

    def commit(self) -> None:
        self.savepoints.clear()

    # persistence

    def save_all(self, path: str) -> None:
        """Write every table and the definitions; views must be SQL text, as functions cannot be written."""
        for n, q in (*self.views.items(), *((n, q) for n, (q, _) in self.materialized.items())):
            if not isinstance(q, str):
                raise ValueError(f"view {n} is no SQL text")
        for n in self.versions:
            self.save(n, f"{path}/tables/{n}")
        text = json.dumps({"tables": {n: asdict(s) for n, s in self.schemas.items()}, "views": self.views, "materialized": self.materialized, "types": self.types, "prepared": self.prepared})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/catalog")

    @staticmethod
    def load_all(spark: SparkSession, path: str) -> Database:
        db = Database(spark)
        found = json.loads(spark.read.text(f"{path}/catalog", wholetext=True).first()[0])
        for n, s in found["tables"].items():
            db.versions[n] = [spark.read.parquet(f"{path}/tables/{n}")]
            db.schemas[n] = Schema(**{**s, "foreign_keys": [ForeignKey(**k) for k in s["foreign_keys"]]})
        db.views, db.prepared = found["views"], found["prepared"]
        db.materialized = {n: (q, p) for n, (q, p) in found["materialized"].items()}
        db.types = {n: [tuple(x) if isinstance(x, list) else x for x in v] for n, v in found["types"].items()}
        return db

    # views, types, prepared statements, metadata

    def create_view(self, name: str, query: Query) -> None:
        """SQL text with tables in braces, or a function."""
        self.views[name] = query

    def drop_view(self, name: str, if_exists: bool = False) -> None:
        if self.views.pop(name, None) is None and not if_exists:
            raise KeyError(name)

    def create_materialized_view(self, name: str, query: Query, path: str) -> None:
        self.materialized[name] = (query, path)
        self.refresh(name)

    def refresh(self, name: str) -> None:
        query, path = self.materialized[name]
        self._run(query).write.mode("overwrite").parquet(path)

    def drop_materialized_view(self, name: str, if_exists: bool = False) -> None:
        """The definition goes, and the stored rows with it."""
        found = self.materialized.pop(name, None)
        if found is None:
            if not if_exists:
                raise KeyError(name)
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def create_enum(self, name: str, labels: list[str]) -> None:
        if len(set(labels)) < len(labels):
            raise ValueError("labels must differ")
        self.types[name] = list(labels)

    def add_enum_value(self, name: str, label: str, before: str | None = None, after: str | None = None) -> None:
        labels = self.types[name]
        if label in labels:
            raise ValueError(f"{label} exists")
        labels.insert(labels.index(before) if before else labels.index(after) + 1 if after else len(labels), label)

    def create_composite(self, name: str, fields: list[tuple[str, str]]) -> None:
        self.types[name] = list(fields)

    def drop_type(self, name: str) -> None:
        del self.types[name]

    def prepare(self, name: str, text: str) -> None:
        """Store a statement with markers :name or ?."""
        self.prepared[name] = text

    def execute(self, name: str, args: dict | list | None = None) -> DataFrame:
        return self.sql(self.prepared[name], args)

    def deallocate(self, name: str) -> None:
        del self.prepared[name]

    def create_index(self, table: str, name: str, columns: list[str], unique: bool = False, where: str | None = None, method: str = "btree") -> None:
        """Metadata, which ``save_indexed`` turns into data skipping; a unique index is enforced as a constraint."""
        self.schemas[table].indexes[name] = {"columns": columns, "unique": unique, "where": where, "method": method}
        if unique:
            self.schemas[table].unique.append(columns)
            self._validate(table, self.table(table))

    def drop_index(self, table: str, name: str, if_exists: bool = False) -> None:
        """The constraint of a unique index goes with it."""
        found = self.schemas[table].indexes.pop(name, None)
        if found is None and not if_exists:
            raise KeyError(name)
        if found and found["unique"]:
            self.schemas[table].unique.remove(found["columns"])

    def save_indexed(self, name: str, path: str, partitions: int | None = None) -> None:
        """Write a table so that scans skip what its indexes would: ordered by the first ordered index, Bloom filters for hash ones."""
        from larkspur.sources import skipping

        indexes = list(self.schemas[name].indexes.values())
        order = next((i["columns"] for i in indexes if i["method"] in ("btree", "brin")), [])
        skipping.write_clustered(self.table(name), path, order, [c for i in indexes if i["method"] == "hash" for c in i["columns"]], partitions, **self.schemas[name].options)

    def create_trigger(self, table: str, name: str, **what: str) -> None:
        """Metadata only."""
        self.schemas[table].triggers[name] = what

    def drop_trigger(self, table: str, name: str) -> None:
        del self.schemas[table].triggers[name]


class Transaction:
    """Statements on a state of its own, made current on commit.

    read committed: tables that it has not written are read as they are now. repeatable read: as they were at the beginning.
    serializable: as that, and a commit fails if a table that it read has changed. A commit fails if a table that it wrote has
    been changed by another since it first wrote it (read committed) or since it began.
    """

    LEVELS = ("read committed", "repeatable read", "serializable")

    def __init__(self, db: Database, isolation: str):
        if isolation not in self.LEVELS:
            raise ValueError(f"no isolation level {isolation}")
        self.db, self.isolation = db, isolation
        self.own = Database(db.spark)
        self.own._restore(db._state())
        self.seen = {n: v[-1] for n, v in db.versions.items()}
        self.read: set[str] = set()
        self.written: set[str] = set()
        self.is_open = True

    def _step(self) -> Database:
        if not self.is_open:
            raise ValueError("the transaction has ended")
        if self.isolation == "read committed":
            for n, v in self.db.versions.items():
                if n not in self.written:
                    self.own.versions[n], self.seen[n] = list(v), v[-1]
        return self.own

    def _changed(self, run: Callable[[Database], DataFrame]) -> DataFrame:
        own = self._step()
        before = {n: v[-1] for n, v in own.versions.items()}
        out = run(own)
        self.written |= {n for n, v in own.versions.items() if before.get(n) is not v[-1]}
        return out

    def table(self, name: str) -> DataFrame:
        self.read.add(name)
        return self._step().table(name)

    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        self.read |= {n for n in self.db.versions if "{" + n + "}" in text}
        return self._step().sql(text, args)

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        return self._changed(lambda own: own.insert(name, rows))

    def update(self, name: str, assignments: dict[str, Column | str], where: Column | str | None = None) -> DataFrame:
        return self._changed(lambda own: own.update(name, assignments, where))

    def delete(self, name: str, where: Column | str | None = None) -> DataFrame:
        return self._changed(lambda own: own.delete(name, where))

    def commit(self) -> None:
        if not self.is_open:
            raise ValueError("the transaction has ended")
        self.is_open = False
        watched = self.written | (self.read if self.isolation == "serializable" else set())
        for n in sorted(watched & set(self.seen)):
            if n not in self.db.versions or self.db.versions[n][-1] is not self.seen[n]:
                raise SerializationError(f"{n} was changed by another transaction")
        for n in self.written:
            self.db.versions[n].append(self.own.versions[n][-1])

    def rollback(self) -> None:
        self.is_open = False
