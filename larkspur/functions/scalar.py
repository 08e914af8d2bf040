"""Scalar functions whose semantics differ from Spark's own, as Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Strings ---------------------------------------------------------------------------------------------------------------------


def concat(*parts: Column) -> Column:
    """Skips nulls."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start before 1 counts as 1, a negative length as 0."""
    start = F.greatest(start if isinstance(start, Column) else F.lit(start), F.lit(1))
    if length is None:
        return F.substring(s, start, F.length(s))
    return F.substring(s, start, F.greatest(length if isinstance(length, Column) else F.lit(length), F.lit(0)))


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def trim(s: Column) -> Column:
    """All white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def split_part(s: Column, separator: str, n: int) -> Column:
    """1-based; empty where there is no such part."""
    return F.split_part(s, F.lit(separator), F.lit(n))


# Numbers ---------------------------------------------------------------------------------------------------------------------


def int_div(a: str, b: str) -> Column:
    """Integer division, cut towards zero."""
    return F.expr(f"({a}) div ({b})")


def int_sqrt(x: Column) -> Column:
    """Greatest whole number whose square is not above x; a negative x is an error."""
    x = x.cast("long")
    near = F.floor(F.sqrt(x)).cast("long")  # a double may be one off either way beyond 2^53
    square = lambda r: r.cast("decimal(20,0)") * r.cast("decimal(20,0)")
    root = F.when(square(near) > x, near - 1).when(square(near + 1) <= x, near + 1).otherwise(near)
    return F.when(x < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(root)


def int_power(x: Column, n: Column | int) -> Column:
    """x to the n-th by repeated squaring on whole numbers; a negative n, or a result beyond 64 bits, is an error."""
    x, n = x.cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long")
    # state: result, square, what is left of the exponent; the square is not made where no bit is left to use it
    start = F.struct(F.lit(1).cast("long").alias("r"), x.alias("s"), n.alias("n"))

    def step(a: Column, _: Column) -> Column:
        odd, more = a["n"] % 2 == 1, a["n"] > 1
        return F.struct(F.when(odd, a["r"] * a["s"]).otherwise(a["r"]).alias("r"), F.when(more & ~a["s"].isin(0, 1, -1), a["s"] * a["s"]).when(a["s"] == -1, F.lit(1).cast("long")).otherwise(a["s"]).alias("s"), F.shiftright(a["n"], 1).alias("n"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step)["r"]
    return F.when(n < 0, F.raise_error(F.lit("negative exponent"))).when(x.isNull() | n.isNull(), F.lit(None).cast("long")).otherwise(got)


def random_int(below: int = 1000) -> Column:
    return F.floor(F.rand() * below).cast("long")


# Dates -----------------------------------------------------------------------------------------------------------------------


def epoch_seconds() -> Column:
    return F.unix_timestamp()


def epoch_days() -> Column:
    return F.datediff(F.current_date(), F.lit("1970-01-01").cast("date")).cast("long")


def extract(field: str, ts: str) -> Column:
    """epoch, year, month, day, hour, minute or second as a whole number."""
    if field.lower() == "epoch":
        return F.expr(f"cast(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) as bigint)")
    return F.expr(f"cast(floor(extract({field} FROM {ts})) as bigint)")


def date_trunc(field: str, ts: str) -> Column:
    """Keeps a time stamp without zone as one."""
    return F.date_trunc(field, F.col(ts)).cast("timestamp_ntz")


# Arrays ----------------------------------------------------------------------------------------------------------------------


def array_contains_all(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


def array_contained_by(a: Column, b: Column) -> Column:
    """a <@ b."""
    return array_contains_all(b, a)


def array_overlaps(a: Column, b: Column) -> Column:
    """a && b."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def array_element(a: Column, i: Column | int) -> Column:
    """1-based; past the end null; an index below 1 is an error."""
    i = i if isinstance(i, Column) else F.lit(i)
    return F.when(i < 1, F.raise_error(F.lit("array index must be at least 1"))).otherwise(F.try_element_at(a, i))


def array_position(a: Column, x: Column) -> Column:
    """1-based; null if missing."""
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


# JSON ------------------------------------------------------------------------------------------------------------------------


def json_path(path: str) -> str:
    """``{a,b,0}``, ``{a.b.[0]}`` or ``["a","b"]`` as a Spark path."""
    inner = path.strip()[1:-1]
    parts = [p.strip().strip('"').strip("[]") for p in (inner.split(",") if "," in inner or path.startswith("[") else inner.split("."))]
    return "$" + "".join(f"[{p}]" if p.lstrip("-").isdigit() else f"['{p}']" for p in parts if p)


def _key(k: str | int) -> str:
    return f"$[{k}]" if isinstance(k, int) else f"$['{k}']"


def json_text(j: Column, key: str | int) -> Column:
    """j ->> key."""
    return F.get_json_object(j, _key(key))


def json_value(j: Column, key: str | int) -> Column:
    """j -> key: JSON text, so strings keep their quotes."""
    return _quoted(j, _key(key))


def json_text_at(j: Column, path: str) -> Column:
    """j #>> path."""
    return F.get_json_object(j, json_path(path))


def json_value_at(j: Column, path: str) -> Column:
    """j #> path."""
    return _quoted(j, json_path(path))


def _quoted(j: Column, path: str) -> Column:
    return F.to_json(F.variant_get(F.parse_json(j), path, "variant"))


def json_has(j: Column, key: str) -> Column:
    """j ? key, on the top level: a key of an object, or an index of an array."""
    found = F.array_contains(F.json_object_keys(j), key)
    if key.isdigit():
        found = F.coalesce(found, F.json_array_length(j) > int(key))
    return F.coalesce(found, F.lit(False))


def json_has_any(j: Column, names: list[str]) -> Column:
    """j ?| names; false for no names."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(j), F.array(*map(F.lit, names))), F.lit(False)) if names else F.lit(False)


def json_has_all(j: Column, names: list[str]) -> Column:
    """j ?& names; false for no names."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), F.json_object_keys(j))) == 0, F.lit(False)) if names else F.lit(False)


# Enums -----------------------------------------------------------------------------------------------------------------------


def enum_ordinal(x: Column, labels: list[str]) -> Column:
    """Place of a label in its type, from 0; null for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), x), F.lit(0).cast("long")) - 1
