"""Tables of 64-bit keys: the most frequent ones looked up in place, the rest dealt out in packed runs of key ranges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def most_frequent(keys: DataFrame, limit: int, value: str = "n") -> tuple[np.ndarray, np.ndarray, float]:
    """Keys (sorted) and values of the most frequent keys, at most ``limit``, and the count class from which they are complete."""
    bucket = F.floor(F.log2("n") * 4).cast("long")
    rows = sorted(((int(b), int(c)) for b, c in keys.groupBy(bucket.alias("b")).count().collect()), reverse=True)
    least, held = None, 0
    for b, c in rows:
        if held + c > limit:
            break
        least, held = b, held + c
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), float("inf")
    got = keys.where(bucket >= least).select("key", value).toArrow()
    found, values = (got.column(c).to_numpy() for c in ("key", value))
    order = np.argsort(found)
    return found[order], values[order], float(least)


class Lookup:
    """Keys in unsigned order with values, found through the offsets of their leading bits, as keys are hashes."""

    def __init__(self, keys: np.ndarray, value: np.ndarray):
        self.keys, self.value = keys, value
        self.bits = max(1, len(keys).bit_length() - 1)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.append(np.searchsorted(self.keys, edges), len(keys)).astype(np.int32)

    @staticmethod
    def of(keys: np.ndarray, value: np.ndarray) -> Lookup:
        order = np.argsort(keys.view(np.uint64), kind="stable")
        return Lookup(keys.view(np.uint64)[order], value[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 where it is not)."""
        u, there, value = keys.view(np.uint64), np.zeros(len(keys), dtype=bool), np.zeros(len(keys))
        bucket = (u >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        live = np.flatnonzero(at < end)
        at, end, u = at[live], end[live], u[live]
        while len(live):
            same = self.keys[at] == u
            there[live[same]] = True
            value[live[same]] = self.value[at[same]]
            at = at + 1
            on = ~same & (at < end)
            live, at, end, u = live[on], at[on], end[on], u[on]
        return there, value


def cut(keys: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    of = common.buckets(keys, n_buckets)
    head = np.flatnonzero(np.diff(of, prepend=-1))
    return list(zip(of[head].tolist(), head.tolist(), [*head[1:].tolist(), len(keys)], strict=True)) if len(head) else []


def home(rows: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket in which a row's answers meet: that of the task that read it."""
    return ((rows >> 40) % n_buckets).astype(np.int32)


def summed(rows: np.ndarray, b: np.ndarray, s: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of the values of each row, by row."""
    out, of = np.unique(rows, return_inverse=True)
    return out, *(np.bincount(of, weights=x, minlength=len(out)).astype(float) for x in (b, s, k))


def dealt(spark: SparkSession) -> int:
    """Partitions that runs are dealt out to; buckets are three times as many, so a partition's are alike in size and are merged one by one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
