"""Exact top-k inner-product search by pivot-table elimination.

Vectors become integers, ``floor(1024 * x)``. The index, stored once, holds each candidate with its row of the pivot table: its
distances to ``PIVOTS`` pivots. For a query q and a candidate x, each pivot p gives ``d(q, x) >= |d(q, p) - d(x, p)|``; the greatest
of these lower bounds, with ``q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, bounds the score from above. A task evaluates candidates in
the order of their bounds and stops when the next bound lies below its k-th best score, so the result is exact. Pivots are
fitted on a sample of at most ``SAMPLE`` vectors (far from one another); every vector is indexed.

Queries are a stated set. They are packed in blocks of at most ``QUERY_BLOCK`` with their own rows of the pivot table, stored, and
every block meets every part of the index once, in one stage, without passing through the driver; a task holds its part of the
index and one block at a time, and returns at most k rows for a query. The best k of these are picked after a shuffle by query.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; a query
meets candidates of its own dimension only (one without components scores 0); with repeated ids every row is a candidate, and rows
with the query's own id are left out; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm import common

K, SCALE = 10, 1024
PIVOTS, SAMPLE, QUERY_BLOCK = 24, 4096, 1024
#: Vectors of the index in one part, as far as the session's partitions go.
PART = 50_000


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    x = F.transform(F.col(embedding), lambda c: c.cast("double"))
    ok = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE)).cast("array<long>").alias("v"))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors of the sample far from one another: each next one is farthest from those taken."""
    if not len(sample):
        return sample
    at, near = 0, np.full(len(sample), np.inf)
    taken = []
    for _ in range(min(n, len(sample))):
        taken.append(at)
        near = np.minimum(near, ((sample - sample[at]).astype(np.float64) ** 2).sum(axis=1))
        at = int(near.argmax())
    return sample[taken]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    a, b = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def best_of(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, bound: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
    """The k best candidates as (-score, id), evaluated in the order of their bounds until no other can enter; and how many were evaluated."""
    best: list[tuple[int, int]] = []
    order = np.argsort(-bound, kind="stable")
    step, at = 4 * k, 0
    while at < len(order):
        if len(best) == k and bound[order[at]] < -best[-1][0]:
            break
        part = order[at : at + step]
        part = part[ids[part] != own]
        score = rows[part] @ query
        if len(best) == k:
            part, score = part[score >= -best[-1][0]], score[score >= -best[-1][0]]
        best = sorted([*best, *zip((-score).tolist(), ids[part].tolist(), strict=True)])[:k]
        at += step
        step = min(4 * step, 1 << 13)
    return best, min(at, len(order))


def _indexed(pivots: dict[int, np.ndarray]):
    """(vec_id, v) -> (vec_id, v, table): the row of the pivot table added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            dims = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
            out: list = [None] * batch.num_rows
            for d in np.unique(dims).tolist():
                mine = np.flatnonzero(dims == d)
                rows = v.take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), d)
                for i, row in zip(mine.tolist(), distances(rows, pivots.get(d, np.zeros((0, d), dtype=np.int64))).tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v, pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "v", "table"])

    return run


def _packed(size: int):
    """(vec_id, v, table) -> blocks (dim, n, block): ids, vectors and pivot rows of at most ``size`` queries of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for q, v, t in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "table")), strict=True):
                mine = held.setdefault(len(v), [])
                mine.append((q, v, t))
                if len(mine) == size:
                    yield _block(len(v), held.pop(len(v)))
        for d, mine in held.items():
            yield _block(d, mine)

    return run


def _block(d: int, mine: list) -> pa.RecordBatch:
    data = np.array([q for q, _, _ in mine], dtype=np.int64).tobytes() + np.array([v for _, v, _ in mine], dtype=np.int64).tobytes() + np.array([t for _, _, t in mine], dtype=np.float64).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([len(mine)], pa.int32()), pa.array([data], pa.binary())], names=["dim", "n", "block"])


MEETING = "part int, vec_id long, v array<long>, table array<double>, dim int, n int, block binary"


def _met(k: int):
    """A part of the index, then blocks of queries -> the k best candidates of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        parts: dict[int, tuple] | None = None
        of = None
        for batch in batches:
            number = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if number[a] != of:  # the next part of this partition
                    held, parts, of = {}, None, number[a]
                some = batch.slice(a, b - a)
                vectors = some.filter(pa.compute.is_null(some.column("block")))
                if vectors.num_rows:
                    dims = pa.compute.list_value_length(vectors.column("v")).to_numpy(zero_copy_only=False)
                    for d in np.unique(dims).tolist():
                        mine = vectors.take(pa.array(np.flatnonzero(dims == d)))
                        n = mine.num_rows
                        held.setdefault(d, []).append((mine.column("vec_id").to_numpy(), mine.column("v").flatten().to_numpy().reshape(n, d), mine.column("table").flatten().to_numpy().reshape(n, -1)))
                blocks = some.filter(pa.compute.is_valid(some.column("block")))
                if blocks.num_rows and parts is None:
                    parts = {}
                    for d, x in held.items():
                        ids, rows, table = (np.concatenate(c) for c in zip(*x, strict=True))
                        parts[d] = (ids, rows, table, (rows * rows).sum(axis=1))
                    held = {}
                for d, n, data in zip(*(blocks.column(c).to_pylist() for c in ("dim", "n", "block")), strict=True):
                    if d in parts:
                        yield _found(parts[d], d, n, data, k)

    return run


def _found(part: tuple, d: int, n: int, data: bytes, k: int) -> pa.RecordBatch:
    ids, rows, table, norm = part
    query_ids = np.frombuffer(data, dtype=np.int64, count=n)
    queries = np.frombuffer(data, dtype=np.int64, count=n * d, offset=8 * n).reshape(n, d)
    query_table = np.frombuffer(data, dtype=np.float64, offset=8 * n * (1 + d)).reshape(n, -1)
    query_norm = (queries * queries).sum(axis=1)
    slack = 1 + 1e-9 * (norm.max(initial=0) + query_norm.max(initial=0))
    out = []
    for i in range(n):
        gap = np.abs(table - query_table[i]).max(axis=1) if table.shape[1] else np.zeros(len(rows))
        gap = np.maximum(gap - 1e-6 * (1 + gap), 0)
        best, evaluated = best_of(queries[i], int(query_ids[i]), ids, rows, (norm + query_norm[i] - gap * gap) / 2 + slack, k)
        out += [(int(query_ids[i]), v, -score, evaluated if not j else 0, len(ids) if not j else 0) for j, (score, v) in enumerate(best)]
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score", "evaluated", "candidates"])


def index(table: DataFrame, n_pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, v, table) of quantised vectors, stored: each with its distances to the pivots of its dimension."""
    sample: dict[int, list] = {}
    for (v,) in table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toLocalIterator():
        sample.setdefault(len(v), []).append(v)
    pivots = {d: pick_pivots(np.array(v, dtype=np.int64).reshape(len(v), d), n_pivots) for d, v in sample.items()}
    return common.stored(table.mapInArrow(_indexed(pivots), "vec_id long, v array<long>, table array<double>"))


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int = QUERY_BLOCK, n_pivots: int = PIVOTS, report: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every row for which ``is_query`` holds (on vec_id).

    With ``report``, instead: query_id, evaluated, candidates, which tells how many candidates the bounds left to be evaluated.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    indexed = index(quantised(vectors), n_pivots)
    queries = common.stored(indexed.where(is_query).dropDuplicates(["vec_id", "v"]).coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_packed(block), "dim int, n int, block binary"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-indexed.count() // PART))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    candidates = indexed.select(part.alias("part"), "vec_id", "v", "table", none("int").alias("dim"), none("int").alias("n"), none("binary").alias("block"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"), none("long").alias("vec_id"), none("array<long>").alias("v"), none("array<double>").alias("table"), "dim", "n", "block")
    both = candidates.unionByName(asked).repartition(n, "part").sortWithinPartitions("part", F.col("block").isNotNull())
    found = both.mapInArrow(_met(k), "query_id long, vec_id long, score long, evaluated long, candidates long")
    if report:
        return found.groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"), F.sum("candidates").alias("candidates"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates of every vector whose id is divisible by 100, against all vectors."""
    return search(common.documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op9_topk": op9_topk}
ORACLES = {"op9_topk": ORACLE_SQL}
