"""Benchmark decontamination by training suffix arrays.

Every task turns its share of the training texts into shards. A shard keeps the runs of words that occur in the benchmark
(no other word can take part in a match), laid end to end, and sorts all their suffixes into a suffix array. Every test
suffix is then binary-searched in the shard, which gives its longest verbatim match with a location. Where that is as long as the
suffix's window (``WINDOW`` words, or the whole of a shorter item), the training suffixes that begin with the window lie next to one
another in the array: all of them are hits, and comparing on gives the longest match of each document with its place there and in
the item. Documents with a hit are removed. No training text is shuffled or collected.

The benchmark is the stated query set. It is read in blocks of at most ``BLOCK_BYTES``, each broadcast by itself; a task runs a shard
against one block after the other, so one block is held at a time and the texts are read once, however large the benchmark is.

Defined cases: a null or wordless text has no words, no hits and is not contaminated; items without words occur nowhere; a text
of any length is read whole; an empty table gives an empty result, and an empty benchmark contaminates nothing; rows are judged one
by one, so repeated rows and null ids give one result row each; other columns, whatever their names, are ignored by
``contamination`` and kept as they are by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

#: Words in a window; an item with fewer words is one window.
WINDOW = 10
#: Benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: Text in one training shard.
SHARD_BYTES = 16 << 20

_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of letters, digits and anything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


class Block:
    """Part of the benchmark: its vocabulary, its items as one id sequence with zeros between, and the places where a suffix begins with a whole window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        ids: list[int] = [0]
        self.names = [name for name, _ in items]
        item, at, first, need = [], [], [], []
        shortest, longest = window, 1
        for k, (_, ws) in enumerate(items):
            if not ws:
                continue
            begin, w = len(ids), min(window, len(ws))
            row = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in ws]
            ids += row
            ids.append(0)
            shortest, longest = min(shortest, w), max(longest, len(row))
            item += [k] * len(row)
            at += range(begin, begin + len(row))
            first += [begin] * len(row)
            need += [w if len(row) - i >= w else len(row) + 1 for i in range(len(row))]  # the last suffixes hold no window
        self.shortest, self.longest = shortest, longest
        self.text = np.array(ids, dtype=np.int64)
        self.suffix_at, self.suffix_item, self.item_at, self.suffix_window = (np.array(x, dtype=np.int64) for x in (at, item, first, need))
        ends = np.flatnonzero(self.text == 0)
        self.suffix_words = ends[np.searchsorted(ends, self.suffix_at)] - self.suffix_at if len(self.suffix_at) else self.suffix_at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by their first ``depth`` symbols or more (prefix doubling)."""
    n = len(text)
    rank, span = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[: max(0, n - span)] += rank[span:]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        span *= 2
        if n == 0 or rank[order[-1]] == n - 1:
            break
    return order


def _compare(shard: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign of shard suffix minus test suffix over ``depth`` symbols, and the common length."""
    common_words, sign = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    live = np.flatnonzero(depth > 0)
    while len(live):
        k = common_words[live]
        a, b = shard[at[live] + k], test[start[live] + k]
        same = a == b
        sign[live[~same]] = np.sign(a - b)[~same]
        live = live[same]
        common_words[live] += 1
        live = live[common_words[live] < depth[live]]
    return sign, common_words


def _bound(shard: np.ndarray, order: np.ndarray, test: np.ndarray, start: np.ndarray, depth: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of every test suffix at once: the first suffix not below it (or, upper, the first above it)."""
    low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), len(order), dtype=np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        sign, _ = _compare(shard, order[mid], test, start[open_], depth[open_])
        right = sign <= 0 if upper else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


class Shard:
    """Suffix array over the runs of benchmark words of some training texts."""

    def __init__(self, texts: list[list[bytes]], block: Block):
        get = block.vocabulary.get
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=self.first[1:])  # a zero after each text
        ids = np.zeros(int(self.first[-1]) + 1, dtype=np.int64)
        for at, ws in zip(self.first[:-1].tolist(), texts, strict=True):
            if ws:
                ids[at : at + len(ws)] = [get(x, 0) for x in ws]
        known = ids > 0
        edge = np.flatnonzero(known[1:] != known[:-1]) + 1
        if known[0]:
            edge = np.append(0, edge)
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= block.shortest
        begin, end = begin[keep], end[keep]
        mask = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(mask, begin, 1)
        np.add.at(mask, end + 1, -1)  # with the zero that follows
        self.place = np.flatnonzero(np.cumsum(mask)[: len(ids)] > 0)  # position of each kept symbol
        kept = ids[self.place]
        self.text = np.concatenate([kept, np.zeros(block.longest + 1, dtype=np.int64)])
        order = suffix_array(kept, block.longest)
        self.order = order[kept[order] > 0]
        self.total = len(ids)

    def longest(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each test suffix, the length of its longest verbatim match, its position in the shard (-1: none), and its place among the sorted suffixes."""
        n = len(block.suffix_at)
        best, where = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        if not len(self.order):
            return best, where, best
        low = _bound(self.text, self.order, block.text, block.suffix_at, block.suffix_words, False)
        for near in (low, low - 1):
            ok = (near >= 0) & (near < len(self.order))
            at = self.order[np.clip(near, 0, len(self.order) - 1)]
            _, length = _compare(self.text, at, block.text, block.suffix_at, np.where(ok, block.suffix_words, 0))
            better = length > best
            best[better], where[better] = length[better], self.place[at[better]]
        return best, where, low

    def matches(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every training suffix that begins with a test suffix's window: test suffix, position in the shard, words of the whole match."""
        best, _, _ = self.longest(block)
        hit = np.flatnonzero(best >= block.suffix_window)
        start, depth = block.suffix_at[hit], block.suffix_window[hit]
        low = _bound(self.text, self.order, block.text, start, depth, False)
        n = _bound(self.text, self.order, block.text, start, depth, True) - low
        number = np.repeat(np.arange(len(n)), n)
        at = self.order[np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)] if len(number) else number
        _, length = _compare(self.text, at, block.text, start[number], block.suffix_words[hit[number]])
        return hit[number], self.place[at], length


def blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[Block]:
    """Read the benchmark to the driver block by block."""
    rows, size = [], 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        n = len(text or b"")
        if rows and size + n > limit:
            yield Block(rows, window)
            rows, size = [], 0
        rows.append((name if name is not None else "", words(bytes(text) if text else None)))
        size += n
    if rows:
        yield Block(rows, window)


class Judged:
    """What blocks, one after the other, find in some texts."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [words(t) for t in texts]
        self.first = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) + 1 for x in self.texts], out=self.first[1:])
        self.hit = np.zeros(int(self.first[-1]) + 1, dtype=bool)
        self.items: list[set[str]] = [set() for _ in texts]
        self.best: list[tuple] = [(0, None, None, None)] * len(texts)  # words, place, item, place there

    def add(self, block: Block) -> None:
        shard = Shard(self.texts, block)
        suffix, at, length = shard.matches(block)
        if not len(at):
            return
        delta = np.zeros(len(self.hit) + 1, dtype=np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + block.suffix_window[suffix], -1)
        self.hit |= np.cumsum(delta)[: len(self.hit)] > 0
        text = np.searchsorted(self.first, at, side="right") - 1
        n = len(block.names)
        for p in np.unique(text * n + block.suffix_item[suffix]).tolist():
            self.items[p // n].add(block.names[p % n])
        # of a text's longest matches the first one in it, then the least item by name
        order = np.lexsort((at, -length, text))
        head = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        for i, k in zip(text[head].tolist(), head.tolist(), strict=True):
            ties = np.flatnonzero((text == i) & (length == length[k]) & (at == at[k])) if length[k] >= self.best[i][0] else ()
            for j in ties:
                found = (int(length[j]), int(at[j] - self.first[i]), block.names[block.suffix_item[suffix[j]]], int(block.suffix_at[suffix[j]] - block.item_at[suffix[j]]))
                if self.best[i][1] is None or (-found[0], *found[1:]) < (-self.best[i][0], *self.best[i][1:]):
                    self.best[i] = found

    def hits(self) -> list[int]:
        total = np.append(0, np.cumsum(self.hit))
        return (total[self.first[1:] - 1] - total[self.first[:-1]]).tolist()


STATE = "n_words long, n_hit long, items array<string>, longest long, longest_at long, longest_item string, longest_item_at long"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: n_words, n_hit (words inside an occurrence of a window), the item ids found, contaminated; and its longest match.

    longest: words of the longest verbatim match that begins with a window (null without one); longest_at and longest_item_at: its
    first word in the document and in the item longest_item (of ties the first place, then the least item).
    """
    spark = docs.sparkSession
    common.prepare(spark)
    df = docs.select("doc_id", "text")
    handles = list(blocks_broadcast(spark, benchmark, window, block_bytes))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SHARD_BYTES):
                judged = Judged(common.texts_as_bytes(batch.column("text")).to_pylist())
                for handle in handles:
                    judged.add(held(handle))
                best = [b if b[1] is not None else (None,) * 4 for b in judged.best]
                columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array([len(x) for x in judged.texts], pa.int64()), "n_hit": pa.array(judged.hits(), pa.int64()), "items": pa.array([sorted(x) for x in judged.items], pa.list_(pa.string()))}
                columns |= {c: pa.array([b[i] for b in best], pa.string() if c == "longest_item" else pa.int64()) for i, c in enumerate(("longest", "longest_at", "longest_item", "longest_item_at"))}
                yield pa.RecordBatch.from_pydict(columns)

    found = df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {STATE}")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def blocks_broadcast(spark: SparkSession, benchmark: DataFrame, window: int, limit: int) -> Iterator:
    """Broadcast handles of the blocks; an empty benchmark is one empty block."""
    any_ = False
    for block in blocks(benchmark, window, limit):
        any_ = True
        yield spark.sparkContext.broadcast(block)
    if not any_:
        yield spark.sparkContext.broadcast(Block([], window))


def held(handle) -> Block:
    """A broadcast block; the value of the one before is let go, so that a worker holds one."""
    last = _last.get("handle")
    if last is not None and last is not handle and hasattr(last, "_value"):
        del last._value  # read again from the executor's file where it is needed again
    _last["handle"] = handle
    return handle.value


_last: dict = {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    spark = docs.sparkSession
    common.prepare(spark)
    handles = list(blocks_broadcast(spark, benchmark, window, block_bytes))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, text, SHARD_BYTES):
                judged = Judged(common.texts_as_bytes(batch.column(text)).to_pylist())
                for handle in handles:
                    judged.add(held(handle))
                yield batch.filter(pa.array([not x for x in judged.items], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every test suffix with a match of its window or more: item_id, item_word, doc_id, doc_word, n_words of the longest one (ties: smallest doc_id, doc_word)."""
    spark = docs.sparkSession
    common.prepare(spark)
    schema = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), docs.schema["doc_id"], T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())])
    handles = list(blocks_broadcast(spark, benchmark, window, block_bytes))

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, "text", SHARD_BYTES):
                texts = [words(t) for t in common.texts_as_bytes(batch.column("text")).to_pylist()]
                for handle in handles:
                    block = held(handle)
                    shard = Shard(texts, block)
                    suffix, at, length = shard.matches(block)
                    text = np.searchsorted(shard.first, at, side="right") - 1
                    columns = [
                        pa.array([block.names[k] for k in block.suffix_item[suffix].tolist()], pa.string()), pa.array(block.suffix_at[suffix] - block.item_at[suffix], pa.int64()),
                        batch.column("doc_id").take(pa.array(text, pa.int64())), pa.array(at - shard.first[text], pa.int64()), pa.array(length, pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = docs.select("doc_id", "text").mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "doc_word")).alias("b")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "b.doc_id", "b.doc_word", (-F.col("b.n")).alias("n_words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the whole benchmark table."""
    out = contamination(common.documents(spark, sf_dir), common.documents(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", "longest", "longest_at", "longest_item", "longest_item_at")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, i AS p, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, dw.n, CAST(item_id AS VARCHAR) AS item_id, p FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
runs AS (
  SELECT doc_id, item_id, min(i) AS i, min(p) AS p, count(*) + any_value(n) - 1 AS words
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, n, i - p ORDER BY i) AS island FROM occ)
  GROUP BY doc_id, item_id, n, i - p, island),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, i, item_id, p) = 1),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(best.words AS BIGINT) AS longest, CAST(best.i - 1 AS BIGINT) AS longest_at, best.item_id AS longest_item, CAST(best.p - 1 AS BIGINT) AS longest_item_at
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN best USING (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": ORACLE_SQL}
