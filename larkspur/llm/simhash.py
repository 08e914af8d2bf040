"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two fingerprints with at most three differing bits, one segment
differs in at most one bit, so both have the same variant of that segment with that bit wiped. Each distinct fingerprint is
indexed under its 2 x 32 one-wildcard variants; equal variants meet by an equality shuffle and are verified bit by bit.

Only links that span a variant's group are kept, never all pairs. A group of more than ``GROUP`` fingerprints is not
gathered: its members are indexed once more under the one-wildcard variants of the 33 bits in which they can still differ.
Groups of that second index have at most 18 free bits; large ones are linked by looking up the few hundred neighbours of each
member, linear in their size. Exact copies share one fingerprint and are one node.

``deduplicate`` keeps one document of each group of near copies: links are pairs whose sets of five-word shingles have a Jaccard
similarity of ``SIMILARITY`` or more. A 64-bit fingerprint cannot reach those alone: at 0.8 two of them differ in about ten bits,
far beyond what any index of variants can hold apart. So the SimHash links are candidates beside those of a prefix filter, which
misses none: shingles are put in one order for all texts, and two texts of 0.8 share one of the first ``n - ceil(0.8 n) + 1`` of
each. The order is by hash with the shingles of many texts last (counted in a sixteenth of the texts; it decides about the work, not
about the links). All pairs within a group of up to ``MEET`` texts are candidates, if their sizes and the shingle's places allow 0.8.
In a larger group each text meets the ``PIVOTS`` least; after their links are known, all its pairs of texts that are not yet in one
class are compared as well, so every link is found or lies within a class. A candidate is dropped where the parities of its shingles
by residue already differ in too many places, which is exact as well (in the larger groups before it leaves its group, so that what is
joined are not all pairs of a group); the others are verified on the whole shingle sets. Exact copies are one node from the start.

Defined cases: a null or wordless text has fingerprint zero, linked like any other (for ``deduplicate``: all of them are copies of one
another); a text of fewer words than a shingle is one shingle; a text of any length is read whole; an empty table gives an empty
result; one row per input row, repeated rows and null ids included (a null id is never the smallest unless all are null); other
columns, whatever their names, are ignored by the query and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common
from larkspur.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Of near copies: words of a shingle, least similarity, texts of a shingle that all meet at once, texts that those of a larger group meet first.
NEAR, SIMILARITY, MEET, PIVOTS = 5, 0.8, 32, 8
#: One text in so many is counted, and a shingle of so many of these comes last in the order.
COUNTED, FREQUENT = 16, 4
#: Residues whose parities are compared, and pairs of texts that are compared by them at once.
PARITIES, PAIRS = 2048, 1 << 14
#: Fingerprints under one variant that are compared with one another in place.
GROUP = 1024
SLICE_BYTES = 4 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of a text's word shingles, as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, text: str = "text", column: str = "fingerprint", keep_text: bool = True) -> DataFrame:
    """The rows with a long column holding the fingerprint's bits, in place of a column of that name if there is one."""
    from pyspark.sql import types as T

    common.prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != column and (keep_text or f.name != text)]

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, text, SLICE_BYTES):
                prints = np.array([fingerprint(t) for t in common.texts_as_bytes(batch.column(text)).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(common.signed(prints), pa.int64())], names=[*(f.name for f in kept), column])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.LongType())]))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least member of each node's component, for links a-b among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def span(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that connect just those of the sorted distinct prints which chains of links of at most ``bits`` differing bits connect."""
    n = len(prints)
    varying = np.bitwise_or.reduce(prints ^ prints[0])
    free = [b for b in range(64) if int(varying) >> b & 1]
    masks = sum(1 for k in range(1, bits + 1) for _ in combinations(range(min(len(free), 40)), k))
    left, right = [], []
    if len(free) > 40 or n <= 2 * masks:
        for at in range(0, n, 256):
            near = np.bitwise_count(prints[at : at + 256, None] ^ prints[None, at:]) <= bits
            i, j = np.nonzero(near)
            keep = i < j
            left.append(i[keep] + at)
            right.append(j[keep] + at)
            if sum(map(len, left)) > 1 << 20:
                left, right = _shrink(left, right, n)
    else:
        for k in range(1, bits + 1):
            for chosen in combinations(free, k):
                other = prints ^ np.uint64(sum(1 << b for b in chosen))
                at = np.minimum(np.searchsorted(prints, other), n - 1)
                i = np.flatnonzero((prints[at] == other) & (prints < other))
                left.append(i)
                right.append(at[i])
                if sum(map(len, left)) > 1 << 20:
                    left, right = _shrink(left, right, n)
    (left,), (right,) = _shrink(left, right, n)
    return prints[left], prints[right]


def _shrink(left: list[np.ndarray], right: list[np.ndarray], n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    root = roots(np.concatenate(left), np.concatenate(right), n)
    member = np.flatnonzero(root != np.arange(n))
    return [member], [root[member]]


def _link(bits: int, group: int | None):
    """Rows (key, print) sorted by key -> links (a, b, null) and, for groups above ``group``, rows (null, print, key)."""

    def emit(a=(), b=(), key=()) -> pa.RecordBatch:
        none, n, m = pa.nulls(len(key), pa.int64()), pa.array(common.signed(np.asarray(a, dtype=np.uint64)), pa.int64()), pa.nulls(len(a), pa.int64())
        more = pa.array(common.signed(np.asarray(b, dtype=np.uint64)), pa.int64())
        return pa.RecordBatch.from_arrays([none if len(key) else n, more, pa.array(key, pa.int64()) if len(key) else m], names=["a", "b", "key"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_key, tail, hot = None, np.zeros(0, dtype=np.uint64), False
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(keys):
                continue
            if tail_key is not None and not hot:
                keys, prints = np.append(np.full(len(tail), tail_key), keys), np.append(tail, prints)
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(start, len(keys)))
            if hot:
                if keys[0] == tail_key:  # a large group goes on
                    yield emit((), prints[: size[0]], keys[: size[0]])
                    start, size = start[1:], size[1:]
                hot = False
            if not len(start):
                hot = True
                continue
            pair = start[:-1][size[:-1] == 2]
            near = np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= bits
            yield emit(prints[pair][near], prints[pair + 1][near])
            for s, n in zip(start[:-1][size[:-1] > 2].tolist(), size[:-1][size[:-1] > 2].tolist(), strict=True):
                if group is not None and n > group:
                    yield emit((), prints[s : s + n], keys[s : s + n])
                else:
                    yield emit(*span(np.unique(prints[s : s + n]), bits))
            tail_key, tail = keys[-1], prints[start[-1] :]
            if group is not None and len(tail) > group:
                yield emit((), tail, keys[start[-1] :])
                hot, tail = True, tail[:0]
        if len(tail) > 1:
            yield emit(*span(np.unique(tail), bits))

    return run


def links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) spanning every component of the distinct fingerprints (long column fingerprint) at ``BITS`` bits."""
    schema = "a long, b long, key long"
    p = F.col("fingerprint")
    segments = [F.shiftrightunsigned(p, 32), p.bitwiseAND(0xFFFFFFFF)]
    variants = [s.bitwiseAND(0xFFFFFFFF ^ (1 << i)) + F.lit((k << 37) | (i << 32)) for k, s in enumerate(segments) for i in range(32)]
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # dealt out evenly first, as 64 rows are made of each
    index = prints.select("fingerprint").repartition(n).select(F.explode(F.array(*variants)).alias("key"), "fingerprint")
    first = common.stored(index.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link(BITS, group), schema))
    # Second index, over members of large groups only: the 33 bits in which they can differ are the wiped bit and the other segment.
    key = F.col("key")
    i, k = F.shiftright(key, 32).bitwiseAND(31), F.shiftright(key, 37)
    other = F.when(k == 0, p.bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(p, 32))
    segment = F.when(k == 0, F.shiftrightunsigned(p, 32)).otherwise(p.bitwiseAND(0xFFFFFFFF))
    wiped = F.when(segment.bitwiseAND(F.expr("shiftleft(1L, cast(shiftright(key, 32) & 31 as int))")) != 0, 1).otherwise(0)
    low, high = other.bitwiseAND(0xFFFF), F.shiftright(other, 16) + wiped * 65536
    keys = [F.xxhash64("key", F.lit(j), low.bitwiseAND(0xFFFF ^ (1 << j))) for j in range(16)]
    keys += [F.xxhash64("key", F.lit(16 + j), high.bitwiseAND(0x1FFFF ^ (1 << j))) for j in range(17)]
    hot = first.where("key is not null").select("key", F.col("b").alias("fingerprint"))
    again = hot.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")
    second = again.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link(BITS, None), schema)
    return first.where("key is null").unionByName(second).select("a", "b")


def classes(rows: DataFrame) -> DataFrame:
    """(fingerprint, component_id) of the distinct fingerprints of rows (doc_id, fingerprint); the id is the smallest doc_id reachable."""
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots_ = components(links(nodes.select("fingerprint")))
    joined = nodes.join(roots_.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    root = F.coalesce("root", "fingerprint")
    least = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    return joined.join(least, "root", "left").select("fingerprint", root.alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))


def shingles(words: list[bytes], n: int = NEAR) -> np.ndarray:
    """Hashes of the word shingles; fewer words than one are one shingle, no words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = [b" ".join(words)] if len(words) < n else map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), dtype=">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def least_shared(m, n, similarity: float):
    """Shingles that sets of m and n of this similarity share at least."""
    return np.ceil(similarity / (1 + similarity) * (m + n) - 1e-9)


def prefix(distinct: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first of the distinct sorted hashes, frequent ones last, of which every set of this similarity holds one within its own."""
    keep = len(distinct) - int(np.ceil(similarity * len(distinct) - 1e-9)) + 1
    return distinct[np.argsort(common.bitmap_has(frequent, common.signed(distinct)), kind="stable")[:keep]]


def parities(distinct: np.ndarray) -> bytes:
    """For each residue whether an odd number of hashes has it. Two sets differ in at least as many elements as these in bits."""
    counts = np.bincount((distinct >> np.uint64(20)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


@common.lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (key, n): texts of a slice that hold each shingle."""
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE_BYTES):
            sets = [np.unique(shingles(t.lower().split() if t else [])) for t in common.texts_as_bytes(batch.column("text")).to_pylist()]
            key, n = np.unique(np.concatenate(sets), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(key), pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Map of the shingles that ``FREQUENT`` different texts of the counted ones hold."""
    h = F.xxhash64("text")
    some = docs.where(F.pmod(h, F.lit(COUNTED)) == 0).select(h.alias("h"), "text").dropDuplicates(["h"]).select("text")
    keys = some.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return common.membership_bitmap(keys, "key")


def _nodes(text: str, frequent, similarity: float):
    """Puts the hash of a text's folded words, its fingerprint, its number of shingles, their parities and their prefix in place of the text."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole, text, SLICE_BYTES):
                node, prints, size, odd, keys = [], [], [], [], []
                for t in common.texts_as_bytes(batch.column(text)).to_pylist():
                    words = t.lower().split() if t else []
                    node.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                    hashes = shingles(words)
                    prints.append(majority(hashes))
                    distinct = np.unique(hashes)
                    size.append(len(distinct))
                    odd.append(parities(distinct))
                    keys.append(prefix(distinct, frequent.value, similarity))
                columns, names = list(batch.columns), list(batch.schema.names)
                at = names.index(text)
                del columns[at], names[at]
                columns += [pa.array(common.signed(np.array(x, dtype=np.uint64)), pa.int64()) for x in (node, prints)]
                columns += [pa.array(size, pa.int64()), pa.array(odd, pa.binary())]
                offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(common.signed(np.concatenate(keys)) if keys else [], pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "__node", "__print", "__size", "__odd", "__keys"])

    return run


def _grouped(columns: tuple[str, ...], whole):
    """Rows sorted by their first column -> what ``whole`` yields of the arrays of one or more complete groups."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
            if cut or (held and held[0][0][0] != rows[0][0]):
                before = [*held, [r[:cut] for r in rows]]
                first = np.concatenate([b[0] for b in before])
                if len(first):
                    yield from whole(first, *(np.concatenate([b[i] for b in before]) for i in range(1, len(columns))))
                held = []
            held.append([r[cut:] for r in rows])
        if held:
            yield from whole(*(np.concatenate([b[i] for b in held]) for i in range(len(columns))))

    return run


def _may(size: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sizes of rows i and j and the places of the shingle allow the similarity, if it is the first one that they share."""
    rest = np.minimum(size[i] - at[i], size[j] - at[j])
    return (rest >= least_shared(size[i], size[j], similarity)) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)


def _met(similarity: float, meet: int):
    """Rows (key, node, size, at) sorted by key and node -> candidates (a, b) and, of groups of more than ``meet``, the rows as they are."""

    def whole(key, node, size, at) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(start, len(key)))
        place = np.arange(len(key)) - np.repeat(start, count)
        count = np.repeat(count, count)
        left, right = [], []
        for d in range(1, min(meet, int(count.max()))):
            i = np.flatnonzero((place >= d) & (count <= meet))
            left.append(i)
            right.append(i - d)
        hot = np.flatnonzero(count > meet)
        for d in range(PIVOTS):
            i = hot[place[hot] > d]
            left.append(i)
            right.append(i - place[i] + d)
        i, j = (np.concatenate(x) for x in (left, right))
        may = _may(size, at, i, j, similarity)
        a, b = node[i[may]], node[j[may]]
        none, more = [pa.nulls(len(a), pa.int64())] * 3, [pa.nulls(len(hot), pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none, pa.array(a)], names=["a", "b", "key", "size", "at", "node"])
        if len(hot):
            yield pa.RecordBatch.from_arrays([*more, *(pa.array(x[hot]) for x in (key, size, at, node))], names=["a", "b", "key", "size", "at", "node"])

    return _grouped(("key", "node", "size", "at"), whole)


def _bits(odd) -> np.ndarray:
    """A row of words for each of the parities."""
    return np.frombuffer(b"".join(odd), dtype=np.uint64).reshape(-1, PARITIES // 64)


def _alike(m: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sizes m, n and parities x, y of pairs allow the similarity."""
    shared = least_shared(m, n, similarity)
    return (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= m + n - 2 * shared) & (np.minimum(m, n) >= shared) & (np.minimum(m, n) > 0)


def _across(similarity: float):
    """Rows (key, node, size, at, root, odd) sorted by key and size -> candidates (a, b) of different roots whose parities allow the similarity."""

    def whole(key, node, size, at, root, odd) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for s, e in zip(start.tolist(), np.append(start[1:], len(key)).tolist(), strict=True):
            bits = _bits(odd[s:e])
            step = max(1, (1 << 20) // (e - s))
            for low in range(s, e, step):
                high = min(low + step, e)
                end = s + int(np.searchsorted(size[s:e], size[high - 1] / similarity + 1, side="right"))
                i, j = np.nonzero(root[low:high, None] != root[None, low:end])
                i, j = i[i < j] + low, j[i < j] + low
                may = _may(size, at, i, j, similarity)
                i, j = i[may], j[may]
                for k in range(0, len(i), PAIRS):
                    x, y = i[k : k + PAIRS], j[k : k + PAIRS]
                    alike = _alike(size[x], size[y], bits[x - s], bits[y - s], similarity)
                    a, b = node[x[alike]], node[y[alike]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return _grouped(("key", "node", "size", "at", "root", "odd"), whole)


def _possible(similarity: float):
    """(a, b, m, n, x, y) -> (a, b) of those whose sizes m, n and parities x, y allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            x, y = (_bits(batch.column(c).to_pylist()) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(_alike(m, n, x, y, similarity)))

    return run


@common.lean
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__node, text) -> (node, set): the sorted shingle hashes."""
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE_BYTES):
            sets = [np.unique(shingles(t.lower().split() if t else [])).tobytes() for t in common.texts_as_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__node"), pa.array(sets, pa.binary())], names=["node", "set"])


def _verified(similarity: float):
    """(a, b, x, y) -> (a, b) of those whose sets x and y are similar enough."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)]))
                shared = int((both[1:] == both[:-1]).sum())
                near.append(bool(shared) and shared >= similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def possible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the candidates (a, b), each once, whose sizes and parities allow the similarity."""
    of = lambda c, n, x: nodes.select(F.col("node").alias(c), F.col("size").alias(n), F.col("odd").alias(x))
    both = pairs.where("a <> b").distinct().join(of("a", "m", "x"), "a").join(of("b", "n", "y"), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(_possible(similarity), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of the different candidates (a, b) that have the similarity."""
    spark = docs.sparkSession
    pairs = common.stored(pairs)
    members = pairs.select(F.col("a").alias("__node")).union(pairs.select("b")).distinct()
    # the text of one row of each node, so that copies do not meet anywhere
    wanted = common.stored(nodes.join(members, nodes["node"] == members["__node"]).select("__node", F.col("best.doc_id").alias("__id"), F.col("best.tie").alias("__best")))
    asked = spark.sparkContext.broadcast(common.membership_bitmap(wanted, "__best"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.bitmap_has(asked.value, b.column("__tie").to_numpy())))

    docs = docs.mapInArrow(chosen, docs.schema)
    texts = docs.join(wanted, (docs["__tie"] == wanted["__best"]) & docs["doc_id"].eqNullSafe(wanted["__id"])).select("__node", "text")
    sets = common.stored(texts.mapInArrow(_sets, "node long, set binary").dropDuplicates(["node"]))
    asked.destroy()
    common.relieve(spark)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    out = common.stored(both.select("a", "b", "x", "y").mapInArrow(_verified(similarity), "a long, b long"))
    common.discard(pairs, wanted, sets)
    return out


def near_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, meet: int = MEET) -> DataFrame:
    """Verified links (a, b) among the distinct texts ``nodes`` (node, best, print, size, odd, keys) of ``docs`` (doc_id, __tie, text); any other pair of the similarity lies in one class of these."""
    spark = docs.sparkSession
    leads = nodes.groupBy("print").agg(F.min("node").alias("lead"))
    of = lambda c: leads.select(F.col("print").alias(c), F.col("lead").alias(f"{c}_lead"))
    close = links(leads.select(F.col("print").alias("fingerprint"))).join(of("a"), "a").join(of("b"), "b").select(F.greatest("a_lead", "b_lead").alias("a"), F.least("a_lead", "b_lead").alias("b"))
    same = nodes.join(leads, "print").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("at", "key")).select("key", "node", "size", F.col("at").cast("long").alias("at"))
    met = keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_met(similarity, meet), "a long, b long, key long, size long, at long, node long")
    met = common.stored(met)
    common.relieve(spark)
    first = close.unionByName(same).unionByName(met.where("key is null").select("a", "b"))
    found = verified(possible(first, nodes, similarity), docs, nodes, similarity)
    hot = met.where("key is not null").select("key", "node", "size", "at")
    common.release(spark)
    common.relieve(spark)
    if hot.isEmpty():
        common.discard(met)
        return found
    rooted = hot.join(components(found), "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root"))
    rooted = common.stored(rooted)
    common.relieve(spark)
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    open_ = rooted.join(split, "key").join(nodes.select("node", "odd"), "node").repartition(n, "key").sortWithinPartitions("key", "size")
    more = open_.select("key", "node", "size", "at", "root", "odd").mapInArrow(_across(similarity), "a long, b long")
    more = verified(more.distinct(), docs, nodes, similarity)
    common.discard(met, rooted)
    return found.unionByName(more)


def deduplicate(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY, meet: int = MEET) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest doc_id (nulls last), ties by the row's hash."""
    from pyspark.sql import types as T

    common.prepare(docs.sparkSession)
    names = docs.columns
    tie = F.xxhash64(*[F.to_json(F.struct(c)) if "map" in t or "variant" in t else F.col(c) for c, t in docs.dtypes])
    slim = docs.select("doc_id", tie.alias("__tie"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType
    fields = {"__tie": T.LongType(), "__node": T.LongType(), "__print": T.LongType(), "__size": T.LongType(), "__odd": T.BinaryType(), "__keys": T.ArrayType(T.LongType())}
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(slim))
    rows = common.stored(slim.mapInArrow(_nodes("text", frequent, similarity), T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t in fields.items())])))
    frequent.destroy()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__tie").alias("tie"))
    nodes = common.stored(rows.groupBy(F.col("__node").alias("node")).agg(F.min(order).alias("best"), F.min("__print").alias("print"), F.min("__size").alias("size"), F.min("__odd").alias("odd"), F.min("__keys").alias("keys")))
    common.discard(rows)
    found = near_links(slim, nodes, similarity, meet)
    common.relieve(docs.sparkSession)
    roots_ = components(found)
    common.relieve(docs.sparkSession)
    joined = nodes.select("node", "best").join(roots_, "node", "left")
    best = joined.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("best", "node")).alias("x"))
    chosen = best.select(F.col("x.node").alias("__node"), F.col("x.best.doc_id").alias("__id"), F.col("x.best.tie").alias("__tie"))
    marked = docs.withColumn("__tie", tie)
    kept = marked.join(chosen.select("__id", F.col("__tie").alias("__chosen")), (marked["__tie"] == F.col("__chosen")) & marked["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["__tie"]).select(*names)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    rows = common.stored(with_fingerprints(docs, keep_text=False))
    out = rows.join(classes(rows).select("fingerprint", "component_id"), "fingerprint")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
