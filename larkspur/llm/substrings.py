"""Removal of word windows that an earlier document already has, by relative Lempel-Ziv parsing against reference blocks.

Every text is parsed against every reference block that could hold a match for it. Blocks are content-defined: the window of
``WINDOW`` words belongs to the block of its anchor (the least hash of its ``GRAM``-word shingles), so equal windows lie in the same
block wherever they occur, and a text meets just the blocks of its own anchors; no block that could match is left out.

* A *phrase* is a maximal run of consecutive windows with one anchor. Of a phrase that an earlier document has as a whole, all
  windows are duplicates: one factor, found by the phrase's hash.
* The other phrases of a block that several documents share are its reference, indexed by sorting all their suffixes. Each is
  factored greedily against those of earlier documents: at each place the longest match becomes a factor (from document, from word,
  length). Where a factor ends, the windows that lie across its end are looked up as well, since each may
  occur elsewhere in the block. Factors of ``WINDOW`` words or more are the duplicate spans.
* A block of more than ``BLOCK`` different phrases (a common line among ever new neighbours) is not gathered: it is split by window,
  so its factors have the length of one.

Both steps are equality shuffles of fixed-width hashes (128 bits of a phrase, 64 of each word, decide); exact and near copies
collapse to one phrase by partial aggregation, so a text held by a third of all documents moves no large group to one task. Maps of
fixed size (``common.membership_bitmap``) keep phrases that occur once out of the shuffles; when a corpus fills them, more rows pass
and the results stay the same. Only texts that lose words are moved.

Defined cases: null, empty and short texts (fewer than ``WINDOW`` words) have no windows and lose nothing; a text of any length is
read whole; a row with a null id is neither source nor target; rows sharing an id are judged one by one and do not affect each
other; an empty table gives an empty result; ids that are no whole numbers are an error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common

WINDOW, GRAM = 13, 5
#: Different phrases of a block that are indexed and factored in one place.
BLOCK = 2000
SLICE_BYTES = 1 << 19
#: Sum of a block's squared row lengths in bytes up to which its suffixes are copied (16 times as many bytes as they take).
COPIED = 64 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)


class Parse:
    """Phrases of some texts: text number, anchor, digest, first word (in its text), windows."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
        data, starts, ends, first = common.split_words(texts)
        self.first, n = first, len(starts)
        self.words = words = common.word_hashes(data, starts, ends, common.FIRST)
        self.one, self.two = common.FIRST.prefix(words), common.SECOND.prefix(common.mix(words ^ _OTHER))
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        self.window = window
        at = np.arange(max(0, n - window + 1))
        at = at[at + window <= first[text[: len(at)] + 1]]
        if not len(at):
            self.text = self.start = self.count = self.at = np.zeros(0, dtype=np.int64)
            self.anchor = self.digest = np.zeros(0, dtype=np.int64)
            return
        grams = np.arange(n - gram + 1)
        least = common.mix(common.FIRST.ranges(self.one, grams, grams + gram))
        width, span = window - gram + 1, 1
        while span * 2 <= width:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        value, of = least[at], text[at]
        new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))
        head = np.flatnonzero(new)
        self.count = np.diff(np.append(head, len(at)))
        self.at, self.text = at[head], of[head]
        self.start = self.at - first[self.text]
        end = self.at + self.count + window - 1
        self.anchor = common.signed(value[head])
        self.digest = common.signed(common.mix(common.SECOND.ranges(self.two, self.at, end) + self.count.astype(np.uint64)))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen phrases' windows: phrase number, first word (in its text), two hashes."""
        n = self.count[chosen]
        phrase = np.repeat(chosen, n)
        step = np.arange(len(phrase)) - np.repeat(np.cumsum(n) - n, n)
        at = self.at[phrase] + step
        hashes = [common.signed(common.mix(f.ranges(p, at, at + self.window))) for f, p in ((common.FIRST, self.one), (common.SECOND, self.two))]
        return phrase, self.start[phrase] + step, *hashes


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Parse]]:
    """Ids, tags and phrases of slices of (doc_id, tag, text)."""
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE_BYTES):
            texts = [t or b"" for t in common.texts_as_bytes(batch.column("text")).to_pylist()]
            yield batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy(), Parse(texts)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


@common.lean
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor once per slice, with its least and greatest id."""
    for ids, _, p in _parsed(batches):
        order = np.lexsort((ids[p.text], p.anchor))
        anchor, doc = p.anchor[order], ids[p.text[order]]
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else np.zeros(0, dtype=np.int64)
        tail = np.append(head[1:], len(anchor)) - 1 if len(anchor) else head
        yield _batch(anchor=anchor[head], low=doc[head], high=doc[tail])


def _place(anchor: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One long for a phrase in a document."""
    u = [x.astype(np.int64).view(np.uint64) for x in (anchor, digest, doc)]
    return common.signed(common.mix(u[0] ^ common.mix(u[1] + common.mix(u[2] + _OTHER))))


def _shared(a: bytes, b: bytes) -> int:
    """Bytes of the words (8 bytes each) that two sequences have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // 8
    while low < high:
        mid = (low + high + 1) // 2
        if a[: 8 * mid] == b[: 8 * mid]:
            low = mid
        else:
            high = mid - 1
    return 8 * low


def _copied(rows: list[tuple], size: int) -> tuple[list[tuple], list[int]]:
    """The suffixes (document, row number, place) in order and what each has in common with the one before, by sorting their bytes."""
    suffixes = sorted((w[at:], doc, i, at) for i, (doc, w) in enumerate(rows) for at in range(0, len(w) - size + 1, 8))
    return [x[1:] for x in suffixes], [0, *(_shared(suffixes[k - 1][0], suffixes[k][0]) for k in range(1, len(suffixes)))]


def _ranked(rows: list[tuple], size: int) -> tuple[list[tuple], list[int]]:
    """The same without copies of the suffixes, whose bytes grow with the square of a row: by ranks of their first 1, 2, 4, ... words."""
    count = np.array([len(w) // 8 for _, w in rows])
    row = np.repeat(np.arange(len(rows)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(row))  # words to the row's end
    rank = np.unique(np.frombuffer(b"".join(w for _, w in rows), dtype=">u8").astype(np.uint64), return_inverse=True)[1].astype(np.int32) + np.int32(1)
    ranks, n = [rank], 1
    while n < count.max(initial=0):
        after = np.zeros(len(rank), dtype=np.int64)  # nothing is less than any word
        after[:-n][left[:-n] > n] = rank[n:][left[:-n] > n]
        rank = np.unique(rank.astype(np.int64) << 32 | after, return_inverse=True)[1].astype(np.int32) + np.int32(1)
        ranks.append(rank)
        n *= 2
    doc = np.array([d for d, _ in rows], dtype=np.int64)
    at = np.flatnonzero(left >= size // 8)
    at = at[np.lexsort((at, doc[row[at]], rank[at]))]
    x, y = at[:-1].copy(), at[1:].copy()
    room = np.minimum(left[x], left[y])
    shared = np.zeros(len(x), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        fits = np.flatnonzero(shared + (1 << k) <= room)
        fits = fits[ranks[k][x[fits] + shared[fits]] == ranks[k][y[fits] + shared[fits]]]
        shared[fits] += 1 << k
    place = (count[row[at]] - left[at]) * 8
    return list(zip(doc[row[at]].tolist(), row[at].tolist(), place.tolist(), strict=True)), [0, *(8 * shared).tolist()]


def longest(rows: list[tuple], window: int = WINDOW) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For the suffixes (row number, place in bytes) of ``window`` words or more: length of the longest match with a row of an earlier document, that row, place there.

    All suffixes are sorted. The longest match of one is with the nearest one, on either side, of an earlier document; a stack of
    ascending documents finds these, with the least common beginning on the way.
    """
    size = 8 * window
    suffixes, lcp = (_copied if sum(len(w) ** 2 for _, w in rows) <= COPIED else _ranked)(rows, size)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for order, step in ((range(len(suffixes)), 0), (range(len(suffixes) - 1, -1, -1), 1)):
        stack: list[tuple[int, int, int]] = []  # document, suffix, common beginning with the one below
        for k in order:
            doc, i, at = suffixes[k]
            near = lcp[k + step] if k + step < len(suffixes) else 0
            while stack and stack[-1][0] >= doc:
                near = min(near, stack.pop()[2])
            if stack and near >= size and near > best.get((i, at), (0,))[0]:
                _, j, there = suffixes[stack[-1][1]]
                best[i, at] = (near, j, there)
            stack.append((doc, k, near))
    return best


def factored(rows: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Factors (row number, place, length, source row, place there) of the rows (doc_id, words as bytes) of one block.

    Rows of one document are no sources for each other.
    """
    size, out = 8 * window, []
    best = longest(rows, window)
    if not best:
        return out
    for i, (_, mine) in enumerate(rows):
        at = 0
        while at + size <= len(mine):
            n, j, there = best.get((i, at), (0, 0, 0))
            if n:
                out.append((i, at // 8, n // 8, j, there // 8))
                at += n - size  # the windows across its end are looked up next
            at += 8
    return out


@common.lean
def _factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, doc_id, tag, start, words) sorted by anchor and doc_id -> factors."""

    def parsed(block: list[tuple]) -> None:
        for i, at, n, j, there in factored([(doc, words) for doc, _, _, words in block]):
            doc, tag, start, _ = block[i]
            made.append((doc, tag, start + at, n, block[j][0], block[j][2] + there))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "tag", "start", "length", "from_doc", "from_word"])

    made: list[tuple] = []
    anchor, block = None, []
    for b in batches:
        for key, *row in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "tag", "start", "words")), strict=True):
            if key != anchor:
                if len(block) > 1:
                    parsed(block)
                anchor, block = key, []
            block.append(row)
        if made:
            yield batch()
            made = []
    if len(block) > 1:
        parsed(block)
    yield batch()


FACTORS = "doc_id long, tag int, start int, length int, from_doc long, from_word int"


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, length, from_doc, from_word): factors of (doc_id long, tag int, text) of ``WINDOW`` words or more that earlier documents have; they may overlap.

    from_word is null where just the phrase's hash has been looked up.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.where("doc_id is not null")
    repeated = docs.mapInArrow(_anchors, "anchor long, low long, high long").groupBy("anchor").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    seen = sc.broadcast(common.membership_bitmap(repeated, "anchor"))

    @common.lean
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, p in _parsed(batches):
            k = np.flatnonzero(common.bitmap_has(seen.value, p.anchor))
            yield _batch(anchor=p.anchor[k], digest=p.digest[k], doc_id=ids[p.text[k]], tag=tags[p.text[k]], start=p.start[k].astype(np.int32), n=p.count[k].astype(np.int32))

    found = common.stored(docs.mapInArrow(phrases, "anchor long, digest long, doc_id long, tag int, start int, n int"))
    variants = common.stored(found.groupBy("anchor", "digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    copied = variants.where("first < last").select("anchor", "digest", "first")
    whole = found.join(copied, ["anchor", "digest"]).where("doc_id > first")
    whole = common.stored(whole.select("doc_id", "tag", "start", (F.col("n") + (WINDOW - 1)).alias("length"), F.col("first").alias("from_doc"), F.lit(None).cast("int").alias("from_word")))
    common.discard(found)

    several = variants.groupBy("anchor").agg(F.count("*").alias("c"), F.min("first").alias("a"), F.max("first").alias("b")).where("c > 1 and a < b").select("anchor", "c")
    several = common.stored(several)
    boundary = variants.join(several.select("anchor"), "anchor", "left_semi")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(place=_place(*(b.column(c).to_numpy() for c in ("anchor", "digest", "first"))))

    inside = sc.broadcast(common.membership_bitmap(boundary.mapInArrow(place, "place long"), "place"))
    large = sc.broadcast(common.membership_bitmap(several.where(F.col("c") > BLOCK), "anchor"))
    common.discard(variants, several)

    def chosen(p: Parse, ids: np.ndarray, split: bool) -> np.ndarray:
        """Phrases that take part in a block with others: of the large blocks, or of the others."""
        k = np.flatnonzero(common.bitmap_has(seen.value, p.anchor))
        k = k[common.bitmap_has(large.value, p.anchor[k]) == split]
        return k[common.bitmap_has(inside.value, _place(p.anchor[k], p.digest[k], ids[p.text[k]]))]

    @common.lean
    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, p in _parsed(batches):
            k = chosen(p, ids, False)
            words = [p.words[a : a + n].tobytes() for a, n in zip(p.at[k].tolist(), (p.count[k] + WINDOW - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(p.anchor[k]), "doc_id": pa.array(ids[p.text[k]]), "tag": pa.array(tags[p.text[k]]), "start": pa.array(p.start[k].astype(np.int32)), "words": pa.array(words, pa.binary())})

    @common.lean
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tags, p in _parsed(batches):
            phrase, start, one, two = p.windows(chosen(p, ids, True))
            yield _batch(one=one, two=two, doc_id=ids[p.text[phrase]], tag=tags[p.text[phrase]], start=start.astype(np.int32))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = docs.mapInArrow(references, "anchor long, doc_id long, tag int, start int, words binary").repartition(n, "anchor")
    inner = common.stored(blocks.sortWithinPartitions("anchor", "doc_id", "tag", "start").mapInArrow(_factored, FACTORS))
    out = whole.unionByName(inner)
    if not large.value.any():
        for handle in (seen, inside, large):
            handle.destroy()
        return out
    checked = common.stored(docs.mapInArrow(windows, "one long, two long, doc_id long, tag int, start int"))
    for handle in (seen, inside, large):
        handle.destroy()
    earliest = checked.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("doc_id").alias("last")).where("first.doc_id < last").select("one", "two", "first")
    single = checked.join(earliest, ["one", "two"]).where("doc_id > first.doc_id")
    return out.unionByName(single.select("doc_id", "tag", "start", F.lit(WINDOW).alias("length"), F.col("first.doc_id").alias("from_doc"), F.col("first.start").alias("from_word")))


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside the spans (start, length)."""
    out, at = [], 0
    for start, length in sorted(spans):
        if start > at:
            out += words[at:start]
        at = max(at, start + length)
    return out + words[at:]


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words of every row of (doc_id, text), joined by single spaces."""
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tag"), "text")
    spans = factors(rows).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = common.stored(spans)
    common.release(spark)
    touched = spark.sparkContext.broadcast(common.membership_bitmap(spans.select(F.xxhash64("doc_id", "tag").alias("k")), "k"))
    schema = "doc_id long, n_words long, n_removed long, kept string"

    def affected(b: pa.RecordBatch, want: bool) -> pa.RecordBatch:
        return b.filter(pa.array(common.bitmap_has(touched.value, b.column("k").to_numpy()) == want))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield affected(b, True)

    @common.lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, "text", SLICE_BYTES * 4):
                total, gone, kept = [], [], []
                spans_ = b.column("spans").to_pylist() if "spans" in b.schema.names else [None] * b.num_rows
                for t, s in zip(common.texts_as_bytes(b.column("text")).to_pylist(), spans_, strict=True):
                    words = t.split() if t else []
                    left = _kept(words, [(x["start"], x["length"]) for x in s]) if s else words
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(affected(b, False) for b in batches)  # in one Python worker, without a shuffle

    keyed = rows.withColumn("k", F.xxhash64("doc_id", "tag"))
    hit = keyed.mapInArrow(moved, keyed.schema).join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    return keyed.mapInArrow(stay, schema).unionByName(hit.mapInArrow(cut, schema))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of earlier documents cover, and a digest of what is left."""
    out = removed(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (s) WHERE doc_id > first),
k AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

QUERIES = {"op3_substrings": op3_substrings}
ORACLES = {"op3_substrings": ORACLE_SQL}
