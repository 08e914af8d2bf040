"""Language-model scores by a probabilistic suffix tree over words.

A text is read as its lower-cased words and one end token; ``DEPTH`` end tokens stand before it. The root of the tree is the
base model, a word unigram with add-one smoothing. A context of up to ``DEPTH`` words is a state if its parent (the context
without its oldest word) is one and its next-word distribution gains ``DIVERGENCE`` nats over the parent's for each word that it
keeps, summed over the context's own occurrences. A state's distribution keeps the next words that follow it ``LEAST_PAIR`` times
or more in training and is smoothed by its parent's, with the weight of what was not kept and of the number of words kept. A word
is scored in the state that is the longest suffix of what stands before it.

Both floors are counts, not shares, so the tree grows with the training texts. It is never gathered: counts, probabilities and
states are tables, made depth by depth; a depth is counted only where its shorter pairs may repeat, in the pass that describes the
pairs of the depth before. As a pair's shorter pairs occur at least as often, its parent's probability is found by one join. The
score of a text is a sum of one value a key over its words, contexts and pairs: a pair's value is what its state gains over the
parent and the parent's weight. As a state's parents are states, keys of a depth are looked up only where those of the depth before
were there. The most frequent keys (at most ``HEAD_WORDS`` words and ``HEAD_KEYS`` contexts and pairs) are looked up in place; the
rest of each document's keys are joined to their values. All counts are exact, so results do not depend on partitions. Words and
contexts are told apart by 64-bit hashes.

Defined cases: a null or empty text is just the end token; a text of any length is read whole; a row with a null id is neither
trained on nor held out (its held_out is null); without training texts N and V are 0 and every token counts as unseen; an empty
table gives an empty result; each input row gives one row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm import common, lookup

DEPTH = 2
LEAST_PAIR, DIVERGENCE = 3, 6.0
HEAD_WORDS, HEAD_KEYS = 100_000, 100_000
SLICE_BYTES = 1 << 20
#: Tokens of a chunk whose words and pairs are counted before they are shuffled.
CHUNK = 600_000
#: Keys outside the head that are gathered before they are dealt out.
ASKED = 600_000
#: Described pairs that a task gathers before they are dealt out.
DESCRIBED = 1_000_000
#: A state's key among the looked-up ones is its context's key with these bits turned, as pairs and words have the plain ones.
STATE_BITS = 0x2545F4914F6CDD1D
#: Key of the end token among the word hashes.
END_KEY = 0x5EED


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' tokens end to end, each text after DEPTH end tokens; and where each text begins (one more at the end)."""
    data, starts, ends, first = common.split_words([(t or b"").lower() for t in texts])
    words = common.word_hashes(data, starts, ends, common.FIRST)
    n = np.diff(first)
    begin = np.append(0, np.cumsum(n + DEPTH + 1))
    out = np.full(int(begin[-1]), END_KEY, dtype=np.uint64)
    owner = np.repeat(np.arange(len(texts)), n)
    out[np.arange(len(words)) + DEPTH + owner * (DEPTH + 1)] = words
    return out, begin


class Grams:
    """Contexts and pairs of a run of tokens at its scored positions, as keys by depth; a context has the key of the pair that it is."""

    def __init__(self, tokens: np.ndarray, begin: np.ndarray):
        scored = np.ones(len(tokens), dtype=bool)
        scored[(begin[:-1, None] + np.arange(DEPTH)).ravel()] = False
        self.tokens, self.prefix, self.begin = tokens, common.SECOND.prefix(tokens), begin
        self.at = np.flatnonzero(scored)

    @property
    def text(self) -> np.ndarray:
        """Number of the text of each scored position."""
        return np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin) - DEPTH)

    def opening(self, at: np.ndarray) -> np.ndarray:
        """Whether a position is a text's first scored one."""
        out = np.zeros(len(self.tokens), dtype=bool)
        out[self.begin[:-1] + DEPTH] = True
        return out[at]

    def context(self, depth: int, at: np.ndarray | None = None) -> np.ndarray:
        """Key of the ``depth`` words before each position; none at depth 0."""
        at = self.at if at is None else at
        return self.pair(depth - 1, at - 1) if depth else np.zeros(len(at), dtype=np.int64)

    def state(self, depth: int, at: np.ndarray | None = None) -> np.ndarray:
        """Key under which the state of the ``depth`` words before each position is looked up."""
        return self.context(depth, at) ^ np.int64(STATE_BITS)

    def pair(self, depth: int, at: np.ndarray | None = None) -> np.ndarray:
        """Key of the word at each position after the context of this depth; depth 0: of the word alone."""
        at = self.at if at is None else at
        return common.signed(common.mix(common.SECOND.ranges(self.prefix, at - depth, at + 1) + np.uint64(depth)) if depth else self.tokens[at])


def opening_contexts() -> list[int]:
    """Keys of the contexts of end tokens only, from depth 2 on."""
    g = Grams(*tokens_of([None]))
    return [int(g.context(d)[0]) for d in range(2, DEPTH + 1)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Grams]]:
    held: list[Grams] = []
    size = 0
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE_BYTES):
            held.append(Grams(*tokens_of(common.texts_as_bytes(batch.column("text")).to_pylist())))
            size += len(held[-1].tokens)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


#: What a pair's probability depends on: its context, and the pair of the next lower depth (at depth 1 the word).
PAIR_COLUMNS = ["context", "parent"]
GRAM_SCHEMA = "d int, key long, n long, " + ", ".join(f"{c} long" for c in PAIR_COLUMNS)
#: A sorted run of keys of one bucket (a range of keys): packed keys, their counts, and, one after the other, PAIR_COLUMNS or nothing.
RUN_SCHEMA = "d int, bucket int, keys binary, n binary, columns binary"


def _run_rows(d: int, keys: np.ndarray, n: np.ndarray, columns: list[np.ndarray], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of RUN_SCHEMA of sorted unsigned keys, some at a time."""
    every = lookup.cut(keys, n_buckets)
    small = n.max(initial=0) < 256
    for at in range(0, len(every), 32):
        cuts = every[at : at + 32]
        yield _run_batch(d, keys, n, columns, cuts, small)


def _run_batch(d: int, keys: np.ndarray, n: np.ndarray, columns: list[np.ndarray], cuts: list, small: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "d": pa.array([d] * len(cuts), pa.int32()),
            "bucket": pa.array([x for x, _, _ in cuts], pa.int32()),
            "keys": pa.array([common.packed(keys[a:b]) for _, a, b in cuts], pa.binary()),
            "n": pa.array([n[a:b].astype(np.uint8 if small else np.int64).tobytes() for _, a, b in cuts], pa.binary()),
            "columns": pa.array([b"".join(c[a:b].tobytes() for c in columns) for _, a, b in cuts], pa.binary()),
        }
    )


def _grams(depth: int, n_buckets: int, handle=None):
    """Runs, each key once a chunk: the counts of the pairs of ``depth`` (at 1 those of words as well), and the counts and PAIR_COLUMNS of the pairs of the depth before, each once a task.

    ``handle`` is a map of the pairs of the depth before that occur ``LEAST_PAIR`` times; these are described. Pairs of
    ``depth`` are left out whose own shorter pair or whose context surely occurs less: a longer pair never occurs more often than
    its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        met = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.int64)] * len(PAIR_COLUMNS)]  # keys, counts, columns
        before = depth - 1
        for parts in _chunks(batches):
            if depth == 1:
                for d in (0, 1):
                    keys, n = np.unique(np.concatenate([g.pair(d) for g in parts]).view(np.uint64), return_counts=True)
                    yield from _run_rows(d, keys, n, [], n_buckets)
                continue
            described, found = [], []
            for g in parts:
                keys = g.pair(before)
                hit = np.flatnonzero(common.bitmap_has(handle.value, keys))
                at = g.at[hit]
                described.append((keys[hit], g.context(before, at), g.pair(before - 1, at)))
                if depth <= DEPTH:
                    ok = g.opening(at) | common.bitmap_has(handle.value, g.context(depth, at))
                    found.append(g.pair(depth, at[ok]))
            if depth <= DEPTH:
                keys, n = np.unique(np.concatenate(found).view(np.uint64), return_counts=True)
                yield from _run_rows(depth, keys, n, [], n_buckets)
            columns = [np.concatenate(x) for x in zip(*described, strict=True)]
            del described, found
            keys, first, n = np.unique(columns[0].view(np.uint64), return_index=True, return_counts=True)
            both = [np.concatenate(x) for x in zip(met, [keys, n, *(x[first] for x in columns[1:])], strict=True)]
            keys, first, of = np.unique(both[0], return_index=True, return_inverse=True)
            met = [keys, np.bincount(of, weights=both[1], minlength=len(keys)).astype(np.int64), *(x[first] for x in both[2:])]
            del columns, both
            if len(keys) >= DESCRIBED:
                yield from _run_rows(before, met[0], met[1], met[2:], n_buckets)
                met = [x[:0] for x in met]
        if len(met[0]):
            yield from _run_rows(before, met[0], met[1], met[2:], n_buckets)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs dealt out by bucket -> rows of GRAM_SCHEMA with sums of at least ``LEAST_PAIR`` (of words: all)."""
    held: dict[tuple, list] = {}
    common.returned()
    for batch in batches:
        for d, bucket, keys, n, columns in zip(*(batch.column(c).to_pylist() for c in ("d", "bucket", "keys", "n", "columns")), strict=True):
            held.setdefault((d, bucket), []).append((keys, n, columns))
    while held:
        (d, _), runs = held.popitem()
        keys = [common.unpacked(k) for k, _, _ in runs]
        n = np.concatenate([np.frombuffer(n, dtype=np.uint8 if len(n) == len(k) else np.int64).astype(np.int64) for k, (_, n, _) in zip(keys, runs, strict=True)])
        every = np.concatenate(keys)
        order = np.argsort(every)
        every = every[order]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        total = np.add.reduceat(n[order], head)
        keep = total >= (LEAST_PAIR if d else 1)
        head = head[keep]
        made = {"d": pa.array(np.full(len(head), d, dtype=np.int32)), "key": pa.array(common.signed(every[head])), "n": pa.array(total[keep])}
        described = [np.frombuffer(c, dtype=np.int64).reshape(len(PAIR_COLUMNS), -1) for _, _, c in runs if c]
        if described:
            made |= {c: pa.array(np.concatenate(x)[order[head]]) for c, x in zip(PAIR_COLUMNS, zip(*described, strict=True), strict=True)}
        else:
            made |= dict.fromkeys(PAIR_COLUMNS, pa.nulls(len(head), pa.int64()))
        yield pa.RecordBatch.from_pydict(made)
    common.returned()


@dataclass
class Tree:
    """Sorted tables: words with the gain log10(c + 1); states with the log10 weight of the parent; pairs with log10 P."""

    words: np.ndarray
    gain: np.ndarray
    states: np.ndarray
    weight: np.ndarray
    pairs: np.ndarray
    logp: np.ndarray


def _grown(pairs: list[DataFrame], words: DataFrame, root: float) -> DataFrame:
    """(state, key, n, logp, value): states with the log10 weight of their parent, and their pairs with the log10 probability; parents first.

    ``pairs`` are the stored tables of _merged by depth, from the one that describes depth 1; those no longer needed are deleted.
    """
    described = [p.where(F.col("context").isNotNull()).select("key", "n", *PAIR_COLUMNS) for p in pairs]
    spark = words.sparkSession
    # a pair's parent has the context's parent for its context
    below = words.select(F.col("key").alias("parent"), ((F.col("n") + 1) / root).alias("m"), F.lit(0).cast("long").alias("above"))
    seen = words.select(F.col("key").alias("context"), "n")
    texts = words.where(F.col("key") == END_KEY).select(F.explode(F.array(*map(F.lit, opening_contexts())).cast("array<long>")).alias("context"), "n")
    out, parents = [], None
    for d, g in enumerate(described, 1):
        seen = seen if d == 1 else described[d - 2].select(F.col("key").alias("context"), "n").unionByName(texts)
        of = Window.partitionBy("context")
        g = g.join(below, "parent").select("key", "n", "context", "above", "m").join(seen.withColumnRenamed("n", "seen"), "context")
        g = g.withColumns({"kept": F.sum("n").over(of), "number": F.count("*").over(of)})
        g = g.withColumn("count", F.greatest("kept", "seen")).withColumn("beta", F.col("number") + F.col("count") - F.col("kept"))
        g = g.withColumns({"p": (F.col("n") + F.col("beta") * F.col("m")) / (F.col("kept") + F.col("beta")), "rest": F.col("beta") / (F.col("kept") + F.col("beta"))})
        g = looked = common.stored(g.select("context", "above", "key", "n", "count", "number", "m", "p", "rest"))
        if d > 1:
            common.discard(pairs[d - 2])
        gain = F.sum(F.col("p") * F.log(F.col("p") / F.col("m"))) + F.greatest(1 - F.sum("p"), F.lit(1e-12)) * F.log(F.greatest(F.max("rest"), F.lit(1e-12)))
        states = g.groupBy("context").agg(F.max("count").alias("n"), F.max("number").alias("number"), F.max("rest").alias("rest"), F.max("above").alias("above"), gain.alias("gain")).where(F.col("n") * F.col("gain") >= DIVERGENCE * F.col("number"))
        if parents is not None:
            states = states.join(parents, "above", "left_semi")
        states = common.stored(states.select(F.col("context").alias("key"), "n", F.log10("rest").alias("value")))
        parents = states.select(F.col("key").alias("above"))
        g = g.select("context", "key", "n", "m", "p").join(states.select(F.col("key").alias("context"), F.col("value").alias("weight")), "context", "left")
        g = common.stored(g.select("context", "key", "n", F.when(F.col("weight").isNull(), F.col("m")).otherwise(F.col("p")).alias("p"), (F.log10("p") - F.log10("m") - F.col("weight")).alias("value")))
        out.append(states.select(F.lit(True).alias("state"), F.col("key").bitwiseXOR(F.lit(STATE_BITS)).alias("key"), "n", F.lit(None).cast("double").alias("logp"), "value"))
        out.append(g.where("value is not null").select(F.lit(False).alias("state"), "key", "n", F.log10("p").alias("logp"), "value"))
        below = g.select(F.col("key").alias("parent"), F.col("p").alias("m"), F.col("context").alias("above"))
        common.discard(looked)
    common.discard(pairs[-1])
    return reduce(DataFrame.unionByName, out)


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """The table of _grown of the training rows; (key, n) of their tokens; N and V."""
    spark = docs.sparkSession
    common.prepare(spark)
    n, pairs, handle = lookup.dealt(spark), [], None
    for depth in range(1, DEPTH + 2):
        rows = common.stored(docs.select("text").mapInArrow(_grams(depth, 3 * n, handle), RUN_SCHEMA).repartition(n, "bucket").mapInArrow(_merged, GRAM_SCHEMA))
        if handle is not None:
            handle.destroy()
        if depth == 1:
            tokens = rows.where("d = 0").select("key", "n")
        else:
            pairs.append(rows)
        if depth <= DEPTH:
            handle = spark.sparkContext.broadcast(common.membership_bitmap(rows.where((F.col("d") == depth) & F.col("context").isNull()), "key"))
    total, distinct = (int(x or 0) for x in tokens.agg(F.sum("n"), F.count("*")).first())
    return _grown(pairs, tokens, float(total + distinct + 1)), tokens, total, distinct


def train(docs: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Tree, DataFrame, int, int, float]:
    """The tree of a small corpus gathered, to look at; (key, n) of its tokens; N, V; and the count class from which words are in the tree."""
    grown, tokens, total, distinct = tables(docs)
    words, counts, least = lookup.most_frequent(tokens, head_words)

    def sorted_(rows: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
        got = rows.select("key", value).orderBy("key").toArrow()
        return got.column("key").to_numpy(), got.column(value).to_numpy()

    return Tree(words, np.log10(counts + 1.0), *sorted_(grown.where("state"), "value"), *sorted_(grown.where("not state"), "logp")), tokens, total, distinct, least


@dataclass
class Head:
    """Keys looked up in place, with their values: words with log10(c + 1), contexts and pairs; and the map of the other contexts and pairs."""

    words: lookup.Lookup
    keys: lookup.Lookup
    others: np.ndarray


def _scored(head: Head, texts: list[bytes | None], root: float) -> tuple[np.ndarray, ...]:
    """By text: tokens, known tokens, base and score but for the keys outside the head; those keys and where each text's begin."""
    tokens, begin = tokens_of(texts)
    g, n = Grams(tokens, begin), len(texts)
    words = g.pair(0)
    known, gain = head.words.find(words)
    base = gain - root
    text = g.text
    value, keys, owner = base.copy(), [words[~known]], [text[~known]]

    def add(places: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Add the values of keys at these places; the places whose key is there, or may be in the tables."""
        there, v = head.keys.find(k)
        value[places] += v
        rest = np.flatnonzero(~there)
        rest = rest[common.bitmap_has(head.others, k[rest])]
        keys.append(k[rest])
        owner.append(text[places[rest]])
        there[rest] = True
        return places[there]

    inside = paired = np.arange(len(g.at))  # positions in a state of the depth before; those whose word it keeps
    for d in range(1, DEPTH + 1):
        inside = add(inside, g.state(d, g.at[inside]))
        paired = paired[np.isin(paired, inside, assume_unique=True)] if len(inside) < len(g.at) else paired
        paired = add(paired, g.pair(d, g.at[paired]))
    total = [np.bincount(text, weights=x, minlength=n) for x in (base, value)]
    of = np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(n + 1))
    return np.diff(begin) - DEPTH, np.bincount(text[known], minlength=n), *total, np.concatenate(keys)[order], bounds


def score(docs: DataFrame, training: DataFrame, head_words: int = HEAD_WORDS, head_keys: int = HEAD_KEYS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learned from the rows of training."""
    spark = docs.sparkSession
    grown, tokens, total, distinct = tables(training)
    words, counts, least = lookup.most_frequent(tokens, head_words)
    keys, values, least_key = lookup.most_frequent(grown, head_keys, "value")

    def tail(x: DataFrame, above: float) -> DataFrame:
        return x.where(F.floor(F.log2("n") * 4) < above)

    others = common.membership_bitmap(tail(grown, least_key), "key")
    handle = spark.sparkContext.broadcast(Head(lookup.Lookup.of(words, np.log10(counts + 1.0)), lookup.Lookup.of(keys, values.astype(float)), others))
    complete = len(words) == distinct and not others.any()
    root = float(np.log10(total + distinct + 1.0))

    kind, n = docs.schema["doc_id"].dataType.simpleString(), lookup.dealt(spark)
    sums = {"n_tokens": "long", "n_known": "long", "base_score": "double", "score": "double"}
    schema = f"row long, doc_id {kind}, " + ", ".join(f"{c} {t}" for c, t in sums.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        head = handle.value
        row, held, size = TaskContext.get().partitionId() << 40, [], 0
        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                texts = common.texts_as_bytes(batch.column("text")).to_pylist()
                n_tokens, known, base, value, keys, bounds = _scored(head, texts, root)
                rows = row + np.arange(len(texts))
                row += len(texts)
                none = pa.nulls(len(texts), pa.binary())
                made = {"row": pa.array(rows), "doc_id": batch.column("doc_id"), "n_tokens": pa.array(n_tokens), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(value)}
                yield pa.RecordBatch.from_pydict(made if complete else made | {"bucket": pa.array(lookup.home(rows, 3 * n)), "keys": none, "columns": none})
                if not complete:
                    held.append((keys.view(np.uint64), np.repeat(rows, np.diff(bounds))))
                    size += len(keys)
                    if size >= ASKED:
                        yield _asked(held, 3 * n, batch.column("doc_id").type)
                        held, size = [], 0
        if size:
            yield _asked(held, 3 * n, batch.column("doc_id").type)

    rows = docs.select("doc_id", "text")
    if complete:
        rows = rows.mapInArrow(run, schema)
    else:
        gain = F.log10(F.col("n") + 1.0)
        worth = tail(tokens, least).select("key", gain.alias("b"), gain.alias("s"), F.lit(True).alias("word"))
        worth = worth.unionByName(tail(grown, least_key).select("key", F.lit(0.0).alias("b"), F.col("value").alias("s"), F.lit(False).alias("word")))
        asked = rows.mapInArrow(run, f"{schema}, bucket int, keys binary, columns binary")
        known = worth.mapInArrow(_known(3 * n, asked.schema), asked.schema)
        answered = asked.unionByName(known).repartition(n, "bucket").mapInArrow(_answered(3 * n), asked.schema)
        rows = answered.repartition(n, "bucket").mapInArrow(_totals, schema)
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _rows(row, doc_id: pa.Array, sums: list, bucket, keys: list, columns: list) -> pa.RecordBatch:
    names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "bucket", "keys", "columns"]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), doc_id, *sums, pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(columns, pa.binary())], names=names)


def _asked(held: list, n_buckets: int, kind: pa.DataType) -> pa.RecordBatch:
    """Keys that rows look for, a run a bucket; row: the least one of the run; columns: each key's row from there."""
    keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, rows = keys[order], rows[order]
    cuts, first = lookup.cut(keys, n_buckets), int(rows.min()) if len(rows) else 0
    none = [pa.nulls(len(cuts), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    return _rows([first] * len(cuts), pa.nulls(len(cuts), kind), none, [c for c, _, _ in cuts], [common.packed(keys[a:b]) for _, a, b in cuts], [_small(rows[a:b] - first) for _, a, b in cuts])


def _small(rows: np.ndarray) -> bytes:
    """Rows in two bytes each if they fit, else in four; the first byte tells."""
    kind = np.uint16 if rows.max(initial=0) < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + rows.astype(kind).tobytes()


def _known(n_buckets: int, schema):
    """Rows (key, b, s, word) of the tables as runs of their values; row: null."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, b, s, word = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            order = np.argsort(keys.view(np.uint64))
            keys, b, s, word = keys.view(np.uint64)[order], b[order], s[order], word[order]
            cuts = lookup.cut(keys, n_buckets)
            none = [pa.nulls(len(cuts), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield _rows([None] * len(cuts), pa.nulls(len(cuts), kind), none, [c for c, _, _ in cuts], [common.packed(keys[x:y]) for _, x, y in cuts], [b[x:y].tobytes() + s[x:y].tobytes() + word[x:y].tobytes() for _, x, y in cuts])

    return run


def _answered(n_buckets: int):
    """Runs dealt out by bucket -> what their keys add to each row: runs of rows by home, each with base, score and known tokens; rows of documents pass through."""

    def values(parts: list) -> tuple[np.ndarray, ...]:
        keys, b, s, word = (np.concatenate(x) for x in zip(*((k, np.frombuffer(c, count=len(k)), np.frombuffer(c, count=len(k), offset=8 * len(k)), np.frombuffer(c, dtype=bool, offset=16 * len(k))) for k, c in parts), strict=True))
        order = np.argsort(keys)
        return keys[order], b[order], s[order], word[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        tables_, asked = {}, {}
        kind = None
        for batch in batches:
            kind = batch.column("doc_id").type
            plain = batch.filter(pa.compute.is_null(batch.column("keys")))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns, names=plain.schema.names)
            runs = batch.filter(pa.compute.is_valid(batch.column("keys")))
            for row, bucket, keys, columns in zip(*(runs.column(c).to_pylist() for c in ("row", "bucket", "keys", "columns")), strict=True):
                (tables_ if row is None else asked).setdefault(bucket, []).append((row, keys, columns))
        found = []
        while asked:
            bucket, wanted = asked.popitem()
            parts = [(common.unpacked(k), c) for _, k, c in tables_.pop(bucket, [])]
            if not parts:
                continue
            keys, b, s, word = values(parts)
            for first, k, c in wanted:
                at, there = lookup.find(keys, common.unpacked(k))
                found.append(lookup.summed(np.frombuffer(c, dtype=f"u{c[0]}", offset=1).astype(np.int64)[there] + first, b[at[there]], s[at[there]], word[at[there]]))
            if sum(len(x[0]) for x in found) > 1 << 20:
                found = [lookup.summed(*(np.concatenate(x) for x in zip(*found, strict=True)))]
        if not found:
            return
        rows, b, s, k = lookup.summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        home = lookup.home(rows, n_buckets)
        order = np.argsort(home, kind="stable")
        rows, b, s, k, home = (x[order] for x in (rows, b, s, k, home))
        head = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
        for x, y in zip(head, [*head[1:], len(home)], strict=True):
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield _rows([None], pa.nulls(1, kind), none, [int(home[x])], [common.packed(rows[x:y].view(np.uint64))], [b[x:y].tobytes() + s[x:y].tobytes() + k[x:y].astype(np.uint32).tobytes()])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and runs of answers dealt out by home -> the documents with their answers added."""
    common.returned()
    documents, answers = [], []
    for batch in batches:
        plain = batch.filter(pa.compute.is_null(batch.column("keys")))
        if plain.num_rows:
            documents.append(plain)
        runs = batch.filter(pa.compute.is_valid(batch.column("keys")))
        for keys, c in zip(*(runs.column(x).to_pylist() for x in ("keys", "columns")), strict=True):
            rows = common.unpacked(keys)
            n = len(rows)
            answers.append((rows.view(np.int64), np.frombuffer(c, count=n), np.frombuffer(c, count=n, offset=8 * n), np.frombuffer(c, dtype=np.uint32, offset=16 * n)))
    rows, b, s, k = lookup.summed(*(np.concatenate(x) for x in zip(*answers, strict=True))) if answers else (np.zeros(0, dtype=np.int64), *[np.zeros(0)] * 3)
    for batch in documents:
        at, there = lookup.find(rows, batch.column("row").to_numpy())
        more = [np.where(there, x[at], 0) if len(rows) else np.zeros(batch.num_rows) for x in (k, b, s)]
        columns = {c: batch.column(c) for c in ("row", "doc_id", "n_tokens")}
        columns |= {c: pa.array(batch.column(c).to_numpy() + x.astype(batch.column(c).to_numpy().dtype)) for c, x in zip(("n_known", "base_score", "score"), more, strict=True)}
        yield pa.RecordBatch.from_pydict(columns)


def op8_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from six sevenths of the ids."""
    docs = common.documents(spark, sf_dir)
    fold = common.train_split(F.col("doc_id"), 7)
    out = score(docs, docs.where(fold != 2))
    return out.select("doc_id", (fold == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_score": op8_score}
ORACLES: dict[str, str] = {}
