"""Token counts without ids: pieces are counted once per distinct pre-token and joined to the frequencies of every document.

Pre-tokens do not hold white space, so a word between white space is a sequence of whole pre-tokens. One table is made of all distinct
words of all texts: each word once, with its pieces, which are those of its pre-tokens, each distinct one of a range of words being
counted once. Every document's words are then joined to that table and summed. The most frequent words (at most ``HEAD``) are looked
up in place; the others of each task are dealt out by key range in packed runs, meet the table there and return as sums. Words are
told apart by 64-bit hashes; the table grows with the texts and is never gathered.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a text of any length and in any script is counted whole; an empty
table gives an empty result; every input row gives one row, repeated rows and null ids included; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, lookup, pretokens

#: Documents above this many tokens are marked.
LIMIT = 2048
#: Text handled at once, and text whose distinct words are gathered before they are dealt out.
SLICE_BYTES, CHUNK_BYTES = 1 << 20, 8 << 20
#: Words looked up in place, and words outside them that are gathered before they are dealt out.
HEAD, ASKED = 1_000_000, 300_000

TABLE = "key long, n long, pieces long"


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their texts: bytes of all, and start, end and key of each word, and each text's first word."""
    for whole in batches:
        for batch in common.slices(whole, "text", SLICE_BYTES):
            texts = [t or b"" for t in common.texts_as_bytes(batch.column("text")).to_pylist()]
            data, starts, ends, first = common.split_words(texts)
            yield batch, texts, data.tobytes(), starts, ends, common.word_hashes(data, starts, ends, common.FIRST), first


def _distinct(n_buckets: int):
    """Distinct words of some texts: runs (bucket, keys, n, words) of packed keys, counts, and the words with a space between."""

    def rows(held: list) -> Iterator[pa.RecordBatch]:
        keys, n, words = (np.concatenate(x) for x in zip(*held, strict=True))
        unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(of, weights=n, minlength=len(unique)).astype(np.int64)
        words = words[first]
        every = lookup.cut(unique, n_buckets)
        for at in range(0, len(every), 32):
            cuts = every[at : at + 32]
            columns = [[c for c, _, _ in cuts], [common.packed(unique[a:b]) for _, a, b in cuts], [total[a:b].tobytes() for _, a, b in cuts], [b" ".join(words[a:b]) for _, a, b in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "n", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        held, size = [], 0
        for _, _, raw, starts, ends, keys, _ in _words(batches):
            unique, first, n = np.unique(keys, return_index=True, return_counts=True)
            words = np.empty(len(unique), dtype=object)
            words[:] = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            held.append((unique, n, words))
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield from rows(held)
                held, size = [], 0
        if held:
            yield from rows(held)

    return run


def _counted(path: str):
    """Runs dealt out by bucket -> TABLE: each distinct word once, with its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        counter = pretokens.once(pretokens.PieceCounter, path)
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, keys, n, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "n", "words")), strict=True):
                held.setdefault(bucket, []).append((keys, n, words))
        while held:
            _, runs = held.popitem()
            keys = np.concatenate([common.unpacked(k) for k, _, _ in runs])
            n = np.concatenate([np.frombuffer(x, dtype=np.int64) for _, x, _ in runs])
            words = [w for _, _, text in runs for w in text.split(b" ")]
            unique, first, of = np.unique(keys, return_index=True, return_inverse=True)
            total = np.bincount(of, weights=n, minlength=len(unique)).astype(np.int64)
            pieces = counter.count([words[i].decode() for i in first.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(unique)), pa.array(total), pa.array(pieces)], names=["key", "n", "pieces"])

    return run


def word_table(docs: DataFrame, path: str) -> DataFrame:
    """(key, n, pieces) of every distinct word of the texts, stored."""
    n = lookup.dealt(docs.sparkSession)
    runs = docs.select("text").mapInArrow(_distinct(3 * n), "bucket int, keys binary, n binary, words binary").repartition(n, "bucket")
    return common.stored(runs.mapInArrow(_counted(path), TABLE))


def _run(row, doc_id: pa.Array, n_bytes: pa.Array, n_tokens: pa.Array, bucket, keys: list, columns: list) -> pa.RecordBatch:
    names = ["row", "doc_id", "n_bytes", "n_tokens", "bucket", "keys", "columns"]
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), doc_id, n_bytes, n_tokens, pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(columns, pa.binary())], names=names)


def _blank(n: int, kind: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]


def _documents(handle, complete: bool, n_buckets: int):
    """Rows of documents with what the head gives, and runs of the other words: keys; row: the least one; columns: each key's row from there."""

    def asked(held: list, kind: pa.DataType) -> pa.RecordBatch:
        keys, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(keys)
        keys, rows = keys[order], rows[order]
        cuts, first = lookup.cut(keys, n_buckets), int(rows.min()) if len(rows) else 0
        return _run([first] * len(cuts), *_blank(len(cuts), kind), [c for c, _, _ in cuts], [common.packed(keys[a:b]) for _, a, b in cuts], [(rows[a:b] - first).astype(np.uint32).tobytes() for _, a, b in cuts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        row, held, size, kind = TaskContext.get().partitionId() << 40, [], 0, pa.int64()
        for batch, texts, _, _, _, keys, first in _words(batches):
            kind = batch.column("doc_id").type
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            there, pieces = handle.value.find(common.signed(keys))
            rows = row + np.arange(len(texts))
            row += len(texts)
            total = np.bincount(owner, weights=pieces, minlength=len(texts)).astype(np.int64)
            none = [None] * len(texts)
            yield _run(rows, batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(total), lookup.home(rows, n_buckets), none, none)
            if not complete and not there.all():
                held.append((keys[~there], rows[owner[~there]]))
                size += len(held[-1][0])
                if size >= ASKED:
                    yield asked(held, kind)
                    held, size = [], 0
        if held:
            yield asked(held, kind)

    return run


def _tabled(n_buckets: int, kind: pa.DataType):
    """(key, pieces) -> runs of the table; row: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pieces = batch.column("key").to_numpy().view(np.uint64), batch.column("pieces").to_numpy()
            order = np.argsort(keys)
            keys, pieces = keys[order], pieces[order]
            cuts = lookup.cut(keys, n_buckets)
            yield _run([None] * len(cuts), *_blank(len(cuts), kind), [c for c, _, _ in cuts], [common.packed(keys[a:b]) for _, a, b in cuts], [pieces[a:b].tobytes() for _, a, b in cuts])

    return run


def _answered(n_buckets: int):
    """Runs dealt out by bucket -> runs of rows by home with the tokens that they gain; rows of documents pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.returned()
        tables, wanted, kind = {}, {}, pa.int64()
        for batch in batches:
            kind = batch.column("doc_id").type
            plain = batch.filter(pa.compute.is_null(batch.column("keys")))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays(plain.columns, names=plain.schema.names)
            runs = batch.filter(pa.compute.is_valid(batch.column("keys")))
            for row, bucket, keys, columns in zip(*(runs.column(c).to_pylist() for c in ("row", "bucket", "keys", "columns")), strict=True):
                (tables if row is None else wanted).setdefault(bucket, []).append((row, keys, columns))
        rows, gained = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        while wanted:
            bucket, asked = wanted.popitem()
            keys, pieces = (np.concatenate(x) for x in zip(*((common.unpacked(k), np.frombuffer(c, dtype=np.int64)) for _, k, c in tables.pop(bucket, [])), strict=True))
            order = np.argsort(keys)
            keys, pieces = keys[order], pieces[order]
            for first, k, c in asked:
                at, _ = lookup.find(keys, common.unpacked(k))  # every word of the texts is in the table
                out, of = np.unique(np.frombuffer(c, dtype=np.uint32), return_inverse=True)
                rows.append(out.astype(np.int64) + first)
                gained.append(np.bincount(of, weights=pieces[at], minlength=len(out)).astype(np.int64))
        rows, of = np.unique(np.concatenate(rows), return_inverse=True)
        if not len(rows):
            return
        gained = np.bincount(of, weights=np.concatenate(gained), minlength=len(rows)).astype(np.int64)
        home = lookup.home(rows, n_buckets)
        order = np.argsort(home, kind="stable")
        rows, gained, home = rows[order], gained[order], home[order]
        head = np.flatnonzero(np.diff(home, prepend=-1)).tolist()
        for a, b in zip(head, [*head[1:], len(home)], strict=True):
            yield _run([None], *_blank(1, kind), [int(home[a])], [common.packed(rows[a:b].view(np.uint64))], [gained[a:b].astype(np.uint32).tobytes()])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents and runs of answers dealt out by home -> doc_id, n_bytes, n_tokens."""
    documents, rows, gained = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for batch in batches:
        plain = batch.filter(pa.compute.is_null(batch.column("keys")))
        if plain.num_rows:
            documents.append(plain)
        runs = batch.filter(pa.compute.is_valid(batch.column("keys")))
        for keys, columns in zip(*(runs.column(c).to_pylist() for c in ("keys", "columns")), strict=True):
            rows.append(common.unpacked(keys).view(np.int64))
            gained.append(np.frombuffer(columns, dtype=np.uint32).astype(np.int64))
    rows, of = np.unique(np.concatenate(rows), return_inverse=True)
    gained = np.append(np.bincount(of, weights=np.concatenate(gained), minlength=len(rows)), 0).astype(np.int64)
    for batch in documents:
        at, there = lookup.find(rows, batch.column("row").to_numpy())
        more = np.where(there, gained[at], 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(batch.column("n_tokens").to_numpy() + more)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select("doc_id", "text")
    table, n = word_table(docs, path), lookup.dealt(spark)
    keys, pieces, least = lookup.most_frequent(table, head, "pieces")
    handle = spark.sparkContext.broadcast(lookup.Lookup.of(keys, pieces.astype(np.float64)))
    rest = table.where(F.floor(F.log2("n") * 4) < least).select("key", "pieces")
    complete = rest.isEmpty()
    kind = docs.schema["doc_id"].dataType
    schema = f"row long, doc_id {kind.simpleString()}, n_bytes long, n_tokens long, bucket int, keys binary, columns binary"
    rows = docs.mapInArrow(_documents(handle, complete, 3 * n), schema)
    if not complete:
        met = rows.unionByName(rest.mapInArrow(_tabled(3 * n, to_arrow_type(kind)), schema)).repartition(n, "bucket").mapInArrow(_answered(3 * n), schema)
        rows = met.repartition(n, "bucket").mapInArrow(_totals, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document with the word-end vocabulary."""
    import public_tokenizers

    return token_counts(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLES: dict[str, str] = {}
