"""Sum-of-squares online packing of documents into token windows.

A document's tokens are cut into full windows and one rest. Each rest goes, as it comes, to the fill level for which the sum
of squares of the numbers of partially filled windows per level becomes least; these numbers are a level array. Each task
packs the documents that it reads. Windows that are still open when a task ends (or when it holds ``OPEN_WINDOWS``, which bounds
its memory) are carried on with their ids: the rests in ``CARRY`` tasks' open windows meet in a task of a second stage and are packed
there by the same rule, among many more of their kind. What is open at the end of that is re-cut into full windows, and the last of it into
powers of two, so nothing is padded; ``share_recut`` tells how much that is.

Defined cases: a null text is empty and gives one piece, the end id; a text of any length is packed whole; an empty table gives an
empty result; every input row is a document of its own, repeated rows and null ids included; other columns are ignored. Sequence
ids are unique but not consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import common, lookup, pretokens

#: Tokens in a sequence.
CAPACITY = 1024
#: Id that ends a document.
END_ID = 0
#: Open windows held by one task before they are carried on.
OPEN_WINDOWS = 4096
#: Tasks whose open windows meet in one of the second stage.
CARRY = 16
#: Text encoded at once.
SLICE_BYTES = 4 << 20

Piece = tuple[int, int, np.ndarray, int]  # row number, start, ids, tokens of the document


class Packer:
    """Level array: ``count[f]`` open windows hold f tokens. Closed windows are lists of pieces; so are those taken out still open."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_WINDOWS):
        self.capacity, self.most = capacity, most
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.closed: list[list[Piece]] = []
        self.opened: list[list[Piece]] = []
        self.open = 0
        self.recut = 0  # tokens

    def level_for(self, size: int) -> int:
        """Fill level whose window should take ``size`` tokens; 0 opens a window. Ties: the fullest."""
        n, cap = self.count, self.capacity
        levels = np.arange(0, cap - size + 1)
        after = np.where(levels + size < cap, 2 * n[size : cap + 1] + 1, 0)
        before = np.where(levels > 0, 2 * n[: cap - size + 1] - 1, 0)
        cost = np.where((levels == 0) | (n[: cap - size + 1] > 0), after - before, np.iinfo(np.int64).max)
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def add(self, row, ids: np.ndarray) -> None:
        total, cap = len(ids), self.capacity
        full = total - total % cap
        for at in range(0, full, cap):
            self.closed.append([(row, at, ids[at : at + cap], total)])
        if full == total:
            return
        self.place([(row, full, ids[full:], total)], total - full)

    def place(self, pieces: list[Piece], size: int) -> None:
        """Put pieces of less than a window together into the window of the best level."""
        cap = self.capacity
        level = self.level_for(size)
        window = self.windows[level].pop() if level else []
        self.count[level] -= level > 0
        self.open += level == 0
        window += pieces
        if level + size == cap:
            self.closed.append(window)
            self.open -= 1
        else:
            self.windows[level + size].append(window)
            self.count[level + size] += 1
        if self.open >= self.most:
            self.give_up()

    def give_up(self) -> None:
        """Take out the open windows as they are."""
        for level in range(self.capacity - 1, 0, -1):
            self.opened += self.windows[level]
            self.windows[level] = []
        self.count[:] = 0
        self.open = 0

    def close(self) -> None:
        """Close every open window without padding."""
        self.give_up()
        rest: list[Piece] = []
        for window in self.opened:
            level = sum(len(p[2]) for p in window)
            if level & (level - 1) == 0:
                self.closed.append(window)
            else:
                rest += window
        self.opened = []
        left = sum(len(p[2]) for p in rest)
        self.recut += left
        sizes = [self.capacity] * (left // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (left % self.capacity) >> b & 1]
        at, used = 0, 0
        for size in sizes:
            window = []
            while size:
                row, start, ids, total = rest[at]
                take = min(size, len(ids) - used)
                window.append((row, start + used, ids[used : used + take], total))
                size, used = size - take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            self.closed.append(window)

    def take(self) -> list[list[Piece]]:
        out, self.closed = self.closed, []
        return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, carry: int = CARRY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, recut (whether its window was made by re-cutting)."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "recut"]
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", recut boolean"

    def rows(windows: list[list[Piece]], first: int, id_type: pa.DataType, recut: bool = False, carried: int | None = None) -> pa.RecordBatch:
        """Pieces of windows; with ``carried`` (the number of a task), open ones with their ids."""
        flat, sequence, offset = [], [], []
        for k, window in enumerate(windows):
            at = 0
            for piece in window:
                flat.append(piece)
                sequence.append(first + k)
                offset.append(at)
                at += len(piece[2])
        longs = [[p[1] for p in flat], [len(p[2]) for p in flat], [zlib.crc32(p[2].tobytes()) for p in flat], [p[3] for p in flat], sequence, offset]
        meets = [None if carried is None else carried // carry] * len(flat)
        ids = [None if carried is None else p[2].tobytes() for p in flat]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in flat], id_type), *(pa.array(x, pa.int64()) for x in longs), pa.array([recut] * len(flat), pa.bool_()), pa.array(meets, pa.int32()), pa.array(ids, pa.binary())],
            names=[*names, "meets", "ids"],
        )

    @common.lean
    def first_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pretokens.once(pretokens.ByteEncoder, path)
        end = np.array([END_ID], dtype="<u4")
        task = TaskContext.get().partitionId()
        packer, number, id_type = Packer(capacity), task << 40, pa.int64()

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for windows, carried in ((packer.closed, None), (packer.opened, task)):
                if windows:
                    yield rows(windows, number, id_type, carried=carried)
                    number += len(windows)
            packer.closed, packer.opened = [], []

        for whole in batches:
            for batch in common.slices(whole, "text", SLICE_BYTES):
                id_type = batch.column("doc_id").type
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    packer.add(doc_id, np.concatenate([encoder.encode(text or ""), end]))
                yield from done()
        packer.give_up()
        yield from done()

    @common.lean
    def second_stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs carried rests on; other rows pass through."""
        packer, number, id_type = Packer(capacity), (1 << 62) + (TaskContext.get().partitionId() << 40), pa.int64()
        for batch in batches:
            id_type = batch.column("doc_id").type
            plain = batch.filter(pa.compute.is_null(batch.column("ids")))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column(n) for n in names], names=names)
            carried = batch.filter(pa.compute.is_valid(batch.column("ids")))
            for doc_id, start, total, ids in zip(*(carried.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.place([(doc_id, start, np.frombuffer(ids, dtype="<u4"), total)], len(ids) // 4)
        packed = packer.closed
        packer.closed = []
        packer.close()
        for windows, recut in ((packed, False), (packer.closed, True)):
            if windows:
                out = rows(windows, number, id_type, recut)
                yield pa.RecordBatch.from_arrays([out.column(n) for n in names], names=names)
                number += len(windows)

    packed = docs.mapInArrow(first_stage, f"{schema}, meets int, ids binary")
    n = lookup.dealt(spark)
    # open windows meet by the task that they come from, in its order, so a second run packs alike; pieces of whole ones go with their task
    meets = F.coalesce("meets", (F.shiftright("sequence_id", 40) / carry).cast("int"))
    return packed.repartition(n, meets).sortWithinPartitions(F.col("ids").isNull(), "sequence_id", "offset").mapInArrow(second_stage, schema)


def share_recut(packed: DataFrame) -> float:
    """Share of all tokens that lie in windows made by re-cutting."""
    got = packed.agg(F.sum("length"), F.sum(F.when(F.col("recut"), F.col("length")))).first()
    return (got[1] or 0) / got[0] if got[0] else 0.0


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 tokens of the byte-level vocabulary."""
    import public_tokenizers

    return pack(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("recut")


QUERIES = {"op5_pack": op5_pack}
ORACLES: dict[str, str] = {}
