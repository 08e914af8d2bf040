"""Shared helpers: shipping the package to executors, reliable checkpoints, bounded membership bitmaps, word kernels."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import shared_folder

#: Bits in a membership bitmap (16 MiB). Fixed, so what is collected and broadcast does not grow with the data.
BITMAP_BITS = 1 << 27

#: Rows in an Arrow batch sent to Python.
ARROW_ROWS = 2000

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors once per context, so that functions pickled by reference resolve there.

    Arrow batches are cut to ``ARROW_ROWS`` rows where the session has Spark's default of 10,000, which is made for short rows.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_larkspur_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, names in sorted(os.walk(os.path.join(root, "larkspur"))):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    with open(full, "rb") as f:
                        z.writestr(zipfile.ZipInfo(os.path.relpath(full, root)), f.read())
    data = buffer.getvalue()
    path = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), f"larkspur_{hashlib.sha256(data).hexdigest()[:12]}.zip")
    with open(path, "wb") as f:
        f.write(data)
    sc.addPyFile(path)
    sc._larkspur_shipped = True


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def used_once(spark: SparkSession) -> Iterator[None]:
    """Queries that run here are not read again: Spark deletes their shuffle files as each ends, instead of at the driver's next collection."""
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, old)


def stored(df: DataFrame) -> DataFrame:
    """Write to the session's checkpoint folder as Parquet and read again: lineage ends, and compressed columns take far less room than a checkpoint."""
    path = f"{checkpoint_dir(df.sparkSession)}/larkspur-{uuid.uuid4().hex}"
    with used_once(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def discard(*stored_: DataFrame) -> None:
    """Delete what ``stored`` wrote for frames that nothing will read again."""
    for df in stored_:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._larkspur_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of this context's checkpoints, below the shared folder of the session."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more, instead of at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """Let executors collect garbage and give free heap back to the system: a task on every core, as nothing else runs.

    A JVM keeps the heap that it once grew to, beside the Python workers of all that comes later.
    """
    n = max(spark.sparkContext.defaultParallelism, 1)
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def membership_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """One bit per value of a long column at ``pmod(value, BITMAP_BITS)``; 16 MiB at any input size.

    A clear bit proves absence. A set bit only lets a row through to an exact join, so a full map costs speed, not rows.
    """
    pos = F.pmod(F.col(column), F.lit(BITMAP_BITS)).alias("p")
    with used_once(keys.sparkSession):
        rows = (
            keys.select(pos)
            .groupBy(F.bitmap_bucket_number("p").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
            .collect()
        )
    out = np.zeros(BITMAP_BITS // 8 + 4096 * 2, dtype=np.uint8)
    for b, m in rows:  # bucket n covers the values (n-1)*32768+1 .. n*32768 (value 0 falls into bucket 0, last bit)
        at = int(b) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(m), dtype=np.uint8)
    return out


def bitmap_has(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each int64 value may be in the map of membership_bitmap."""
    p = np.mod(values, BITMAP_BITS)
    bucket = np.where(p > 0, (p - 1) // 32768 + 1, p // 32768)
    bit = np.where(p > 0, (p - 1) % 32768, (-p) % 32768)
    return (bitmap[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1


def returned() -> None:
    """Give freed memory of this worker process back to the system: large arrays one by one as they go, the rest now (glibc; elsewhere nothing happens)."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which otherwise grows to the largest array freed
        libc.malloc_trim(0)


def lean(run):
    """A function for mapInArrow whose worker keeps no freed memory before and after."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        returned()
        yield from run(batches)
        returned()

    return inner


def texts_as_bytes(column: pa.Array) -> pa.Array:
    """A string column as binary (nulls kept)."""
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text, or one row."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Hashes of ranges of a sequence modulo 2^64, by prefix sums and the inverse of an odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        self._grow(n + 1)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.up[:n], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


#: Two independent families; their bases are arbitrary odd numbers.
FIRST, SECOND = RollingHash(0x9E3779B97F4A7C15), RollingHash(0xD1342543DE82EF95)


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end with a space before each: bytes, word starts, word ends, and each text's first word (one more at the end)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    white = _WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return data, starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: RollingHash) -> np.ndarray:
    p = family.prefix(data.astype(np.uint64) + np.uint64(1))
    return mix(family.ranges(p, starts, ends) + (ends - starts).astype(np.uint64))


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Number of the one of ``n`` equal ranges of all 64-bit keys that holds each key; ascending with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as their differences, in as many bytes each as the largest one takes."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max(initial=0)).bit_length() + 7) // 8)
    return keys[:1].tobytes() + bytes([width]) + np.ascontiguousarray(step[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    width = data[8]
    body = np.frombuffer(data, dtype=np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(body) + 1, 8), dtype=np.uint8)
    step[1:, :width] = body
    step[0] = np.frombuffer(data, dtype=np.uint8, count=8)
    return np.cumsum(step.view(np.uint64).ravel(), dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def train_split(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus
