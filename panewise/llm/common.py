"""Shared plumbing of the operators in this subpackage.

Scratch tables live under ``spark.checkpoint.dir`` (shared by all executors),
so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker.
SLICE_BYTES = 8 << 20
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where it is unset and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("panewise.scratch.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="panewise-")
        spark.conf.set("panewise.scratch.dir", root)
    return root


class Scratch:
    """Tables written once under the shared folder, to cut lineage or to be read twice."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = itertools.count()

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/t{next(self.count)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_parts(self, parts: Iterable[DataFrame]) -> DataFrame:
        """One table of all parts (one at least), written one after the other; the shuffle files of a part go before the next is written."""
        path = f"{self.base}/t{next(self.count)}"
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = df.schema
            del df
            release_shuffles(self.spark)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later action reads."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished phases now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes for what runs inside; the session's setting comes back after it."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gets batches of a bounded size and gives freed memory back when a task ends.

    Python workers live on between tasks; without this each would keep the
    most that any task of its life has used.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: Plan nodes that give each row the same place however often, and with whichever columns, they run.
STEADY = {"Project", "Filter", "LogicalRelation", "DataSourceV2ScanRelation", "LocalRelation"}


def numbered(df: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The table with a number for each row that stays the same in every later use.

    Scans are numbered as they are read; any other plan (a round-robin deal,
    say, which depends on the columns in use) is written first.
    """

    def steady(plan) -> bool:
        children = plan.children()
        return plan.getClass().getSimpleName() in STEADY and plan.deterministic() and all(steady(children.apply(i)) for i in range(children.size()))

    if steady(df._jdf.queryExecution().optimizedPlan()):
        return df.withColumn(name, F.monotonically_increasing_id())
    return scratch.save(df.withColumn(name, F.monotonically_increasing_id()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(col: Column) -> Column:
    """crc32 of an id written as text, modulo 5: 0 marks the held-out rows (a null id counts as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column with nulls as empty strings."""
    return pc.fill_null(batch.column(text), "")


def byte_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its int64 offsets (n + 1, first one 0)."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and the first word of each text (n + 1)."""
    inside = ~is_space(raw)
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edge = off[:-1][off[:-1] < len(raw)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def crc32_of(part: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(part, dtype="<u4").tobytes())


BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once; the rolling hash needs about 40 bytes for each.
HASH_BYTES = 1 << 20
_rng = np.random.default_rng(20240607)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same for A-Z as for a-z.
CASELESS_VALUES = BYTE_VALUES[[c + 32 if 65 <= c <= 90 else c for c in range(256)]]


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Hashes of any range of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE):
        n = len(values)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, base), out=self.sums[1:])
        self.back = powers(n + 1, np.uint64(pow(int(base), -1, 1 << 64)))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES, piece: int | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges are in order and apart. Bounded memory, also for a very long range."""
    piece = piece or HASH_BYTES
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + piece, side="right")))
        z = int(ends[j - 1])
        if z - a <= piece:
            out[i:j] = RollingHash(values[raw[a:z]]).of(starts[i:j] - a, ends[i:j] - a)
        else:  # one long range, part by part
            total = 0
            for t in range(a, z, piece):
                part = values[raw[t : min(t + piece, z)]]
                total += int((part * powers(len(part), BASE)).sum(dtype=np.uint64)) * pow(int(BASE), t - a, 1 << 64)
            out[i] = total & ((1 << 64) - 1)
        i = j
    return fmix(out + (ends - starts).astype(np.uint64))


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public-domain Murmur3 mix)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
