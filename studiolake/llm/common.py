"""Helpers shared by the operators of this package.

* words: runs of characters other than space and U+0009..U+000D, as UTF-8 bytes (``bytes.split`` uses exactly this set)
* word hashes, shingle sets
* shared scratch folders (written tables cut lineage; they live in ``spark.checkpoint.dir``)
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word in Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
_own: str | None = None
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the cluster names in spark.checkpoint.dir; where that is unset, a
    local session gets a temporary folder and any other an error (its executors would not see one)."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = _own = _own or tempfile.mkdtemp(prefix="studiolake-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage and survives lost executors."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Remove stored tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go when it ends, not when the driver happens to collect garbage: for steps that store
    what they make."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


_step: str | None = None
M_MMAP_THRESHOLD, LARGE_BYTES = -3, 4 << 20


def begin_step(name: str) -> None:
    """In a worker: once it turns to another step, what the steps before have freed goes back to the system, and so does each large
    array from then on, once freed.  The allocators keep them otherwise, and the reused workers of an executor share its memory."""
    global _step
    if name != _step:
        _step = name
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            libc = ctypes.CDLL(None)
            libc.malloc_trim(0)
            libc.mallopt(M_MMAP_THRESHOLD, LARGE_BYTES)  # glibc raises it by itself to what was last freed


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a worker holds some MB of text at a time, not 10,000 whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextlib.contextmanager
def blob_batches(spark: SparkSession, rows: int = 4) -> Iterator[None]:
    """Within, Arrow batches of very few rows, for rows that are packed arrays of some MB."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    for v in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield v.as_py() or b""


class WordHash(dict):
    """word -> 64-bit hash; forgets all when full, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for i in range(size):
        out = mix(out + h[i:i + n])
    return out


def shingles(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(size, len(words))) if len(words) >= size
                     else windows(word_hashes(words), len(words)) + np.uint64(len(words)))


#: Rows of a small side that may be broadcast: its rows are a few short columns, so this is some tens of MB at most.
BROADCAST_ROWS = 100_000
SALTS = 32


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join of a large table with hot keys to a (stored) table with one row per key: broadcast while that has at
    most ``BROADCAST_ROWS`` rows; beyond, the large side is salted by its plain columns (so a repeated task deals its rows as
    before) and the other repeated for each salt."""
    side = small.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in small.columns if c not in keys))
    on = [big[k].eqNullSafe(side[f"_{k}"]) for k in keys]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(side), on, how).drop(*(f"_{k}" for k in keys))
    side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    plain = [F.col(c) for c, kind in big.dtypes if not kind.startswith(("struct", "array", "map", "variant"))]
    salted = big.withColumn("_own_salt", F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
    on = [salted[k].eqNullSafe(side[f"_{k}"]) for k in keys] + [salted["_own_salt"] == side["_salt"]]
    return salted.join(side, on, how).drop("_salt", "_own_salt", *(f"_{k}" for k in keys))
