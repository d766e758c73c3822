"""Helpers shared by the corpus operators: shared storage, folds and flat byte buffers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a worker handles at once; one longer text is handled alone.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local[...] session without that setting gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := f"file://{tempfile.mkdtemp(prefix='siftwell-')}")
    return made


def materialise(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what materialise() wrote for each of them, once nothing reads it any more, and what the driver holds of past plans.

    Shuffle files go when the driver's JVM finds their plans unreachable, hence its collection here.
    """
    if not tables:
        return
    spark = tables[0].sparkSession
    settings = spark._jsparkSession.sessionState().newHadoopConf()
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(settings).delete(path, True)
    gc.collect()
    spark._jvm.System.gc()


def worker_path(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package, wherever the driver runs."""
    root = str(Path(__file__).resolve().parents[2])
    now = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in now.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, now]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str, of: int) -> Column:
    """crc32 of the key as text, modulo `of`; null keys give null."""
    return F.crc32(F.col(key).cast("string")) % F.lit(of)


def in_fold(key: str, of: int, which: int) -> Column:
    return F.coalesce(fold(key, of) == which, F.lit(False))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end and the len+1 offsets; a null text is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` text bytes (one row at least) and `rows` rows each."""
    import pyarrow.compute as pc

    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    i = 0
    while i < len(texts):
        j = max(i + 1, min(i + rows, int(np.searchsorted(size, size[i] + most, "right")) - 1))
        yield i, j
        i = j


#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bases whose powers a worker keeps within a task, up to a slice's length.
KEPT_BASES = 2


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of base and of its inverse modulo 2^64."""
    if base in POWERS and len(POWERS[base][0]) > n:
        return POWERS[base]
    keep = n <= SLICE_BYTES and (base in POWERS or len(POWERS) < KEPT_BASES)
    made = []
    for x in (base, pow(base, -1, 2**64)):
        out = np.full((min(SLICE_BYTES, max(1 << 16, 1 << n.bit_length())) if keep else n) + 1, x, np.uint64)
        out[0] = 1
        made.append(np.cumprod(out, out=out))
    if keep:
        POWERS[base] = (made[0], made[1])
    return made[0], made[1]


def tidy() -> None:
    """Give freed memory back to the system: a worker that Spark keeps for later stages shall not hold it."""
    import ctypes

    POWERS.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


class Rolling:
    """Hashes of any substrings of one flat buffer, each in constant time: polynomials modulo 2^64.

    Every byte first becomes a random 64-bit number. Callers take equal hashes (of two functions, or of 64 bits and a
    place) for equal texts.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, data: np.ndarray, seed: int = 1):
        table = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
        n = len(data)
        base = np.uint64(pow(self.BASE, 2 * seed - 1, 2**64))
        self.power, self.undo = powers(int(base), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * self.power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.undo[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, at: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that `space` (256 flags) doesn't mark; runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = np.zeros(len(data) + 1, bool)
    begins[at[:-1]] = True
    first |= inside & begins[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[:-1] |= inside[:-1] & begins[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def blanks() -> np.ndarray:
    """The bytes 0x20 and 0x09 to 0x0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


#: One text gives at most this share of a sample's bytes.
TEXT_SHARE = 16


def labelled_sample(docs: DataFrame, keys: DataFrame, max_rows: int, max_bytes: int) -> pa.Table:
    """The texts (and all other columns) of the docs of at most max_rows rows of `keys` (doc_id and further columns), in a fixed pseudo-random order, up to max_bytes bytes.

    The order depends on doc_id alone; the sample is bounded, so it may be broadcast and collected. A text of more than a
    sixteenth of max_bytes gives an excerpt from its middle; of rows that share an id the one with the least text counts.
    """
    picked = keys.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    found = docs.where("text is not null").join(F.broadcast(picked), "doc_id")
    most, chars = max_bytes // TEXT_SHARE, max_bytes // TEXT_SHARE // 4
    middle = F.col("text").substr(F.greatest(F.lit(1), (F.length("text") / 2).cast("int") - chars // 2), F.lit(chars))
    cut = found.withColumn("text", F.when(F.octet_length("text") > most, middle).otherwise(F.col("text")))
    rest = [c for c in cut.columns if c not in ("doc_id", "text")]
    one = cut.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("__sw_r")).select("doc_id", "__sw_r.*")
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = one.withColumn("__sw_upto", F.sum(F.octet_length("text")).over(upto))
    return sized.where(F.col("__sw_upto") <= max_bytes).drop("__sw_upto").toArrow()


def added(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """docs with a further column; a column of that name is not overwritten."""
    if name.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {name!r} already: rename it, or have the result under another name")
    return docs.withColumn(name, value)
