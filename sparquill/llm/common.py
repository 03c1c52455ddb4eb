"""Shared folders, input columns and vectorised hashing for the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local session makes a temporary one; a cluster has to name it."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sparquill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Intermediate tables in the shared folder: written once, so a lost executor costs a reread and no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let the context cleaner remove shuffle files of plans that are no longer referenced.

        The session holds on to its last plan, so a trivial one takes its place first.
        """
        self.spark.range(1).count()
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing still to come reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Hand Python fewer rows and bytes at a time than Spark does by default: texts may be long, and a batch is held twice."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (bigint), text (null: empty) and the named columns; rows without a doc_id are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more).where(F.col("doc_id").isNotNull())


def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds == 0


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of byte strings, remembered up to a bound."""

    BOUND = 600_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str) -> list[bytes]:
    """Words between the six ASCII blanks, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in order; of the whole sequence if it is shorter; none without words."""
    if not len(h):
        return h
    m = min(n, len(h))
    acc = np.zeros(len(h) - m + 1, np.uint64)
    step = 0x9E3779B97F4A7C15
    for j in range(m):
        acc += h[j : len(h) - m + 1 + j] * np.uint64((step * (2 * j + 1) * (2 * m + 1)) & MASK64 | 1)
    return mix(acc + np.uint64(m))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Tables written meanwhile hand Python at most so many rows at a time: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Where a worker process keeps its tokenizers from task to task.
ENCODERS = "_sparquill_encoders"


def slices(it, rows: int = 1000, keep: bool = False):
    """Arrow batches in pieces whose Python objects stay few; what a task has freed goes back to the system at its end.

    keep: leave the process its tokenizers for the next task.
    """
    try:
        for b in it:
            for i in range(0, b.num_rows, rows):
                yield b.slice(i, rows)
    finally:
        give_back(keep)


def give_back(keep: bool = False) -> None:
    """Return freed memory of this worker to the system: an idle worker must not hold what its last task used."""
    if not keep:
        sys.modules.pop(ENCODERS, None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(it):
    """Rows of Arrow batches as lists, one batch at a time."""
    for b in it:
        yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
