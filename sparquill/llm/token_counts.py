"""Token counts kept in a digest cache.

A text's count is stored under the digests of its normalised content and of the tokenizer's file. A run joins the digests
of its documents to the stored counts, encodes one text for each digest that is missing, appends these counts to the cache
and joins them back. Appending twice is harmless: a digest's rows are equal and count once.

Nulls count as empty texts (0 tokens), rows without doc_id are left out, repeated rows each get their row, further columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokenizing

CACHE = "content_sha256 binary, tokenizer_sha256 string, n_tokens bigint"


class CountCache:
    """A Parquet table of counts that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(conf).exists(p)

    def stored(self, version: str) -> DataFrame:
        rows = self.spark.read.schema(CACHE).parquet(self.path) if self.exists() else self.spark.createDataFrame([], CACHE)
        return rows.where(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def encode_lengths(name: str, where: str | None, version: str):
    """mapInArrow function: text to its number of tokens."""

    def run(it):
        enc = tokenizing.encoder(name, where)
        for b in common.slices(it, keep=True):
            n = [enc.count(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["content_sha256", "tokenizer_sha256", "n_tokens"])

    return run


def digested(docs: DataFrame) -> DataFrame:
    return common.texts(docs).withColumn("content_sha256", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def encode_misses(work: common.Workspace, rows: DataFrame, known: DataFrame, cache: CountCache, tokenizer: str, where: str | None, version: str) -> DataFrame:
    """Counts of the digests that have none, appended to the cache and returned."""
    # one text for each digest: copies meet before the shuffle, so a hot text costs one row a task
    distinct = rows.groupBy("content_sha256").agg(F.first("text").alias("text"))
    misses = distinct.join(known.select("content_sha256"), "content_sha256", "left_anti").select("content_sha256", "text")
    fresh = work.table(misses.mapInArrow(encode_lengths(tokenizer, where, version), CACHE), "fresh")
    cache.append(fresh)
    return fresh


def store_counts(docs: DataFrame, cache: CountCache, tokenizer: str = "byte_bpe_50k.json", where: str | None = None) -> None:
    """Fill the cache with the counts of these documents."""
    version = tokenizing.version(tokenizer, where)
    work = common.Workspace(docs.sparkSession, "token-counts")
    work.drop(encode_misses(work, digested(docs), cache.stored(version), cache, tokenizer, where, version))


def count_tokens(docs: DataFrame, cache: CountCache, tokenizer: str = "byte_bpe_50k.json", where: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document, counts from the cache where it has them."""
    version = tokenizing.version(tokenizer, where)
    work = common.Workspace(docs.sparkSession, "token-counts")
    rows = digested(docs)
    known = work.table(cache.stored(version), "known") if cache.exists() else cache.stored(version)
    fresh = encode_misses(work, rows, known, cache, tokenizer, where, version)
    light = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "content_sha256")
    # written, so that the join has nothing but exchanges below it and a digest that many rows hold can be split at run time
    needed = known.join(light.select("content_sha256").distinct(), "content_sha256", "left_semi").select("content_sha256", "n_tokens")
    counts = work.table(needed.unionByName(fresh.select("content_sha256", "n_tokens")).groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    return light.join(counts, "content_sha256").select("doc_id", "n_bytes", "n_tokens")
