"""Readers and writers: tolerant JSON lines, session logs, source trees, record files, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "id string, ts timestamp, kind string, name string, category string, subtype string, dur_ms bigint, tokens int, saved int, file string, session string, error string, attrs map<string,string>"


def json_events(spark: SparkSession, path: str, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """Events of a JSON-lines file, and the lines that are malformed or lack kind or name."""
    raw = spark.read.text(path).select("value", F.from_json("value", schema).alias("e"))
    good = (F.coalesce(F.col("e.kind"), F.lit("")) != "") & (F.coalesce(F.col("e.name"), F.lit("")) != "")
    return raw.where(good).select("e.*"), raw.where(~good).select("value")


def session_log(spark: SparkSession, path: str, role: str, day: str) -> DataFrame:
    """Messages of a role and day; lines without the role's name are not parsed."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(f'"{role}"')))
    parsed = lines.select(F.from_json("value", "type string, timestamp timestamp, message struct<role:string,usage:struct<input_tokens:bigint,output_tokens:bigint>>").alias("m"))
    return parsed.where((F.col("m.message.role") == role) & (F.to_date("m.timestamp") == F.lit(day).cast("date"))).select("m.timestamp", "m.message.usage.*")


def source_tree(spark: SparkSession, path: str, ignore: list[str] = (), most_bytes: int = 1 << 20, modified_after: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files under a folder, without ignored and oversized ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("modifiedAfter", modified_after) if modified_after else reader).load(path).where(F.col("length") <= most_bytes)
    for pattern in ignore:
        files = files.where(~F.rlike("path", F.lit(pattern)))
    return files


def front_matter(spark: SparkSession, path: str, *fields: str) -> DataFrame:
    """path, the named fields and the body of Markdown records."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    field = lambda f: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{f}:\s*(.*)$", 1)), F.lit("")).alias(f)
    return raw.select("path", *map(field, fields), F.regexp_extract("value", r"(?s)^---\n.*?\n---\n(.*)$", 1).alias("body"))


def export_json(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def export_markdown(df: DataFrame, path: str, by: str, title: Column, body: Column) -> None:
    """One text line group for each row, in folders by a column."""
    df.select(by, F.concat(F.lit("## "), title, F.lit("\n\n"), body, F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def compact(spark: SparkSession, path: str, to: str, file_bytes: int = 256 << 20) -> int:
    """Rewrite a table in files of about the given size; the number of files."""
    df = spark.read.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    n = max(1, -(-p.getFileSystem(conf).getContentSummary(p).getLength() // file_bytes))
    df.repartition(int(n)).write.mode("overwrite").parquet(to)
    return int(n)
