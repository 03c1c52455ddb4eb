"""Sequences of events within a session: what follows what within so many rows and so much time.

A row looks ahead at a bounded number of rows of its session, so all it needs is one frame of a window; the same functions
work on the rows that a stream hands over session by session. Sessions are partitions of that window: a session is bounded
by its life, and a row's frame by the number of rows it may look ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000


def ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, **fields: Column) -> DataFrame:
    """`next`: the fields of the next rows, in order, as structs."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    return df.withColumn("next", F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()])).over(w))


def first_at(rows: Column, after: Column, most: int, when: Callable[[Column], Column]) -> Column:
    """The place (from 1) of the first of the `most` rows behind place `after` that satisfies a condition; null if none does."""
    found = F.filter(F.sequence(after + 1, F.least(after + most, F.size(rows))), lambda i: F.coalesce(when(F.element_at(rows, i)), F.lit(False)))
    return F.when(after < F.size(rows), F.get(found, F.lit(0)))


def look_ahead(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Column, rows: int, **targets: Column) -> DataFrame:
    """For each row that satisfies `start`: the first row of each target within so many rows; null where there is none."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, rows)
    out = df
    for name, is_target in targets.items():
        out = out.withColumn(name, F.first(F.when(is_target, F.col("id")), ignorenulls=True).over(w))
    return out.where(start)


def convergence(events: DataFrame, mutation: Column, correction: Column, positive: Column, rows: int = 6, minutes: int = 30) -> DataFrame:
    """session, file, first, correction, then, positive of events (id, ts_us, session, file).

    A mutation, the first correction within `rows` rows of it, and the first mutation of the same file within as many rows of
    that (of any file, where the first names none), all within `minutes`; positive: whether a positive row is among the next
    rows.
    """
    fields = {"id": F.col("id"), "ts": F.col("ts_us"), "file": F.col("file"), "m": mutation, "c": correction, "p": positive}
    df = ahead(events, ["session"], ["ts_us", "id"], 3 * rows, **fields).where(mutation)
    df = df.withColumn("i", first_at(F.col("next"), F.lit(0), rows, lambda r: r["c"])).where("i is not null")
    same = lambda r: r["m"] & (F.coalesce(F.col("file"), F.lit("")).isin("") | (r["file"] == F.col("file")))
    df = df.withColumn("j", first_at(F.col("next"), F.col("i"), rows, same)).where("j is not null")
    df = df.where(F.element_at("next", F.col("j"))["ts"] - F.col("ts_us") <= minutes * MINUTE)
    signal = first_at(F.col("next"), F.col("j"), rows, lambda r: r["p"]).isNotNull()
    return df.select("session", "file", F.col("id").alias("first"), F.element_at("next", F.col("i"))["id"].alias("correction"), F.element_at("next", F.col("j"))["id"].alias("then"), signal.alias("positive"), "ts_us")


def repeated(events: DataFrame, signature: Column, least: int, minutes: int = 30) -> DataFrame:
    """session, signature, n, since, until: of each session and signature the densest stretch of so many minutes, the earliest of equally dense ones."""
    df = events.withColumn("signature", signature).where("signature is not null and signature <> ''")
    w = Window.partitionBy("session", "signature").orderBy("ts_us").rangeBetween(-minutes * MINUTE, 0)
    counted = df.select("session", "signature", "ts_us", F.count("*").over(w).alias("n"), F.min("ts_us").over(w).alias("since"))
    best = counted.groupBy("session", "signature").agg(F.max(F.struct("n", (-F.col("ts_us")).alias("e"), "since")).alias("b")).where(F.col("b.n") >= least)
    return best.select("session", "signature", F.col("b.n").alias("n"), F.col("b.since").alias("since"), (-F.col("b.e")).alias("until"))


def proposals(repetition: DataFrame, friction: DataFrame, converged: DataFrame, cap: int = 3) -> DataFrame:
    """session, shape, content, at: findings of the three detectors, equal contents of a session and shape once, and of each
    at most `cap` in the order of arrival."""
    minutes = F.bround((F.col("until") - F.col("since")) / MINUTE, 0).cast("bigint")
    dense = lambda df, shape: df.select("session", F.lit(shape).alias("shape"), F.concat_ws(" ", "signature", "n", minutes).alias("content"), F.col("until").alias("at"))
    said = F.concat_ws(" ", F.coalesce("file", F.lit("")), F.when(F.col("positive"), "kept").otherwise("changed"))
    every = dense(repetition, "repetition").unionByName(dense(friction, "friction")).unionByName(converged.select("session", F.lit("convergence").alias("shape"), said.alias("content"), F.col("ts_us").alias("at")))
    found = every.groupBy("session", "shape", "content").agg(F.min("at").alias("at"))
    # only the first few of each group have to meet, so groups are cut before their rows are ordered
    few = found.groupBy("session", "shape").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "content"))), 1, cap).alias("few"))
    return few.select("session", "shape", F.explode("few").alias("f")).select("session", "shape", "f.content", "f.at")
