"""Streams of tool events: de-duplicated watching, subscriptions, snapshots with a tail, running statistics, debounced changes, re-analysis of what changed, and live views.

The same transformations take batch and streaming frames, so a stream that has read all of its input equals the batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Folder, Store, checkpoints

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Event files as they arrive; ts as an event time."""
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def watch(events: DataFrame, kinds: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """Each event once, those of the wanted kinds; ids are forgotten after the delay."""
    held = events if kinds is None else events.where(F.col("event_type").isin(*kinds))
    return held.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def counts_by_window(events: DataFrame, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Events and their value by tumbling window and type; late events count until the watermark passes."""
    w = F.window("at", width)
    return events.withWatermark("at", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum(F.floor("value").cast("bigint")).alias("tokens"))


def repetition_alerts(events: DataFrame, span: str = "30 minutes", slide: str = "5 minutes", least: int = 4, delay: str = "1 hour") -> DataFrame:
    """Sessions that repeat an event type at least so often within a sliding window."""
    w = F.window("at", span, slide)
    return events.withWatermark("at", delay).groupBy(w, "user_id", "event_type").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def debounced(changes: DataFrame) -> DataFrame:
    """Of a batch of changes (path, op, at) the last one of each path."""
    return changes.groupBy("path").agg(F.max_by("op", "at").alias("op"), F.max("at").alias("at"))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a handler on each micro-batch; without an interval, until all that is there has been read."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def replace_by_file(spark: SparkSession, path: str) -> Callable[[DataFrame, int], None]:
    """A handler that replaces the stored rows of the files in a batch (partitions of `file`) and keeps the rest."""

    def handle(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(path)

    return handle


# streams with state


def subscribed(events: DataFrame, subscribers: dict[str, Column]) -> DataFrame:
    """A row for each subscriber whose condition an event satisfies."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subscribers.items()]), lambda n: n.isNotNull())
    return events.withColumn("subscriber", F.explode(names))


def publish(events: DataFrame, subscribers: dict[str, Column], path: str, checkpoint: str) -> StreamingQuery:
    """Write what each subscriber asked for under subscriber=<name>; nothing is dropped, a slow reader finds it there.

    A micro-batch has a folder of its own that it overwrites, so one that is repeated leaves the same rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        subscribed(batch, subscribers).write.mode("overwrite").partitionBy("subscriber").parquet(f"{path}/part={n}")

    return each_batch(events, write, checkpoint)


def snapshot_then_tail(snapshot: DataFrame, key: str, handle: Callable[[DataFrame, int], None], path: str) -> Callable[[DataFrame, int], None]:
    """A handler that hands over the snapshot's rows with the first micro-batch, and afterwards rows whose key it didn't have.

    The keys of the snapshot are written once under the path, so a stream that is started again goes on without repeats.
    Repeated keys within the tail are for `watch` to drop.
    """
    spark = snapshot.sparkSession
    folder = Folder(spark, path)
    if "built" not in folder.names():
        name = f"snapshot-{uuid.uuid4().hex}"
        snapshot.write.parquet(f"{path}/{name}")
        folder.put_if_absent("built", name)
    kept = spark.read.parquet(f"{path}/{folder.read('built')}")

    def run(batch: DataFrame, n: int) -> None:
        fresh = batch.join(kept.select(key), key, "left_anti").select(*batch.columns)
        handle(kept.select(*batch.columns).unionByName(fresh) if n == 0 else fresh, n)

    return run


DEBOUNCED = "path string, op string, at timestamp, changes int"


def flushed(changes: list[tuple[int, str]], delay: int, until: int | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[int, str]]]:
    """Changes (microseconds, op) of a path in the groups that a delay from each group's first change makes: (op, at, number) of
    those whose delay is over, by default of all, and the changes of the others. The last change of a group names its op."""
    left, done = sorted(set(changes)), []
    while left and (until is None or left[0][0] + delay <= until):
        end = left[0][0] + delay
        group = [c for c in left if c[0] < end]
        left = left[len(group) :]
        done.append((group[-1][1], group[-1][0], len(group)))
    return done, left


def debounce(changes: DataFrame, seconds: int = 30, lateness: str = "1 minute") -> DataFrame:
    """path, op, at, changes of a stream of changes (path, op, at): each path's changes, once, `seconds` after its first one.

    A timer on event time is set for each path; changes may be late until the watermark has passed them, repeated ones count
    once. What a path has to keep is the changes of one delay and the lateness.
    """
    delay = seconds * 1_000_000

    def run(key, batches, state):
        import pandas as pd

        held = list(zip(*state.get, strict=True)) if state.exists else []
        watermark = state.getCurrentWatermarkMs() * 1000
        for b in batches if not state.hasTimedOut else ():
            at = b["at"].astype("datetime64[us]").astype("int64")
            held += [(int(t), op) for t, op in zip(at, b["op"], strict=True) if t > watermark]
        done, left = flushed(held, delay, watermark)
        if left:
            state.update(([t for t, _ in left], [op for _, op in left]))
            state.setTimeoutTimestamp(max((left[0][0] + delay) // 1000 + 1, watermark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"path": [key[0]] * len(done), "op": [d[0] for d in done], "at": pd.to_datetime([d[1] for d in done], unit="us"), "changes": [d[2] for d in done]})

    rows = changes.withWatermark("at", lateness).select("path", "op", "at")
    return rows.groupBy("path").applyInPandasWithState(run, DEBOUNCED, "at array<bigint>, op array<string>", "append", "EventTimeTimeout")


def reanalyse(files: Store, findings: Store, analyse: Callable[[DataFrame], DataFrame], project: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A handler of changed files (path, op, at, text): findings of a written file are replaced, those of a removed one go, and
    those of the whole project (path "") are made anew whenever something changed."""

    def run(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("op", "text"), "at").alias("l")).select("path", "l.*").checkpoint()
        if last.isEmpty():
            return
        written, removed = last.where("op <> 'remove'").select("path", "text"), last.where("op = 'remove'").select("path")
        files.commit(lambda _v: [(removed, "drop"), (written, "put")])
        findings.commit(lambda v: [(findings.current(v).join(last.select("path"), "path", "left_semi"), "drop"), (analyse(written), "put")])
        if project:
            findings.replace(F.col("path") == "", project(files.current()))

    checkpoints(files.spark)
    return run


class LiveView:
    """The newest rows of a stream that satisfy a condition, each id once, in a store; an arriving row replaces one of its id."""

    def __init__(self, store: Store, order: str, where: Column | None = None, most: int = 1000):
        self.store, self.order, self.where, self.most = store, order, where, most

    def handle(self, batch: DataFrame, _: int = 0) -> None:
        key = self.store.key
        live = batch if self.where is None else batch.where(self.where)
        newest = live.groupBy(*key).agg(F.max_by(F.struct(*live.columns), self.order).alias("r")).select("r.*")

        def changes(v: int) -> list[tuple[DataFrame, str]]:
            now = self.store.current(v)
            rows = newest.unionByName(now.join(newest.select(*key), key, "left_anti").select(*newest.columns))
            kept = rows.orderBy(F.desc(self.order), *key).limit(self.most)
            return [(now, "drop"), (kept, "put")]

        self.store.commit(changes)

    def reset(self, where: Column | None, snapshot: DataFrame) -> None:
        """Another condition: the view starts again from a snapshot."""
        self.where = where
        self.store.clear()
        self.handle(snapshot)
