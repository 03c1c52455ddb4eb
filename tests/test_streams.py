"""Streams with state: what a stream has made of its input equals what the batch makes of it."""

import datetime
import random

from pyspark.sql import functions as F

from sparquill.sources.store import Store
from sparquill.streaming import live

START = datetime.datetime(2024, 1, 1)
CHANGE = "path string, op string, at timestamp, text string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def feed(spark, path, parts, schema):
    """Files that arrive one after the other."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_debounce_with_late_and_repeated_changes(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(4)}", rng.choice(["write", "remove"]), at(rng.randrange(400)), None) for _ in range(120)]
    rows = sorted(set(rows), key=lambda r: r[2].timestamp() + rng.randrange(50))  # up to 50 s late
    rows = [r for k, r in enumerate(rows) for _ in range(1 + (k % 7 == 0))]
    parts = [rows[k : k + 25] for k in range(0, len(rows), 25)] + [[("end", "write", at(2000), None)], [("end", "write", at(4000), None)], [("end", "write", at(6000), None)]]
    stream = live.debounce(feed(spark, tmp_path / "in", parts, CHANGE), 30, "1 minute")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(150)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = sorted((r["path"], r["op"], r["changes"]) for r in spark.table("debounced").where("path <> 'end'").collect())
    by_path = {}
    for p, op, t, _ in rows:
        by_path.setdefault(p, []).append((round(t.timestamp() * 1e6), op))
    assert out == sorted((p, op, n) for p, c in by_path.items() for op, _, n in live.flushed(c, 30_000_000)[0])


def test_groups_of_changes():
    assert live.flushed([(5, "b"), (0, "a"), (5, "b"), (29, "c"), (30, "d"), (80, "e")], 30) == ([("c", 29, 3), ("d", 30, 1), ("e", 80, 1)], [])
    assert live.flushed([(0, "a"), (40, "b")], 30, until=50) == ([("a", 0, 1)], [(40, "b")])


def test_each_subscriber_gets_its_rows_once(spark, tmp_path):
    parts = [[(k, k % 3) for k in range(n * 10, n * 10 + 10)] for n in range(3)]
    for _ in range(2):  # a second run finds nothing new
        stream = feed(spark, tmp_path / "in", parts if not (tmp_path / "in").exists() else [], "id int, kind int")
        q = live.publish(stream, {"zero": F.col("kind") == 0, "small": F.col("id") < 12}, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert q.awaitTermination(120)
    got = {(r["subscriber"], r["id"]) for r in spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out")).collect()}
    assert got == {("zero", k) for k in range(0, 30, 3)} | {("small", k) for k in range(12)}


def test_a_snapshot_and_its_tail_without_repeats(spark, tmp_path):
    snapshot = spark.createDataFrame([(k, "old") for k in range(5)], "id int, s string")
    seen = []
    handler = live.snapshot_then_tail(snapshot, "id", lambda b, _: seen.extend(map(tuple, b.collect())), str(tmp_path / "snap"))
    stream = feed(spark, tmp_path / "in", [[(3, "live"), (5, "live")], [(4, "live"), (6, "live")]], "id int, s string")
    assert live.each_batch(stream, handler, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(seen) == [*((k, "old") for k in range(5)), (5, "live"), (6, "live")]


def test_changed_files_are_analysed_again(spark, tmp_path):
    files = Store(spark.createDataFrame([], "path string, text string"), ["path"], path=str(tmp_path / "files"))
    findings = Store(spark.createDataFrame([], "path string, line int, rule string"), ["path", "line"], path=str(tmp_path / "findings"))
    lines = lambda f: f.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    analyse = lambda f: lines(f).where("t = 'bad'").select("path", "line", F.lit("bad").alias("rule"))
    project = lambda f: f.agg(F.count("*").alias("n")).select(F.lit("").alias("path"), F.lit(0).alias("line"), F.concat(F.lit("files "), "n").alias("rule"))
    handle = live.reanalyse(files, findings, analyse, project)
    state = lambda: {(r["path"], r["line"], r["rule"]) for r in findings.current().collect()}
    changed = lambda *rows: handle(spark.createDataFrame([(p, op, at(t), text) for p, op, t, text in rows], CHANGE), 0)
    changed(("a", "write", 1, "bad\nx\nbad"), ("b", "write", 1, "bad"))
    assert state() == {("a", 0, "bad"), ("a", 2, "bad"), ("b", 0, "bad"), ("", 0, "files 2")}
    changed(("a", "write", 2, "bad"), ("a", "write", 3, "x\nbad"))
    assert state() == {("a", 1, "bad"), ("b", 0, "bad"), ("", 0, "files 2")}
    changed(("b", "remove", 4, None))
    changed()
    assert state() == {("a", 1, "bad"), ("", 0, "files 1")}


def test_live_view(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "id int, t int, kind string")
    store = Store(rows(*((k, k, "snap") for k in range(4))), ["id"], path=str(tmp_path / "view"))
    view = live.LiveView(store, "t", most=5)
    view.handle(rows((3, 30, "live"), (9, 9, "live"), (9, 8, "older")))
    state = lambda: {(r["id"], r["t"], r["kind"]) for r in store.current().collect()}
    assert state() == {(3, 30, "live"), (9, 9, "live"), (2, 2, "snap"), (1, 1, "snap"), (0, 0, "snap")}
    view.handle(rows((7, 7, "live")))
    assert len(state()) == 5 and (0, 0, "snap") not in state()
    view.reset(F.col("kind") == "live", rows((1, 1, "snap"), (2, 2, "live")))
    assert state() == {(2, 2, "live")}
