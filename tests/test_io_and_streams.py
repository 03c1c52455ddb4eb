import json

from pyspark.sql import functions as F

from sparquill.sources import io
from sparquill.streaming import live


def test_json_events_skip_malformed(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text("\n".join([json.dumps({"id": "1", "kind": "tool", "name": "Read", "tokens": 3}), "{broken", json.dumps({"kind": "tool"}), json.dumps({"id": "2", "kind": "hook", "name": "x", "attrs": {"a": "b"}})]))
    good, bad = io.json_events(spark, str(p))
    assert [r["id"] for r in good.orderBy("id").collect()] == ["1", "2"]
    assert bad.count() == 2


def test_front_matter(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nid: 7\ntopic: x y\n---\nBody\nmore\n")
    r = io.front_matter(spark, str(tmp_path), "id", "topic", "none").collect()[0]
    assert (r["id"], r["topic"], r["none"], r["body"]) == ("7", "x y", None, "Body\nmore\n")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = live.counts_by_window(live.read_events(spark, str(tmp_path / "in"), 1), "1 day", "60 days")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = live.counts_by_window(events.withColumn("at", F.col("ts").cast("timestamp")), "1 day")
    assert sorted(map(str, spark.table("counted").collect())) == sorted(map(str, batch.collect()))


def test_watch_drops_repeated_ids(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50)
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    seen = []
    live.each_batch(live.watch(live.read_events(spark, str(tmp_path / "in")), delay="400 days"), lambda b, _: seen.append(b.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == 50


def test_debounce(spark):
    rows = [("a", "write", 1), ("a", "delete", 3), ("b", "write", 2), ("a", "write", 2)]
    out = live.debounced(spark.createDataFrame(rows, "path string, op string, at int"))
    assert sorted((r["path"], r["op"]) for r in out.collect()) == [("a", "delete"), ("b", "write")]
