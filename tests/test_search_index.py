"""The search index: segments of documents, and what it stores."""

import math
import os
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from sparquill.operators import search
from sparquill.operators.search import SearchIndex

SF = "/root/testdata/sf0.01"


def size_of(path):
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def one_edit(a, b):
    return a == b or any(a[:i] == b[:i] and (a[i + x :] == b[i + y :]) for i in range(min(len(a), len(b)) + 1) for x, y in ((1, 1), (0, 1), (1, 0)))


def test_index_is_smaller_than_its_texts_and_lists_are_rows(spark, tmp_path, monkeypatch):
    """Keys of every term were stored before, several times the size of the texts, and a row for each place."""
    monkeypatch.setattr(search, "SEGMENT_BYTES", 200_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    SearchIndex.build(docs, f"{tmp_path}/index")
    assert size_of(f"{tmp_path}/index") < size_of(SF) and size_of(f"{tmp_path}/index") < os.path.getsize(f"{SF}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/index/postings")
    assert rows.select("segment").distinct().count() > 3
    assert rows.count() == rows.select("segment", "term").distinct().count()
    assert rows.where("df <> size(places)").count() == 0


def test_scores_of_repeated_ids_and_other_scripts(spark, tmp_path):
    texts = [(1, "Don't stop the Bolt bolts"), (1, "bolt"), (2, None), (3, ""), (4, "réel bald colt 3 e"), (5, "thunderbolt bo 33"), (None, "bolt über")]
    docs = spark.createDataFrame(texts, "id bigint, content string").repartition(3)
    tf, said = {}, ["bolt", "réal", "x", "3"]
    for i, t in texts:
        tf.setdefault(i, Counter()).update(re.findall(r"[^\W]+(?:['.][^\W]+)*", (t or "").lower()))
    df = Counter(t for c in tf.values() for t in c)
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    legs = {t: sum((t == w) + one_edit(t, w) + (len(t) > 1 and len(w) > 1 and t[:2] == w[:2]) + bool(grams(t) & grams(w)) for w in said) for t in df}
    n = len([i for i in tf if i is not None])
    want = {i: sum(k * legs[t] * round(math.log(1 + n / df[t]) * 1e6) for t, k in c.items()) / 1e6 for i, c in tf.items()}
    found = {r["id"]: r["score"] for r in SearchIndex.build(docs, f"{tmp_path}/i").scores(" ".join(said)).collect()}
    assert found == {i: s for i, s in want.items() if s}
    assert SearchIndex.build(docs.limit(0), f"{tmp_path}/none").search("bolt").collect() == []
    assert SearchIndex(spark, f"{tmp_path}/i").search("  ").collect() == []


def test_a_search_shuffles_no_postings(spark, tmp_path):
    """Terms that match were checkpointed and met by all places of their buckets before."""
    docs = spark.range(3000).select("id", F.concat(F.lit("common w"), F.col("id"), F.lit(" bolt")).alias("content"))
    index = SearchIndex.build(docs, f"{tmp_path}/index")
    plan = index.scores("bolt")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Contains(term" in plan.replace("contains(", "Contains(").replace("term#", "term")
    assert index.scores("bolt").count() == 3000


def test_lists_of_a_segment_over_batches(monkeypatch):
    """Words were grouped row by row before, twice for the counts and twice for the lists."""
    monkeypatch.setattr(search, "TERMS", 2)
    docs = [(1, ["b", "a", "b"]), (2, None), (None, ["é", "a"]), (1, ["a", "c", "b"]), (3, []), (None, ["a"]), (-4, ["c", "", "Z"])]
    schema = pa.schema([("segment", pa.int32()), ("id", pa.int64()), ("words", pa.list_(pa.string()))])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([7] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], schema=schema)
    tf = Counter((t, i) for i, said in docs for t in said or [])
    made = [r for b in search.lists_of(iter([batch(docs[:3]), batch([]), batch(docs[3:])])) for r in b.to_pylist()]
    assert [r["term"] for r in made] == sorted({t for t, _ in tf}, key=str.encode) and {r["segment"] for r in made} == {7}
    assert {(r["term"], p["id"]): p["tf"] for r in made for p in r["places"]} == tf
    assert sum(len(r["places"]) for r in made) == len(tf) and all(r["df"] == len(r["places"]) for r in made)
    assert list(search.lists_of(iter([batch([])]))) == []
    assert [r for b in search.lists_of(iter([batch([(1, None), (2, [])])])) for r in b.to_pylist()] == []


def test_packed_texts_are_dealt_over_more_segments(spark, tmp_path, monkeypatch):
    """Segments had as much of the files as others before, however much text that was."""
    monkeypatch.setattr(search, "SEGMENT_BYTES", 200_000)
    spark.range(1000).selectExpr("id", "repeat('bolt and nut ', 500) AS content").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert size_of(f"{tmp_path}/docs") < 200_000
    index = SearchIndex.build(docs, f"{tmp_path}/index")
    rows = spark.read.parquet(f"{tmp_path}/index/postings")
    assert rows.select("segment").distinct().count() == 9
    assert rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum(F.expr("aggregate(places, 0L, (a, p) -> a + p.tf)")).alias("tf")).where("df = 1000 AND tf = 500000").count() == 3
    assert index.scores("bolt").count() == 1000
