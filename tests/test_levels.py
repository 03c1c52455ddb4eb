"""Levels of nodes around a root."""

from pyspark.sql import functions as F

from sparquill.operators import relational as R


def shuffled(spark):
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = gateway.jvm.java.util.ArrayList
    stages = store.stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_levels_of_repeated_edges_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 4), (4, 4), (1, 3), (None, 9), (4, None), (7, 8)], "src bigint, dst bigint")
    root = spark.createDataFrame([(1,), (1,)], "node bigint")
    found = sorted((r["level"], str(r["node"])) for r in R.bfs(edges, root, 5).collect() if r["node"] is not None)
    assert found == [(0, "1"), (1, "2"), (1, "3"), (2, "4")]


def test_edges_are_not_shuffled_for_small_levels(spark):
    """They were made distinct before, and met the levels by a shuffle."""
    edges = spark.range(200_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    before = shuffled(spark)
    levels = R.bfs(edges, spark.range(1).select(F.col("id").alias("node")), 3).collect()
    assert sorted((r["node"], r["level"]) for r in levels) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert sum(n for stage, n in shuffled(spark).items() if stage not in before) < 1000
