"""Graph operators: strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import checkpoints


def strong_components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """node, component (its least node) of components with more than one node.

    Nodes without both an incoming and an outgoing edge are trimmed first, again and again; then the least reachable label
    is spread forward and backward, and nodes whose labels agree form a component. What does not agree goes on.
    """
    checkpoints(edges.sparkSession)
    live = edges.where("src <> dst").select("src", "dst").distinct()
    found = None
    for left in range(rounds, -1, -1):
        before = -1
        while True:
            both = live.select(F.col("src").alias("n")).intersect(live.select(F.col("dst").alias("n")))
            live = live.join(both.withColumnRenamed("n", "src"), "src", "left_semi").join(both.withColumnRenamed("n", "dst"), "dst", "left_semi").select("src", "dst").checkpoint()
            now = live.count()
            if now in (0, before):
                break
            before = now
        if not now:
            break
        if not left:
            raise RuntimeError(f"components have not been told apart after {rounds} rounds")
        nodes = live.select(F.col("src").alias("node")).distinct()
        forward = spread(live, nodes.withColumn("label", F.col("node")))
        # backward only from the roots of labels, within them
        inside = live.join(forward.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(forward.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = spread(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), forward.where("node = label"), forward)
        part = back.groupBy("label").agg(F.collect_set("node").alias("m")).where("size(m) > 1").select(F.explode("m").alias("node"), F.col("label").alias("component"))
        found = part if found is None else found.unionByName(part)
        live = live.join(back.select(F.col("node").alias("src")), "src", "left_anti").join(back.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").checkpoint()
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)


def spread(edges: DataFrame, start: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """node, label: the least label that reaches each node along the edges."""
    labels, total = start.select("node", "label").checkpoint(), None
    while True:
        step = edges.join(labels.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label")
        if within is not None:
            step = step.join(within, ["node", "label"], "left_semi")
        labels = labels.unionByName(step).groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        state = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").bitwiseAND((1 << 40) - 1))).first()
        if state == total:
            return labels
        total = state
