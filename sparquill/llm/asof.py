"""As-of join with a tolerance by dyadic decomposition.

The orders of a client that share a time become one row, won by rank. A row is valid from its time until the next one's,
or until the tolerance ends; these intervals of a client do not overlap. Each is split into canonical nodes, intervals
[node * 2**level, (node + 1) * 2**level), down to leaves of 2**-depth of its length; a click emits its ancestors, the
nodes that hold its time, on the levels that the client's intervals use around it. Clicks and intervals then meet by
equality of client, level and node. Only leaves at an interval's ends hold times outside it, so a comparison with the two
ends leaves one match at most; with a depth of 64 leaves are microseconds and there is nothing left to compare.

The next time is found over blocks of 13 bits of the time: the first times of blocks are ordered within larger blocks, and
each block is told the first time after it. So no window holds more than 2**13 + 1 rows, whatever one client has, and all
joins have plain exchanges below them, whose large partitions Spark splits.

Events without a client or time match nothing. Equal events (id, client and time) count once; ids that differ in client or
time are told apart. Orders without a client or time are never matched; repeated orders tie. Ranks compare in order, nulls
lose; rows equal in all ranks are told apart by the carried columns. Empty tables give no matches, and an empty result
where there are no events. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bits of the time that one step of the search for the next time covers.
STEP = 13


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a column of times without zone."""
    return F.expr(f"cast(cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6)) * 1000000 as bigint)")


def shift(a: Column, bits: int | Column) -> Column:
    return F.call_function("shiftright", a, bits if isinstance(bits, Column) else F.lit(bits))


def best_of_time(orders: DataFrame, rank: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """client, at, n_tied and the carried columns of the best order of each client and time."""
    ranked = orders.select("client", "at", F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], *carry).alias("best"))
    known = ranked.where(F.col("client").isNotNull() & F.col("at").isNotNull())
    return known.groupBy("client", "at").agg(F.count("*").alias("n_tied"), F.max("best").alias("best")).select("client", "at", "n_tied", *[F.col(f"best.{c}").alias(c) for c in carry])


def with_next(times: DataFrame, tolerance: int) -> DataFrame:
    """The rows (client, at distinct) and `next`, the client's next time; null where that is further away than the tolerance."""
    top = max(1, tolerance.bit_length())
    widths = [*range(top, 0, -STEP), 0]
    firsts = {0: times}
    for w in reversed(widths[:-1]):
        below = firsts[max(firsts)]
        firsts[w] = below.groupBy("client", shift(F.col("at"), w).alias("block")).agg(F.min("at").alias("at"))
    # what follows a block of the widest kind is the first time of the block after it, or too far away
    heads = firsts[top].select("client", (F.col("block") - 1).alias("block"), "at")
    out = None
    for above, w in zip(widths, widths[1:], strict=False):
        own = firsts[w].withColumn("block", shift(F.col("at"), above)).withColumn("own", F.lit(True))
        rows = own.unionByName(heads.withColumn("own", F.lit(False)), allowMissingColumns=True)
        out = rows.withColumn("next", F.lead("at").over(Window.partitionBy("client", "block").orderBy("at", F.desc("own")))).where("own")
        heads = out.where("next is not null").select("client", shift(F.col("at"), w).alias("block"), F.col("next").alias("at"))
    return out.drop("own", "block")


def node_code(level: Column, node: Column) -> Column:
    """Level and node in one number: the bits of the node, a one, and as many zeros as the level has."""
    return F.call_function("shiftleft", node * 2 + 1, level)


def cover(start: Column, until: Column, depth: int, bits: int) -> Column:
    """(level, node) of the canonical nodes of [start, until), cut into leaves of 2**-depth of its length; a length has so many bits at most."""
    leaf = F.greatest(F.length(F.bin(until - start)) - 1 - depth, F.lit(0))
    low, high = shift(start, leaf), shift(until - 1, leaf) + 1
    found = []
    for k in range(min(depth, bits) + 3):
        # what a step leaves: nodes a to b of this level, of which those without a sibling inside are taken
        a, b = shift(low + ((1 << k) - 1), k), shift(high, k) - 1
        found += [F.when((a <= b) & (a % 2 != 0), F.struct((leaf + k).alias("level"), a.alias("node")))]
        found += [F.when((a <= b) & (b % 2 == 0), F.struct((leaf + k).alias("level"), b.alias("node")))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def intervals(orders: DataFrame, tolerance: int, rank: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """client, at, until, n_tied and the carried columns: disjoint intervals of each client."""
    rows = with_next(best_of_time(orders, rank, carry), tolerance)
    return rows.withColumn("until", F.least("next", F.col("at") + tolerance + 1)).drop("next")


def asof_join(events: DataFrame, orders: DataFrame, tolerance: int, rank: Sequence[Column], carry: Sequence[str], depth: int = 1) -> DataFrame:
    """Events (id, client, ts: bigint) with the best of the latest orders (client, at: bigint) at or before them.

    tolerance: how much earlier at most. rank: columns of the orders, the largest wins at equal times. carry: columns of the
    orders that the result has, null where nothing matches, besides `at` and `n_tied`, the orders at the matched time; their
    names are free but for these two and id, client and ts.
    """
    work = common.Workspace(events.sparkSession, "asof")
    held = {f"c{i}": c for i, c in enumerate(carry)}
    keys = {f"k{i}": r for i, r in enumerate(rank)}
    rows = orders.select("client", "at", *[r.alias(k) for k, r in keys.items()], *[F.col(f"`{c}`").alias(k) for k, c in held.items()])
    spans = work.table(intervals(rows, tolerance, [F.col(k) for k in keys], list(held)), "spans")
    nodes = spans.select("*", F.explode(cover(F.col("at"), F.col("until"), depth, (tolerance + 1).bit_length())).alias("n"))
    # the levels in use around a time; a node is never wider than such a block
    wide = tolerance.bit_length() + 1
    block = shift(F.call_function("shiftleft", F.col("n.node"), F.col("n.level")), wide)
    levels = work.table(nodes.select("client", block.alias("block"), "n.level").groupBy("client", "block").agg(F.sort_array(F.collect_set("level")).alias("levels")), "levels")
    known = events.select("id", "client", "ts")
    met = known.where("client is not null and ts is not null").withColumn("block", shift(F.col("ts"), wide)).join(levels, ["client", "block"])
    ancestors = met.select("id", "client", "ts", F.explode("levels").alias("level")).select("id", "client", "ts", node_code(F.col("level"), shift(F.col("ts"), F.col("level"))).alias("code"))
    valid = nodes.select("client", "at", "until", "n_tied", *held, node_code(F.col("n.level"), F.col("n.node")).alias("code"))
    matches = ancestors.join(valid, ["client", "code"]).where("at <= ts and ts < until").select("id", "client", "ts", "at", "n_tied", *held)
    # an event's rows are itself and one match at most, so the largest of each column is the match
    both = known.unionByName(matches, allowMissingColumns=True)
    found = both.groupBy("id", "client", "ts").agg(*[F.max(c).alias(c) for c in ("at", "n_tied", *held)])
    return found.select("id", "client", "ts", "at", "n_tied", *[F.col(k).alias(c) for k, c in held.items()])
