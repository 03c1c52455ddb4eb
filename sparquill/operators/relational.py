"""Operators on tables of any schema: versions, merges, windows over events, ranges, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.store import checkpoints, discard, release, stored


def capped(df: DataFrame, limit: int, default: int = 1000) -> DataFrame:
    """0 means the default, a negative limit means all rows."""
    return df if limit < 0 else df.limit(limit or default)


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """The rows with their place (from 0) under an order without ties.

    Ranges of the order are dealt out and count their own rows; the driver adds up one number for each range.
    """
    checkpoints(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at).checkpoint()
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, total = [], 0
    for r in sorted(dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before.append((r["p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + within).drop("_part", "_before", "_at")


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key under the order, by a row number that is computed on the shuffled partition."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def replace_where(old: DataFrame, new: DataFrame, gone: Column) -> DataFrame:
    """Rows of old that the predicate spares (nulls included), and the new ones."""
    return old.where(~F.coalesce(gone, F.lit(False))).unionByName(new)


def last_write_wins(local: DataFrame, incoming: DataFrame, key: str, version: str, values: Sequence[str], sticky: tuple[str, str] | None = None) -> DataFrame:
    """One row for each key of either side, values from the newer version; the local one wins a tie.

    sticky: an array column and an entry of it that stays once either side has it.
    """
    a, b = local.alias("a"), incoming.alias("b")
    newer = F.col(f"a.{key}").isNull() | F.coalesce(F.col(f"b.{version}") > F.col(f"a.{version}"), F.lit(False))
    picked = {c: F.when(newer, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) for c in (version, *values)}
    if sticky:
        column, entry = sticky
        either = F.coalesce(F.array_contains(f"a.{column}", entry), F.lit(False)) | F.coalesce(F.array_contains(f"b.{column}", entry), F.lit(False))
        picked[column] = F.when(either, F.array_union(F.coalesce(picked[column], F.array().cast("array<string>")), F.array(F.lit(entry)))).otherwise(picked[column])
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[c.alias(n) for n, c in picked.items()])


def densest_window(df: DataFrame, keys: Sequence[str], at: str, span: int, least: int) -> DataFrame:
    """For each key the most rows within a span of `at`, and the earliest end of such a window."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(-span, 0)
    counted = df.select(*keys, at, F.count("*").over(w).alias("n"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col(at)).alias("e"))).alias("b"))
    return best.select(*keys, F.col("b.n").alias("n"), (-F.col("b.e")).alias("window_end")).where(F.col("n") >= least)


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 1, also: Sequence[Column] = ()) -> DataFrame:
    """Intervals of a key that overlap or lie at most `gap` apart become one; `also` are further aggregates of them."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(seen.isNull() | (F.col(start) > seen + gap), 1).otherwise(0))
    island = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *also).drop("_island")


def islands(df: DataFrame, keys: Sequence[str], order: str, gap: int) -> DataFrame:
    """Runs of rows whose order value grows by at most `gap`: first, last and size."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(order) - F.lag(order).over(w)
    marked = df.withColumn("_new", F.when(step.isNull() | (step > gap), 1).otherwise(0))
    runs = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_island")


def regions(df: DataFrame, keys: Sequence[str], a: str, b: str, gap: int) -> DataFrame:
    """Islands in two dimensions, by the order of a and b: a region goes on while a moves by at most `gap` and b by 0 to `gap`."""
    w = Window.partitionBy(*keys).orderBy(a, b)
    near = (F.col(a) - F.lag(a).over(w) <= gap) & (F.col(b) - F.lag(b).over(w)).between(0, gap)
    runs = df.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("_region", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [g(c).alias(f"{c}_{e}") for c in (a, b) for g, e in ((F.min, "from"), (F.max, "to"))]
    return runs.groupBy(*keys, "_region").agg(*ends, F.count("*").alias("n")).drop("_region")


def within_budget(df: DataFrame, keys: Sequence[str], rank: Sequence[Column | str], cost: str, budget: int) -> DataFrame:
    """Rows in rank order until one exceeds the budget; the first is always kept, and nothing after the first refusal.

    Costs are not negative. A row before which its own partition alone spends more can't be kept or be the first refusal,
    so each partition gives at most what fits the budget and one row more, and few keys are no bottleneck.
    """
    paid = F.coalesce(F.col(cost), F.lit(0))
    part = Window.partitionBy(*keys, "_part").orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0)
    few = df.withColumn("_part", F.spark_partition_id()).withColumn("_spent", F.sum(paid).over(part)).where(F.col("_spent") - paid <= budget).drop("_part", "_spent")
    w = Window.partitionBy(*keys).orderBy(*rank)
    run = few.withColumn("spent", F.sum(paid).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(w))
    return run.where((F.col("position") == 1) | (F.col("spent") <= budget))


def shared_budget(sections: Sequence[tuple[str, DataFrame]], order: Sequence[Column | str], cost: str, budget: int, most: int) -> DataFrame:
    """Rows of sections in turn, each with `section` and `place`, until a budget that they share is spent.

    Of a section the first `most` rows under the order are looked at, and it ends with the first row that the rest of the
    budget can't pay for; what is left goes to the next one. The very first row is taken whatever it costs. No section, only
    sums of what was taken, comes to the driver.
    """
    left, any_taken, out = budget, False, None
    for name, df in sections:
        w = Window.orderBy("place")
        top = ranked(df.orderBy(*order).limit(most), *order, name="place").withColumn("_run", F.sum(F.coalesce(F.col(cost), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if any_taken:
            taken = top.where(F.col("_run") <= left)
        else:
            first = F.first(F.coalesce(F.col(cost), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
            taken = top.withColumn("_first", first).where((F.col("place") == 0) | (F.col("_run") - F.col("_first") <= F.greatest(F.lit(0), F.lit(left) - F.col("_first")))).drop("_first")
        spent = taken.agg(F.max("_run")).first()[0]
        any_taken, left = any_taken or spent is not None, max(0, left - (spent or 0))
        part = taken.drop("_run").withColumn("section", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def narrowest_range(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str, end: str, point_id: str, tie: str, width: int = 64) -> DataFrame:
    """For each point the shortest range of its key that contains it; `tie` decides between equally short ones.

    Points and ranges meet on (key, block of `width`), so a file with many ranges isn't compared as a whole.
    """
    cut = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_block", F.floor(F.col(at) / width))
    met = placed.join(cut, [key, "_block"]).where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)))
    best = F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(tie).alias("tie"))).alias("b")
    return met.groupBy(point_id).agg(best).select(point_id, F.col("b.tie").alias(tie), F.col("b.span").alias("span"))


def not_followed(df: DataFrame, keys: Sequence[str], at: str, first: Column, then: Column, span: int) -> DataFrame:
    """Rows that satisfy `first` and are followed by none that satisfies `then` within the span."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, span)
    return df.withColumn("_then", F.count(F.when(then, 1)).over(w)).where(first & (F.col("_then") == 0)).drop("_then")


def bfs(edges: DataFrame, root: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """node, level: nodes reached from the roots along src to dst; each level is one join against nodes not yet seen.

    A level but the last is written, so no plan holds an earlier one twice, and its size is known: edges are not shuffled for
    a small one. most: nodes in all, nearer levels and lesser nodes first.
    """
    # written once, as every level reads it; repeated edges stay, as a level is made distinct after its join
    e = stored(edges.select("src", "dst"))
    seen = front = root.select("node", F.lit(0).alias("level")).distinct()
    for k in range(1, depth + 1):
        step = front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(k).alias("level"))
        if k < depth:
            front = stored(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen if most is None else top_k(seen, most, "level", "node")


def closure(edges: DataFrame, src: str, dst: str, rounds: int = 30) -> DataFrame:
    """All pairs (src, dst) with a way along the edges; each round is cut from its lineage and joins only new pairs."""
    checkpoints(edges.sparkSession)
    e = edges.select(F.col(src).alias("_a"), F.col(dst).alias("_b")).distinct().checkpoint()
    found = front = e
    for _ in range(rounds):
        step = front.select("_a", F.col("_b").alias("_m")).join(e.select(F.col("_a").alias("_m"), "_b"), "_m").select("_a", "_b").distinct()
        front = step.join(found, ["_a", "_b"], "left_anti").checkpoint()
        if front.isEmpty():
            return found.select(F.col("_a").alias(src), F.col("_b").alias(dst))
        found = found.unionByName(front).checkpoint()
    raise RuntimeError(f"ways are longer than {rounds} edges")


def window_hashes(df: DataFrame, keys: Sequence[str], tokens: str, k: int) -> DataFrame:
    """keys, at (from 1), h: the hash of every window of k tokens."""
    held = df.where(F.size(tokens) >= k)
    hashes = F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(k))))
    return held.select(*keys, F.posexplode(hashes).alias("p", "h")).select(*keys, (F.col("p") + 1).alias("at"), "h")


def array_windows(df: DataFrame, column: str, k: int, seed: Column | None = None, put: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """`column`, an array of hashes, becomes that of the hashes of every k entries on end; shorter arrays become empty.

    Hashes of 1, 2, 4, ... entries are made of two of the length before, and those whose lengths add up to k are put
    together, so an entry is met some 2 log2(k) times and not k times. put: what two are put together by instead of a hash.
    """
    mix = put or ((lambda a, b: F.xxhash64(a, b)) if seed is None else (lambda a, b: F.xxhash64(seed, a, b)))
    ahead = lambda c, n: F.slice(c, n + 1, F.size(c))
    have, length, df = 0, 1, df.withColumn("_p", F.col(column))
    while True:
        if k & length:
            # beyond the end there is nothing to put together; those entries are cut off below
            df = df.withColumn("_w", F.zip_with("_w", ahead("_p", have), mix)) if have else df.withColumn("_w", F.col("_p"))
            have += length
        if have == k:
            return df.withColumn(column, F.slice("_w", 1, F.greatest(F.lit(0), F.size(column) - k + 1))).drop("_p", "_w")
        df = df.withColumn("_p", F.zip_with("_p", ahead("_p", length), mix))
        length *= 2


def line_windows(docs: DataFrame, k: int) -> DataFrame:
    """id, lang, h, g, line: two hashes of every window of k tokens, and the lines of all tokens, of documents with a window."""
    return hashed_windows(docs.select("id", "lang", S.lined_tokens(F.col("content")).alias("s")).where(F.size("s") >= k), ["id", "lang"], k)


def hashed_windows(lined: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """keys, h, g, line of rows of lined tokens (s)."""
    s = lined.select(*keys, F.transform("s.t", lambda t: F.xxhash64(t)).alias("h"), F.transform("s.t", lambda t: F.xxhash64(F.lit(k), t)).alias("g"), F.col("s.line").alias("line"))
    return array_windows(array_windows(s, "h", k), "g", k, F.lit(k))


def marked_grams(df: DataFrame, tokens: str, k: int) -> DataFrame:
    """With p and v: places (from 1) and hashes of the marked grams, of k // 2 + 1 tokens each, where `tokens` has k at least.

    Equal grams have equal hashes. A gram is marked if its first or its last token has the least hash of it. Whether it is depends on the gram alone, and of
    every k tokens on end at least one gram is marked: the one that the least of them begins, if it stands in the first half,
    or else the one that it ends.
    """
    g = k // 2 + 1
    df = df.withColumn("_h", F.transform(tokens, lambda t: F.xxhash64(t)))
    df = array_windows(df.withColumn("_low", F.col("_h")), "_low", g, put=lambda a, b: F.least(a, b))
    least = lambda i: (F.element_at("_low", i) == F.element_at("_h", i)) | (F.element_at("_low", i) == F.element_at("_h", i + (g - 1)))
    # no filter stands on what is made here: pushed down, it would hold all of these steps in one expression, many times over
    df = df.withColumn("p", F.filter(F.sequence(F.lit(1), F.size("_low")), least))
    # by up to 32 of its tokens, one by one, as a slice would go through the whole array each time
    return df.withColumn("v", F.transform("p", lambda i: F.xxhash64(*(F.element_at("_h", i + j) for j in range(0, g, -(-g // 32)))))).drop("_h", "_low")


def repeated_stretches(docs: DataFrame, k: int) -> DataFrame:
    """id, lang, skip, s: the lined tokens after the first `skip`, in stretches that hold all windows of k tokens that repeat.

    A window that stands in two places has its marked grams there too. So places of marked grams, about one for k / 4 tokens,
    are counted in place of all windows, and a window with a gram that stands nowhere else is left out. Windows that don't
    repeat may remain where each gram does.
    """
    words = docs.select("id", S.tokens(F.col("content")).alias("t")).where(F.size("t") >= k)
    marks = stored(marked_grams(words, "t", k).select("id", F.explode(F.arrays_zip("p", "v")).alias("m")).select("id", "m.p", "m.v"))
    # written first, so that the places of a very common gram can be dealt to several tasks
    again = stored(marks.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"))
    found = stored(marks.join(again, "v", "left_semi").groupBy(F.col("id").alias("_id")).agg(F.collect_list("p").alias("_found")))
    discard(marks)
    discard(again)
    release(docs.sparkSession)
    held = docs.join(found, F.col("id").eqNullSafe(F.col("_id"))).select("id", "lang", "_found", S.lined_tokens(F.col("content")).alias("s")).where(F.size("s") >= k)
    held = marked_grams(held.withColumn("_t", F.col("s.t")), "_t", k).withColumn("_alone", F.array_except("p", "_found"))
    # windows go on from the place after a gram that stands alone, until the next one comes into them
    ends = F.concat("_alone", F.array(F.size("s") - (k // 2 + 1) + 2))
    stretch = F.zip_with(F.concat(F.array(F.lit(0)), F.col("_alone")), ends, lambda a, b: F.struct(a.alias("skip"), (b - a - (k - k // 2)).alias("n")))
    held = held.withColumn("_w", F.explode(F.filter(stretch, lambda w: w["n"] > 0)))
    out = stored(held.select("id", "lang", "_w.skip", F.slice("s", F.col("_w.skip") + 1, F.col("_w.n") + (k - 1)).alias("s")))
    discard(found)
    release(docs.sparkSession)
    return out


def clones(docs: DataFrame, k: int = 50, bucket: int = 10, matches: int = 2, least_lines: int = 20, warning: int = 50, critical: int = 150, places: int = 3) -> DataFrame:
    """Regions of documents (id, lang, content) that others of the language, or far parts of the same one, repeat.

    Windows in more than `bucket` places are boilerplate. file, start, end (lines), severity, matches and locations of
    each region of severity warning at least. That windows are equal is told by two 64-bit hashes; each carries its lines, so
    that no text goes to the pairs. Only stretches whose grams repeat give windows. How many places have a window is written
    first: where few repeat, their hashes are broadcast and the other windows are not shuffled.
    """
    w = hashed_windows(repeated_stretches(docs, k), ["id", "lang", "skip"], k)
    hashes = w.select(F.explode(F.arrays_zip("h", "g")).alias("w")).select("w.h", "w.g")
    held = stored(hashes.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n").between(2, bucket)).select("h", "g"))
    release(docs.sparkSession)
    lines = [F.slice("line", 1, F.size("h")).alias("first"), F.slice("line", k, F.size("h")).alias("last")]
    w = w.select("id", "lang", "skip", "h", "g", *lines).select("id", "lang", "skip", F.posexplode(F.arrays_zip("h", "g", "first", "last")).alias("p", "w"))
    w = w.select("id", "lang", (F.col("skip") + F.col("p") + 1).alias("at"), "w.*")
    at = w.join(held, ["h", "g"], "left_semi").groupBy("h", "g", "lang").agg(F.sort_array(F.collect_list(F.struct("id", "at", "first", "last"))).alias("p"))
    # of a document's places only those k tokens after the last kept one; at most `bucket` places, so the pairs are bounded
    close = lambda kept, x: (kept["id"] == x["id"]) & (x["at"] - kept["at"] < k)
    apart = F.aggregate("p", F.slice("p", 1, 1), lambda kept, x: F.when(close(F.element_at(kept, -1), x), kept).otherwise(F.concat(kept, F.array(x))))
    at = at.select(apart.alias("p")).where("size(p) > 1")
    two = at.select("p", F.posexplode("p").alias("i", "x")).select("x", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("y"))
    met = two.select(*[F.col(f"{v}.{c}").alias(n) for v, names in (("x", ("a", "ia", "sa", "ea")), ("y", ("b", "ib", "sb", "eb"))) for c, n in zip(("id", "at", "first", "last"), names)])
    # a region goes on while both sides move by at most k tokens and the second does not go back
    v = Window.partitionBy("a", "b").orderBy("ia", "ib")
    da, db = F.col("ia") - F.lag("ia").over(v), F.col("ib") - F.lag("ib").over(v)
    met = met.withColumn("new", F.when((da <= k) & db.between(0, k), 0).otherwise(1)).withColumn("r", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    r = met.groupBy("a", "b", "r").agg(F.min("sa").alias("sa"), F.max("ea").alias("ea"), F.min("sb").alias("sb"), F.max("eb").alias("eb"), F.count("*").alias("n")).where(F.col("n") >= matches)
    side = lambda x, y: r.select(F.col(x).alias("file"), F.col(f"s{x}").alias("start"), F.col(f"e{x}").alias("end"), F.col("n").alias("m"), F.struct(F.col(y).alias("file"), F.col(f"s{y}").alias("start"), F.col(f"e{y}").alias("end")).alias("location"))
    sides = side("a", "b").unionByName(side("b", "a")).where(F.col("end") - F.col("start") + 1 >= least_lines)
    found = merge_intervals(sides, ["file"], "start", "end", also=[F.max("m").alias("matches"), F.sort_array(F.collect_set("location")).alias("locations")])
    span = F.col("end") - F.col("start") + 1
    severity = F.when((span >= critical) & (F.size("locations") >= places), "critical").when(span >= warning, "warning")
    return found.withColumn("severity", severity).where("severity is not null").select("file", "start", "end", "severity", "matches", "locations")


def mining(events: DataFrame, span: int = 30 * 60_000_000, repeats: int = 4, failures: int = 2, rows: int = 6, cap: int = 3) -> DataFrame:
    """session, shape, content, at: repetition, friction and convergence of sessions (id, ts_us, session, name, kind, k).

    Of equal contents of a shape the first counts, and at most `cap` of a session and shape are kept, in order of arrival.
    Events have no file or prompt: a sequence is bound to its session, and k stands for the text of a correction.
    """

    def dense(df: DataFrame, shape: str, signature: Column, least: int) -> DataFrame:
        df = df.withColumn("sig", signature)
        w = Window.partitionBy("session", "sig").orderBy("ts_us").rangeBetween(-span, 0)
        counted = df.select("session", "sig", "ts_us", F.count("*").over(w).alias("n"), F.min("ts_us").over(w).alias("since"))
        best = counted.groupBy("session", "sig").agg(F.max(F.struct("n", (-F.col("ts_us")).alias("e"), "since")).alias("b")).where(F.col("b.n") >= least)
        minutes = F.bround((-F.col("b.e") - F.col("b.since")) / 60_000_000, 0).cast("bigint")
        return best.select("session", F.lit(shape).alias("shape"), F.concat_ws(" ", "sig", "b.n", minutes).alias("content"), (-F.col("b.e")).alias("at"))

    repetition = dense(events, "repetition", F.col("name"), repeats)
    friction = dense(events.where("name = 'error'"), "friction", F.concat(F.lit("failed:"), F.col("kind")), failures)
    w = Window.partitionBy("session").orderBy("ts_us", "id")
    ahead = w.rowsBetween(1, rows)
    e = events.withColumn("then", F.first(F.when(F.col("name") == "view", F.col("ts_us")), ignorenulls=True).over(ahead))
    e = e.withColumn("c", F.first(F.when(F.col("name") == "error", F.struct("then", "k")), ignorenulls=True).over(ahead))
    # the whole sequence has to fit the span
    e = e.where((F.col("name") == "view") & (F.col("c.then") - F.col("ts_us") <= span))
    convergence = e.select("session", F.lit("convergence").alias("shape"), F.concat_ws(" ", F.lit("view"), "c.k").alias("content"), F.col("ts_us").alias("at"))
    found = repetition.unionByName(friction).unionByName(convergence).groupBy("session", "shape", "content").agg(F.min("at").alias("at"))
    arrival = Window.partitionBy("session", "shape").orderBy("at", "content")
    return found.withColumn("rn", F.row_number().over(arrival)).where(F.col("rn") <= cap).drop("rn")
