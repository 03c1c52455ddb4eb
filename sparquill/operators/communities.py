"""Communities of weighted graphs, distributed: modularity by rounds of local moves, contraction, splits, stable ids.

Nodes are numbered in their order and weights become integers, so gains and ties are the same in every run. In a round each
node weighs its neighbours' communities; of those that would gain, about half may move (by a hash of node and round), and of
two single nodes only the larger moves to the smaller, so none chase each other. A level ends when no node would gain, or
when modularity has not risen for three rounds, with the best state it has had. Communities then become nodes, and so on
until nothing moves. Each round is a few joins and aggregates and is written as a table; what comes to the driver is counts and sums.

Hubs, nodes whose weighted degree exceeds a percentile, are held out and join the community with most of their weight
afterwards. Communities above a share of the graph, and large ones with few inner edges, are split by a run of their own; all
such runs share their rounds. Edges in either direction add up, loops and weights that aren't positive don't count, an edge's
ends are nodes, and nodes without edges are communities of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .relational import ranked

UNIT = 1 << 20
ROUNDS, PATIENCE = 40, 3


def undirected(edges: DataFrame) -> DataFrame:
    """a, b, w (integer) once for each pair of ends, a < b, of edges (a, b, w)."""
    whole = edges.where("a <> b and w > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return whole.groupBy("a", "b").agg(F.round(F.sum("w") * UNIT).cast("bigint").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "w").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def moved(adjacent: DataFrame, nodes: DataFrame, resolution: float) -> tuple[DataFrame, bool]:
    """node, comm after the local moves of one level, and whether any node moved.

    adjacent: a, b, w both ways. nodes: node, part, degree (loops included); parts are graphs of their own.
    """
    totals = nodes.groupBy("part").agg(F.sum("degree").cast("double").alias("m2"))
    state = stored(nodes.join(totals, "part").select("node", F.col("node").alias("comm"), "degree", "m2"))
    best, best_value, waited, ever = state, None, 0, False
    for k in range(ROUNDS):
        sums = state.groupBy("comm").agg(F.sum("degree").cast("double").alias("total"), F.count("*").alias("members"))
        toward = adjacent.join(state.select(F.col("node").alias("b"), "comm"), "b").groupBy(F.col("a").alias("node"), "comm").agg(F.sum("w").alias("w"))
        options = toward.unionByName(state.select("node", "comm", F.lit(0).cast("bigint").alias("w"))).groupBy("node", "comm").agg(F.sum("w").alias("w"))
        weighed = options.join(state.select("node", F.col("comm").alias("old"), "degree", "m2"), "node").join(sums, "comm")
        rest = F.col("total") - F.when(F.col("comm") == F.col("old"), F.col("degree")).otherwise(0)
        gain = F.when(F.col("m2") > 0, F.col("w") - resolution * F.col("degree") * rest / F.col("m2")).otherwise(0.0)
        stays = F.col("comm") == F.col("old")
        per = weighed.withColumn("gain", gain).groupBy("node").agg(
            F.max(F.struct("gain", (-F.col("comm")).alias("c"), "members")).alias("top"),
            F.max(F.when(stays, F.col("gain"))).alias("now"),
            *[F.max(c).alias(c) for c in ("old", "degree", "m2")],
            F.max(F.when(stays, F.col("members"))).alias("company"),
            F.max(F.when(stays, F.col("w"))).alias("inside"),
            F.max(F.when(stays & (F.col("m2") > 0), F.col("degree") * F.col("total") / F.col("m2"))).alias("expected"),
        )
        to, inner, spread = -F.col("top.c"), F.col("inside"), F.col("expected")
        alone = (F.col("company") == 1) & (F.col("top.members") == 1) & (to > F.col("old"))
        wants = (to != F.col("old")) & (F.col("top.gain") > F.col("now") + 1e-9) & ~alone
        goes = wants & (F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0)
        # the value of the state before these moves, summed over the parts as they are written
        seen = Observation()
        sums_of = [F.sum(inner).alias("inner"), F.sum(spread).alias("spread"), F.count_if(wants).alias("wanting"), F.count_if(goes).alias("going")]
        chosen = stored(per.observe(seen, *sums_of).select("node", F.when(goes, to).otherwise(F.col("old")).alias("comm"), "degree", "m2"))
        known = seen.get
        value = (known["inner"] or 0) - resolution * (known["spread"] or 0.0)
        if best_value is None or value > best_value + 1e-6:
            best, best_value, waited = state, value, 0
        else:
            waited += 1
        if not known["wanting"] or waited >= PATIENCE:
            break
        ever |= known["going"] > 0
        state = chosen
    return best.select("node", "comm"), ever


def contracted(adjacent: DataFrame, state: DataFrame) -> DataFrame:
    """a, b, w of the communities (node, comm) as nodes: weights between two of them add up, those within one are gone."""
    a, b = state.select(F.col("node").alias("a"), F.col("comm").alias("x")), state.select(F.col("node").alias("b"), F.col("comm").alias("y"))
    return adjacent.join(a, "a").join(b, "b").where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w"))


def first_moves(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, community after the local moves of the first level alone, of edges (a, b, w); a community goes by its least node."""
    named = numbered(edges)
    pairs, index = indexed(edges, named), named.select(F.col("i").alias("node"))
    adjacent = stored(both_ways(pairs))
    degrees = adjacent.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    nodes = index.join(degrees, "node", "left").select("node", F.lit(0).cast("bigint").alias("part"), F.coalesce("degree", F.lit(0)).alias("degree"))
    state, _ = moved(adjacent, nodes, resolution)
    home = state.join(named.select("node", F.col("i")).withColumnRenamed("node", "name"), F.col("node") == F.col("i")).select("name", "comm")
    least = home.groupBy("comm").agg(F.min("name").alias("community"))
    return home.join(least, "comm").select(F.col("name").alias("node"), "community")


def partition(pairs: DataFrame, nodes: DataFrame, resolution: float = 1.0) -> DataFrame:
    """node, comm: communities (named by their least node) of each part of a graph. pairs: a, b, w. nodes: node, part."""
    adjacent = stored(both_ways(pairs))
    degrees = adjacent.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    level = stored(nodes.join(degrees, "node", "left").select("node", "part", F.coalesce("degree", F.lit(0)).alias("degree")))
    home = nodes.select("node", F.col("node").alias("comm"))
    while True:
        before = level.count()
        state, any_moved = moved(adjacent, level, resolution)
        # a community goes by its least node
        names = state.groupBy("comm").agg(F.min("node").alias("name"))
        state = stored(state.join(names, "comm").select("node", F.col("name").alias("comm")))
        home = stored(home.join(state.select(F.col("node").alias("comm"), F.col("comm").alias("to")), "comm").select("node", F.col("to").alias("comm")))
        level = stored(level.join(state, "node").groupBy(F.col("comm").alias("node"), "part").agg(F.sum("degree").alias("degree")))
        if not any_moved or level.count() == before:
            return home
        adjacent = stored(contracted(adjacent, state))


def hubs(degrees: DataFrame, percentile: float) -> DataFrame:
    """node of degrees (node, degree) above the nearest-rank percentile; the histogram of degrees is what is ordered."""
    if percentile >= 100:
        return degrees.select("node").limit(0)
    h = degrees.groupBy("degree").agg(F.count("*").alias("c"))
    run = h.withColumn("upto", F.sum("c").over(Window.orderBy("degree"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    place = F.least(F.floor(F.col("n") * percentile / 100), F.col("n") - 1) + 1
    threshold = run.where(F.col("upto") >= place).agg(F.min("degree").alias("threshold"))
    return degrees.join(F.broadcast(threshold), F.col("degree") > F.col("threshold")).select("node")  # one row


def cohesion(pairs: DataFrame, home: DataFrame) -> DataFrame:
    """comm, members, cohesion: the share of possible pairs of members that are edges; 1 for single members."""
    sizes = home.groupBy("comm").agg(F.count("*").alias("members"))
    a, b = home.select(F.col("node").alias("a"), "comm"), home.select(F.col("node").alias("b"), F.col("comm").alias("other"))
    inner = pairs.join(a, "a").join(b, "b").where("comm = other").groupBy("comm").agg(F.count("*").alias("inner"))
    n = F.col("members")
    return sizes.join(inner, "comm", "left").select("comm", "members", F.when(n > 1, F.coalesce("inner", F.lit(0)) / (n * (n - 1) / 2)).otherwise(1.0).alias("cohesion"))


def split(pairs: DataFrame, home: DataFrame, which: DataFrame, resolution: float) -> DataFrame:
    """home with the named communities (comm) divided by a run on their own edges each."""
    chosen = stored(home.join(which, "comm", "left_semi"))
    if chosen.isEmpty():
        return home
    a, b = chosen.select(F.col("node").alias("a"), F.col("comm").alias("x")), chosen.select(F.col("node").alias("b"), F.col("comm").alias("y"))
    inside = pairs.join(a, "a").join(b, "b").where("x = y").select("a", "b", "w")
    parts = partition(inside, chosen.select("node", F.col("comm").alias("part")), resolution)
    return stored(home.join(which, "comm", "left_anti").unionByName(parts))


def numbered(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, i: the ends of edges, and further nodes, by their place in order."""
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    every = (ends if nodes is None else ends.unionByName(nodes.select("node"))).where("node is not null").distinct()
    return stored(ranked(every, "node", name="i"))


def indexed(edges: DataFrame, named: DataFrame) -> DataFrame:
    """a, b, w of the numbers of ends, once for each pair."""
    a, b = named.select(F.col("node").alias("a"), F.col("i").alias("ia")), named.select(F.col("node").alias("b"), F.col("i").alias("ib"))
    return stored(undirected(edges.join(a, "a").join(b, "b").select(F.col("ia").alias("a"), F.col("ib").alias("b"), "w")))


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, hub_percentile: float = 99.5, most_share: float = 0.25, least_split: int = 10, low_cohesion: float = 0.05, low_size: int = 50, previous: DataFrame | None = None) -> DataFrame:
    """node, community of edges (a, b, w) and further nodes (node).

    Communities are numbered by size, the larger first, then by their least member; with `previous` (node, community) they
    take over the numbers of the communities they share most members with.
    """
    named = numbered(edges, nodes)
    pairs = indexed(edges, named)
    adjacent = both_ways(pairs)
    index = named.select(F.col("i").alias("node"))
    degrees = index.join(adjacent.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree")), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))
    held = stored(hubs(degrees, hub_percentile))
    without = lambda c: held.select(F.col("node").alias(c))
    open_pairs = pairs.join(without("a"), "a", "left_anti").join(without("b"), "b", "left_anti").select("a", "b", "w")
    open_nodes = index.join(held, "node", "left_anti")
    home = partition(open_pairs, open_nodes.withColumn("part", F.lit(0).cast("bigint")), resolution)
    most = max(least_split, int(index.count() * most_share))
    large = home.groupBy("comm").agg(F.count("*").alias("n")).where(F.col("n") > most).select("comm")
    home = split(pairs, home, large, resolution)
    loose = cohesion(pairs, home).where((F.col("members") >= low_size) & (F.col("cohesion") < low_cohesion)).select("comm")
    home = split(pairs, home, loose, resolution)
    home = placed(adjacent, home, held)
    sizes = home.groupBy("comm").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    numbers = ranked(sizes, F.desc("n"), "least", name="community").select("comm", "community")
    out = home.join(numbers, "comm").join(named.withColumnRenamed("node", "name"), F.col("node") == F.col("i")).select(F.col("name").alias("node"), "community")
    return out if previous is None else kept_numbers(out, previous)


def placed(adjacent: DataFrame, home: DataFrame, held: DataFrame) -> DataFrame:
    """home and the hubs: each joins the community of its neighbours with most weight, the smaller number among equal ones.

    Hubs with no neighbour placed yet wait for a further round; those that no round places are communities of their own.
    """
    waiting = held
    while not waiting.isEmpty():
        votes = adjacent.join(waiting.select(F.col("node").alias("a")), "a", "left_semi").join(home.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), "comm").agg(F.sum("w").alias("w"))
        found = stored(votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("comm")).alias("c"))).alias("v")).select("node", (-F.col("v.c")).alias("comm")))
        if found.isEmpty():
            return home.unionByName(waiting.select("node", F.col("node").alias("comm")))
        home = stored(home.unionByName(found))
        waiting = stored(waiting.join(found, "node", "left_anti"))
    return home


def matched(overlaps: DataFrame) -> DataFrame:
    """old, new: pairs (old, new, n) taken greedily, the largest n first, then by old and new; each side once.

    A pair that comes first for both of its sides is taken whatever the others are, so all such pairs are taken at once, and
    what they leave is looked at again.
    """
    left, taken = stored(overlaps.select("old", "new", "n")), None
    first = F.min(F.struct((-F.col("n")).alias("m"), "old", "new"))
    while not left.isEmpty():
        by_old, by_new = left.groupBy("old").agg(first.alias("f")).select("f.old", "f.new"), left.groupBy("new").agg(first.alias("f")).select("f.old", "f.new")
        now = stored(by_old.join(by_new, ["old", "new"]))
        taken = now if taken is None else taken.unionByName(now)
        left = stored(left.join(now, "old", "left_anti").join(now, "new", "left_anti"))
    return overlaps.select("old", "new").limit(0) if taken is None else taken


def kept_numbers(found: DataFrame, previous: DataFrame) -> DataFrame:
    """found (node, community) with the numbers of the previous communities that overlap most; others get the least free ones."""
    found = stored(found)
    both = found.join(previous.select("node", F.col("community").alias("old")), "node").groupBy("old", F.col("community").alias("new")).agg(F.count("*").alias("n"))
    pairs = stored(matched(both))
    fresh = ranked(found.select("community").distinct().join(pairs.select(F.col("new").alias("community")), "community", "left_anti"), "community")
    # used numbers u(0) < u(1) < ...: before u(i) lie u(i) - i free ones, so in the order of that the place is the number itself
    used = ranked(pairs.select("old"), "old").select((F.col("old") - F.col("rank")).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("community"), F.col("rank").alias("nth"))
    free = fresh.select(F.col("rank").alias("at"), F.lit(1).alias("kind"), "community", F.col("rank").alias("nth"))
    order = ranked(used.unionByName(free), "at", "kind", "nth", name="number").where("kind = 1").select("community", "number")
    numbers = pairs.select(F.col("new").alias("community"), F.col("old").alias("number")).unionByName(order)
    return found.join(numbers, "community").select("node", F.col("number").alias("community"))


def labelled(home: DataFrame, edges: DataFrame) -> DataFrame:
    """community, size, hub, cohesion of communities (node, community): the hub has the largest weighted degree, the least name among equal ones."""
    pairs = undirected(edges)
    degrees = both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    known = home.join(degrees, "node", "left").select("node", "community", F.coalesce("degree", F.lit(0)).alias("degree"))
    hub = known.groupBy("community").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("h")).select("community", "size", F.col("h.node").alias("hub"))
    inner = cohesion(pairs, home.withColumnRenamed("community", "comm")).select(F.col("comm").alias("community"), "cohesion")
    return hub.join(inner, "community")


def lineage(before: DataFrame, after: DataFrame) -> DataFrame:
    """community, state (new, dissolved, renamed, kept), old_label, label and moved (members that were elsewhere before).

    before, after: node, community, label.
    """
    of = lambda df, c: df.groupBy("community").agg(F.max("label").alias(c), F.count("*").alias(f"in_{c}"))
    came = after.select("node", "community").join(before.select("node", F.col("community").alias("was")), "node").where("community <> was").groupBy("community").agg(F.count("*").alias("moved"))
    both = of(before, "old_label").join(of(after, "label"), "community", "full_outer").join(came, "community", "left")
    state = F.when(F.col("in_old_label").isNull(), "new").when(F.col("in_label").isNull(), "dissolved").when(F.col("old_label") != F.col("label"), "renamed").otherwise("kept")
    return both.select("community", state.alias("state"), "old_label", "label", F.coalesce("moved", F.lit(0)).alias("moved"))


def module_edges(imports: DataFrame, targets: DataFrame, references: DataFrame, definers: DataFrame, import_weight: float = 3.0, symbol_weight: float = 1.0, most_definers: int = 3) -> DataFrame:
    """a, b, w: the graph of files that import and refer to each other.

    imports (file, module), targets (module, file), references (file, symbol), definers (symbol, file), each distinct. An
    import of one file weighs `import_weight`. One of several goes to those that define a symbol which the file refers to, at
    full weight each; where there are none, every target gets its part. A symbol with at most `most_definers` definers links
    the file to each of them.
    """
    wide = imports.select("file", "module").distinct().join(targets.select("module", F.col("file").alias("to")).distinct(), "module")
    count = wide.groupBy("file", "module").agg(F.count("*").alias("n"))
    refers = references.select("file", "symbol").distinct()
    defined = definers.select("symbol", F.col("file").alias("to")).distinct()
    links = refers.join(defined, "symbol").select("file", "to").distinct()
    known = wide.join(links.withColumn("hit", F.lit(1)), ["file", "to"], "left")
    hits = known.groupBy("file", "module").agg(F.count("hit").alias("hits"))
    part = F.when(F.col("n") == 1, import_weight).when(F.col("hits") == 0, import_weight / F.col("n")).when(F.col("hit").isNotNull(), import_weight)
    imported = known.join(count, ["file", "module"]).join(hits, ["file", "module"]).select(F.col("file").alias("a"), F.col("to").alias("b"), part.alias("w")).where("w is not null")
    few = defined.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") <= most_definers).select("symbol")
    by_symbol = refers.join(few, "symbol", "left_semi").join(defined, "symbol").where("file <> to").select(F.col("file").alias("a"), F.col("to").alias("b"), F.lit(symbol_weight).alias("w"))
    return imported.unionByName(by_symbol)


def severity_of_degree(n: Column, threshold: int, low: str, high: str) -> Column:
    return F.when(n >= 2 * threshold, high).when(n >= threshold, low)


def coupling(edges: DataFrame, fan_out: int = 20, fan_in: int = 20, cycles: int = 50) -> DataFrame:
    """node, category, severity, n, members of import edges (src, dst): wide fan-out, wide fan-in of nodes that import
    something themselves, and cycles.

    A cycle is a strongly connected component; of these the first `cycles` by their members count.
    """
    from .graphs import strong_components

    e = edges.where("src <> dst").select("src", "dst").distinct()
    none = F.lit(None).cast(f"array<{e.schema['src'].dataType.simpleString()}>").alias("members")
    own = e.select(F.col("src").alias("node")).distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("category", F.lit("fan-out")).withColumn("severity", severity_of_degree(F.col("n"), fan_out, "warning", "critical"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).join(own, "node", "left_semi").withColumn("category", F.lit("fan-in")).withColumn("severity", severity_of_degree(F.col("n"), fan_in, "info", "warning"))
    wide = out.unionByName(into).where("severity is not null").select("node", "category", "severity", "n", none)
    parts = strong_components(e).groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"))
    found = parts.orderBy("members").limit(cycles).select(F.element_at("members", 1).alias("node"), F.lit("cycle").alias("category"), F.lit("warning").alias("severity"), F.size("members").cast("bigint").alias("n"), "members")
    return wide.unionByName(found)
