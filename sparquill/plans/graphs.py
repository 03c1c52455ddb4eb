"""Coupling, modules and communities: cities that clients move between, and items as files that vendors link."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators.relational import ranked
from ..sources import tables as T
from .registry import query

MOVES = "(SELECT src, dst, valid_at FROM (SELECT city AS src, lead(city) OVER w AS dst, lead(valid_at) OVER w AS valid_at FROM client_changes WHERE client_id IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY seq, change_id)) m WHERE src <> dst)"
EDGES = f"(SELECT DISTINCT src, dst FROM {MOVES})"
CYCLES = f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
 s AS (SELECT x.a AS node, list_sort(list(x.b)) AS members FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(*) > 1), c AS (SELECT DISTINCT members FROM s ORDER BY members LIMIT 50)"""


def moves(spark, sf):
    """src, dst, at: a client's city and the next one, and when it came."""
    w = Window.partitionBy("client_id").orderBy("seq", "change_id")
    c = T.table(spark, sf, "client_changes").where("client_id is not null").withColumns({"dst": F.lead("city").over(w), "at": F.lead("valid_at").over(w)})
    return c.where("city <> dst").select(F.col("city").alias("src"), "dst", "at")


@query(f"""{CYCLES}, o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1)
 SELECT node, 'fan-out' AS category, CASE WHEN n >= 24 THEN 'critical' ELSE 'warning' END AS severity, n, CAST(NULL AS VARCHAR[]) AS members FROM o WHERE n >= 12
 UNION ALL SELECT node, 'fan-in', CASE WHEN n >= 24 THEN 'warning' ELSE 'info' END, n, NULL FROM i WHERE n >= 12 AND node IN (SELECT node FROM o) UNION ALL SELECT members[1], 'cycle', 'warning', len(members), members FROM c""")
def f2_coupling_findings(spark, sf):
    """Degrees and cycles with their severities, the first fifty cycles by their members."""
    return C.coupling(moves(spark, sf), 12, 12)


@query(f"{CYCLES} SELECT members[1] AS first, len(members) AS n FROM c")
def t10_first_cycles(spark, sf):
    return C.coupling(moves(spark, sf)).where("category = 'cycle'").select(F.col("node").alias("first"), "n")


def city_links(spark, sf):
    return moves(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w"))


@query()
def f13_communities(spark, sf):
    """Communities of cities, hubs held out, by local moves and contraction."""
    return C.communities(city_links(spark, sf))


@query()
def f14_local_moves(spark, sf):
    """Cities after the local moves of the first level."""
    return C.first_moves(city_links(spark, sf))


@query(f"""WITH p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM {MOVES} GROUP BY 1, 2), v AS (SELECT a, b, w FROM p UNION ALL SELECT b, a, w FROM p), s AS (SELECT a AS node, min(least(a, b)) AS comm FROM v GROUP BY a)
 SELECT x.comm AS a, y.comm AS b, CAST(sum(w) * 1048576 AS BIGINT) AS w FROM v JOIN s x ON x.node = v.a JOIN s y ON y.node = v.b WHERE x.comm <> y.comm GROUP BY 1, 2""")
def f15_supernodes(spark, sf):
    """Each city goes to the least of itself and its neighbours; the weights between these groups."""
    adjacent = C.both_ways(C.undirected(city_links(spark, sf)))
    return C.contracted(adjacent, adjacent.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comm")))


LINES = "(SELECT i.brand || '/' || i.kind || '/' || i.item_id AS file, l.vendor_id AS vendor, l.flag FROM sale_lines l JOIN items i ON i.item_id = l.item_id WHERE l.vendor_id IS NOT NULL AND i.brand IS NOT NULL AND i.kind IS NOT NULL)"


def item_lines(spark, sf):
    i = T.table(spark, sf, "items").select("item_id", F.concat("brand", F.lit("/"), "kind", F.lit("/"), F.col("item_id").cast("string")).alias("file"))
    return T.table(spark, sf, "sale_lines").join(i, "item_id").select("file", F.col("vendor_id").alias("vendor"), "flag").where("file is not null and vendor is not null")


def module_links(spark, sf):
    """Items are files: a swapped line imports its vendor, whose files are the items it had returned; a kept line refers to it,
    and who has fewest of a vendor's lines defines it."""
    lines = item_lines(spark, sf)
    named = lambda flag, c: lines.where(F.col("flag") == flag).select("file", F.col("vendor").alias(c)).distinct()
    definers = lines.where("flag = 'kept'").groupBy("file", "vendor").agg(F.count("*").alias("n")).groupBy(F.col("vendor").alias("symbol")).agg(F.min(F.struct("n", "file")).alias("f")).select("symbol", "f.file")
    return C.module_edges(named("swapped", "module"), named("returned", "module").select("module", "file"), named("kept", "symbol"), definers)


@query(f"""WITH l AS {LINES}, w AS (SELECT x.file, x.vendor, y.file AS t FROM (SELECT DISTINCT file, vendor FROM l WHERE flag = 'swapped') x JOIN (SELECT DISTINCT file, vendor FROM l WHERE flag = 'returned') y USING (vendor)),
 d AS (SELECT vendor AS symbol, arg_min(file, (n, file)) AS file FROM (SELECT file, vendor, count(*) AS n FROM l WHERE flag = 'kept' GROUP BY ALL) GROUP BY vendor), r AS (SELECT DISTINCT file, vendor AS symbol FROM l WHERE flag = 'kept'),
 k AS (SELECT DISTINCT r.file, d.file AS t FROM r JOIN d USING (symbol)), h AS (SELECT w.*, k.t IS NOT NULL AS hit, count(*) OVER (PARTITION BY w.file, w.vendor) AS n, count(k.t) OVER (PARTITION BY w.file, w.vendor) AS hits FROM w LEFT JOIN k ON k.file = w.file AND k.t = w.t),
 u AS (SELECT file AS a, t AS b, CASE WHEN n = 1 OR hit THEN 3.0 ELSE 3.0 / n END AS w FROM h WHERE n = 1 OR hits = 0 OR hit UNION ALL SELECT r.file, d.file, 1.0 FROM r JOIN d USING (symbol) WHERE r.file <> d.file)
 SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(round(sum(w) * 1048576) AS BIGINT) AS w FROM u WHERE a <> b GROUP BY 1, 2""")
def f12_module_graph(spark, sf):
    """The weighted graph of files before it is clustered."""
    return C.undirected(module_links(spark, sf))


def homes(spark, sf, until):
    """node, community, segment: each client's last known city before a time."""
    c = T.table(spark, sf, "client_changes").where(f"client_id is not null and valid_at < timestamp_ntz'{until}'")
    last = c.groupBy(F.col("client_id").alias("node")).agg(F.max_by(F.struct("city", "segment"), F.struct("valid_at", "seq", "change_id")).alias("l"))
    return last.select("node", F.col("l.city").alias("community"), F.col("l.segment").alias("segment")).where("community is not null")


def with_labels(home):
    """Each community goes by the segment that most of its members have, the least of equally frequent ones."""
    counted = home.where("segment is not null").groupBy("community", "segment").agg(F.count("*").alias("n"))
    label = counted.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "segment")).alias("l")).select("community", F.col("l.segment").alias("label"))
    return home.join(label, "community", "left").select("node", "community", "label")


def homes_sql(name: str, until: str) -> str:
    return f"""{name}h AS (SELECT node, l.city AS community, l.segment AS segment FROM (SELECT client_id AS node, arg_max({{'city': city, 'segment': segment}}, (valid_at, seq, change_id)) AS l FROM client_changes WHERE client_id IS NOT NULL AND valid_at < TIMESTAMP '{until}' GROUP BY client_id) x WHERE l.city IS NOT NULL),
 {name}c AS (SELECT community, arg_min(segment, (-n, segment)) AS label FROM (SELECT community, segment, count(*) AS n FROM {name}h WHERE segment IS NOT NULL GROUP BY ALL) GROUP BY community), {name} AS (SELECT DISTINCT h.community, c.label FROM {name}h h LEFT JOIN {name}c c ON c.community = h.community)"""


@query(f"""WITH {homes_sql("b", "2024-03-01")}, {homes_sql("a", "2024-12-01")}, m AS (SELECT x.community, count(*) AS moved FROM ah x JOIN bh y ON y.node = x.node WHERE x.community <> y.community GROUP BY x.community)
 SELECT coalesce(b.community, a.community) AS community, CASE WHEN b.community IS NULL THEN 'new' WHEN a.community IS NULL THEN 'dissolved' WHEN b.label <> a.label THEN 'renamed' ELSE 'kept' END AS state, coalesce(moved, 0) AS moved FROM b FULL JOIN a ON a.community = b.community LEFT JOIN m ON m.community = coalesce(b.community, a.community)""")
def j18_lineage_diff(spark, sf):
    """Cities as communities of clients at two times: new, dissolved, renamed, and how many members have moved in."""
    return C.lineage(with_labels(homes(spark, sf, "2024-03-01 00:00:00")), with_labels(homes(spark, sf, "2024-12-01 00:00:00"))).select("community", "state", "moved")


@query()
def f16_numbers_that_stay(spark, sf):
    """Communities that were numbered anew get the numbers of the earlier ones they share most members with."""

    def numbered(home):
        names = home.groupBy("community").agg(F.count("*").alias("n"))
        numbers = ranked(names, F.desc("n"), "community", name="number").select("community", "number")
        return home.join(numbers, "community").select("node", F.col("number").alias("community"))

    return C.kept_numbers(numbered(homes(spark, sf, "2024-12-01 00:00:00")), numbered(homes(spark, sf, "2024-03-01 00:00:00")))
