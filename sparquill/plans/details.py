"""Single parts of scores, of texts and of the code's structure, as rows of their own."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graphs as G
from ..sources import tables as T
from .detectors import TOOL_EVENTS
from .filters import EVENTS, MEMORIES
from .graphs import EDGES, MOVES, moves
from .registry import query
from .source import PAGE_LINES, page_files

#: What tags add to a memory's score, and the weight of a global preference.
BOOSTS = {"src1": 0.3, "src2": 0.2, "lang:en": 0.8, "long": 0.1}
GLOBAL_PREFERENCE = 1.0
NOW = 1_704_900_000_000_000


@query(f"SELECT id, round(CASE WHEN ts_us >= {NOW} THEN 1.0 ELSE pow(0.5, ({NOW} - ts_us) / 86400000000.0 / 30.0) END, 6) AS recency FROM {EVENTS}")
def fm1_recency(spark, sf):
    """Half of it is left after thirty days; the future counts as now."""
    age = (F.lit(NOW) - F.col("ts_us")) / 86_400_000_000
    return T.events(spark, sf).select("id", F.round(S.recency(age), 6).alias("recency"))


@query(f"SELECT session, round(least(1.0, log10(count(*) + 1)), 6) AS factor FROM {EVENTS} GROUP BY session")
def fm2_access_factor(spark, sf):
    return T.events(spark, sf).groupBy("session").agg(F.count("*").alias("n")).select("session", F.round(S.access_factor(F.col("n")), 6).alias("factor"))


@query(f"SELECT id, CASE WHEN category = 'en' AND list_contains(tags, 'src1') THEN 1.0 ELSE CASE category WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.6 WHEN 'es' THEN 0.5 ELSE 0.4 END END AS weight FROM {MEMORIES}")
def fm3_category_weight(spark, sf):
    """A learning that holds everywhere weighs most, whatever its category."""
    override = (F.col("category") == "en") & F.array_contains("tags", "src1")
    return T.memories(spark, sf).select("id", F.when(override, GLOBAL_PREFERENCE).otherwise(S.lookup(F.col("category"), S.CATEGORY_WEIGHTS, 0.4)).alias("weight"))


@query(f"SELECT id, round(least(1.0, list_sum(list_transform(tags, lambda t: CASE t WHEN 'src1' THEN 0.3 WHEN 'src2' THEN 0.2 WHEN 'lang:en' THEN 0.8 WHEN 'long' THEN 0.1 ELSE 0.0 END))), 6) AS boost FROM {MEMORIES}")
def fm4_provenance(spark, sf):
    boost = F.aggregate(F.transform("tags", lambda t: S.lookup(t, BOOSTS, 0.0)), F.lit(0.0), lambda a, b: a + b)
    return T.memories(spark, sf).select("id", F.round(S.clamp(boost), 6).alias("boost"))


@query("SELECT vendor_id, round(count(*) * (1 + sum(quantity) / 100), 6) AS score FROM sale_lines WHERE vendor_id IS NOT NULL AND quantity IS NOT NULL GROUP BY vendor_id")
def fm7_churn_score(spark, sf):
    lines = T.table(spark, sf, "sale_lines").where("vendor_id is not null and quantity is not null")
    return lines.groupBy("vendor_id").agg(F.round(S.churn_score(F.count("*"), F.sum("quantity")), 6).alias("score"))


@query(f"""WITH p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM {MOVES} GROUP BY 1, 2), v AS (SELECT a, b, w FROM p UNION ALL SELECT b, a, w FROM p), d AS (SELECT a AS node, sum(w) AS k FROM v GROUP BY a)
 SELECT v.a, v.b, round(v.w - x.k * y.k / (SELECT sum(k) FROM d), 6) AS gain FROM v JOIN d x ON x.node = v.a JOIN d y ON y.node = v.b""")
def fm8_first_gains(spark, sf):
    """What each node would gain by joining each neighbour, while all are alone."""
    p = moves(spark, sf).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w"))
    v = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    d = v.groupBy("a").agg(F.sum("w").alias("k"))
    total = d.agg(F.sum("k").alias("m2"))  # one row
    out = v.join(d, "a").join(d.select(F.col("a").alias("b"), F.col("k").alias("other")), "b").join(F.broadcast(total))
    return out.select("a", "b", F.round(F.col("w") - F.col("k") * F.col("other") / F.col("m2"), 6).alias("gain"))


@query("SELECT client_id AS id, coalesce(nullif(trim(city), ''), nullif(trim(email), ''), nullif(trim(name), '')) AS said FROM clients")
def fs4_first_text(spark, sf):
    """The first of several fields that isn't empty."""
    return T.table(spark, sf, "clients").select(F.col("client_id").alias("id"), S.first_filled("city", "email", "name").alias("said"))


@query("SELECT doc_id AS id, CASE WHEN lang = 'en' THEN n_chars ELSE (strlen(text) + 2) // 3 END AS cost FROM documents")
def fs13_cost_unless_known(spark, sf):
    """A known cost, else a third of the bytes, rounded up."""
    m = T.memories(spark, sf)
    return m.select("id", S.cost(F.when(F.col("category") == "en", F.col("size")), F.col("content")).alias("cost"))


@query(f"SELECT id, lower(trim(coalesce(file, ''))) IN ('1', 'true', 'yes', 'on') AS truth FROM {TOOL_EVENTS}")
def fs20_truth(spark, sf):
    return T.tool_events(spark, sf).select("id", S.truthy(F.col("file")).alias("truth"))


@query("""SELECT DISTINCT raw AS q, CASE WHEN regexp_matches(raw, '[*?:+"~^()-]') THEN raw ELSE '*' || raw || '*' END AS pattern FROM stamps WHERE raw IS NOT NULL""")
def x11_wildcards(spark, sf):
    """A query without any syntax of its own matches anywhere."""
    return T.table(spark, sf, "stamps").where("raw is not null").select(F.col("raw").alias("q"), S.wildcards(F.col("raw")).alias("pattern")).distinct()


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(*) > 1""")
def f3_strong_components(spark, sf):
    return G.strong_components(moves(spark, sf).select("src", "dst"))


PATHS = "(SELECT DISTINCT string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS p FROM pages) u"


@query(f"""SELECT root, list_sort(list(DISTINCT kind)) AS kinds FROM (SELECT p[1] AS root, 'file:page' AS kind FROM {PATHS} WHERE ends_with(p[len(p)], '.html') UNION ALL SELECT p[1], 'directory:english' FROM {PATHS} WHERE p[2] = 'en'
 UNION ALL SELECT root, 'sibling:translated' FROM (SELECT p[1] AS root, p[2] AS lang FROM {PATHS} WHERE p[2] IN ('fr', 'de', 'es') GROUP BY ALL) s GROUP BY root HAVING count(*) >= 2) k GROUP BY root""")
def f9_topology(spark, sf):
    """What hosts are by their markers: a file's ending, a directory, directories that stand side by side."""
    p = F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/")
    paths = T.table(spark, sf, "pages").select(F.element_at(p, 1).alias("root"), F.try_element_at(p, F.lit(2)).alias("dir"), F.element_at(p, -1).alias("file")).distinct()
    kind = lambda df, k: df.select("root", F.lit(k).alias("kind"))
    siblings = paths.where("dir in ('fr', 'de', 'es')").groupBy("root").agg(F.count_distinct("dir").alias("n")).where("n >= 2")
    every = kind(paths.where(F.endswith("file", F.lit(".html"))), "file:page").unionByName(kind(paths.where("dir = 'en'"), "directory:english")).unionByName(kind(siblings, "sibling:translated"))
    return every.groupBy("root").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


@query("""SELECT item_id AS id, rule FROM items JOIN (VALUES ('large', '^large ', 'garden', 10), ('bolt', ' bolt$', '', 30), ('any', '.', 'toys', 45)) r(rule, pattern, of, least) ON regexp_matches(name, pattern) AND (of = '' OR of = kind) AND size >= least AND regexp_matches(name, '^[a-z]')""")
def f10_entry_points(spark, sf):
    """Exported symbols that a rule on name, kind and size makes entry points."""
    rules = spark.createDataFrame([("large", "^large ", "garden", 10), ("bolt", " bolt$", "", 30), ("any", ".", "toys", 45)], "rule string, pattern string, of string, least int")  # a fixed list
    i = T.table(spark, sf, "items").where(F.rlike("name", F.lit("^[a-z]")))
    met = F.rlike("name", F.col("pattern")) & ((F.col("of") == "") | (F.col("of") == F.col("kind"))) & (F.col("size") >= F.col("least"))
    return i.join(F.broadcast(rules), met).select(F.col("item_id").alias("id"), "rule")


@query("""WITH s AS (SELECT source, min(change_id) AS stamp FROM client_changes WHERE valid_at >= TIMESTAMP '2024-04-01' AND source IS NOT NULL GROUP BY source)
 SELECT c.source, stamp IS NOT NULL AS found, least(500, count(*) FILTER (stamp IS NULL OR change_id > stamp)) AS behind FROM client_changes c LEFT JOIN s ON s.source = c.source WHERE c.source IS NOT NULL GROUP BY c.source, stamp""")
def f18_freshness(spark, sf):
    """How many changes of its source lie behind the stamped one, 500 at most; all of them where there is no stamp."""
    c = T.table(spark, sf, "client_changes").where("source is not null")
    stamps = c.where("valid_at >= timestamp_ntz'2024-04-01 00:00:00'").groupBy("source").agg(F.min("change_id").alias("stamp"))
    out = c.join(stamps, "source", "left").groupBy("source", "stamp").agg(F.count_if(F.col("stamp").isNull() | (F.col("change_id") > F.col("stamp"))).alias("n"))
    return out.select("source", F.col("stamp").isNotNull().alias("found"), F.least(F.lit(500), "n").alias("behind"))


@query(f"""WITH d AS (SELECT *, sum(CASE WHEN contains(text, '<article') THEN 1 ELSE 0 END) OVER w AS opened, sum(CASE WHEN contains(text, '</article>') THEN 1 ELSE 0 END) OVER w AS closed FROM {PAGE_LINES} WINDOW w AS (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 o AS (SELECT *, opened - closed > 0 AND NOT contains(text, '<article') AS body FROM d)
 SELECT id, line_no, text FROM o WHERE NOT body UNION ALL SELECT id, min(line_no), '... ' || count(*) || ' lines' FROM o WHERE body GROUP BY id, opened""")
def f19_outline(spark, sf):
    """The lines of a page without the bodies of its articles, which become one line each."""
    lines = page_files(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line_no"), "text")
    starts, ends = F.contains("text", F.lit("<article")), F.contains("text", F.lit("</article>"))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumns({"opened": F.count_if(starts).over(w), "closed": F.count_if(ends).over(w)}).withColumn("body", (F.col("opened") > F.col("closed")) & ~starts)
    bodies = marked.where("body").groupBy("id", "opened").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n"))
    return marked.where("not body").select("id", "line_no", "text").unionByName(bodies.select("id", "line_no", F.concat(F.lit("... "), "n", F.lit(" lines")).alias("text")))


@query("""SELECT id, file, start, "end", span FROM (SELECT l_partkey AS file, l_orderkey * 10 + l_linenumber AS id, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS start, CAST(l_shipdate AS DATE) - DATE '1992-01-01' + CAST(l_quantity AS INT) AS "end", CAST(l_quantity AS INT) AS span FROM lineitem) s WHERE span >= 45 ORDER BY file, start, id""")
def t9_ordered_output(spark, sf):
    """Found ranges by file and first line."""
    s = T.symbols(spark, sf).select(F.col("symbol").alias("id"), "file", "start", "end", (F.col("end") - F.col("start")).alias("span"))
    return s.where("span >= 45").orderBy("file", "start", "id")

