"""Joins, merges, retention and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as T
from .filters import DECISIONS, EVENTS, FINDINGS
from .registry import query
from .windows import SYMBOLS

REFS = "(SELECT event_id AS id, greatest(event_id % 2000, 0) + 1 AS file, CAST(user_id * 37 % 2500 AS INT) AS line FROM events) r"
TURNS = "(SELECT conv_id AS session, turn AS seq, role, text FROM conversations) t"


@query(f"SELECT f.id AS id, f.analyzer, length(d.text) AS size FROM {FINDINGS} JOIN documents d ON d.doc_id = f.id WHERE f.severity = 'critical'")
def j1_hits_to_rows(spark, sf):
    hits = T.findings(spark, sf).where("severity = 'critical'").select("id", "analyzer")
    return hits.join(T.memories(spark, sf).select("id", "content"), "id").select("id", "analyzer", F.length("content").cast("bigint").alias("size"))


@query(f"""SELECT id, symbol, span FROM (SELECT r.id, s.symbol, s."end" - s."start" AS span, row_number() OVER (PARTITION BY r.id ORDER BY s."end" - s."start", s.symbol) AS rn
 FROM {REFS} JOIN {SYMBOLS} ON s.file = r.file AND r.line BETWEEN s."start" AND s."end") t WHERE rn = 1""")
def j2_narrowest_range(spark, sf):
    return R.narrowest_range(T.references(spark, sf), T.symbols(spark, sf), "file", "line", "start", "end", "id", "symbol")


@query(f"""SELECT s.symbol, count(DISTINCT r.id) AS callees FROM {SYMBOLS} JOIN {REFS} ON s.file = r.file AND r.line BETWEEN s."start" AND s."end" GROUP BY 1""")
def j3_references_inside(spark, sf):
    cut = T.symbols(spark, sf).withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    met = T.references(spark, sf).withColumn("b", F.floor(F.col("line") / 64)).join(cut, ["file", "b"]).where("line between start and end")
    return met.groupBy("symbol").agg(F.count_distinct("id").alias("callees"))


@query("""SELECT l_orderkey AS name, list_sort(list(DISTINCT l_suppkey)) AS files FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) <= 3""")
def j5_defining_files(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("name")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("files")).where("size(files) <= 3")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM documents) SELECT p_partkey AS id FROM part WHERE lower(string_split(p_name, ' ')[1]) NOT IN (SELECT word FROM w)""")
def j7_name_occurs_nowhere(spark, sf):
    words = T.memories(spark, sf).select(F.explode(F.split(F.lower("content"), " ")).alias("word")).distinct()
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower(F.split("p_name", " ")[0]).alias("word"))
    return p.join(words, "word", "left_anti").select("id")


@query("""SELECT r.symbol, r.n, p.p_name AS name FROM (SELECT l_partkey AS symbol, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, symbol LIMIT 25) r LEFT JOIN part p ON p.p_partkey = r.symbol""")
def j8_top_with_metadata(spark, sf):
    top = R.top_k(T.edges(spark, sf).groupBy(F.col("src").alias("symbol")).agg(F.count("*").alias("n")), 25, F.desc("n"), "symbol")
    return top.join(T.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name")), "symbol", "left")


@query(f"""SELECT d.seq FROM {DECISIONS} WHERE NOT EXISTS (SELECT 1 FROM (SELECT c_custkey AS topic, DATE '1995-01-01' AS gone FROM customer WHERE c_custkey % 5 = 0) t WHERE t.topic = d.topic AND d.created <= t.gone)""")
def j10_blocked_by_tombstone(spark, sf):
    stones = T.table(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("t"), F.lit("1995-01-01").cast("date").alias("gone"))
    d = T.decisions(spark, sf)
    return d.join(stones, (d["topic"] == stones["t"]) & (d["created"] <= stones["gone"]), "left_anti").select("seq")


@query(f"SELECT topic FROM {DECISIONS} GROUP BY topic HAVING max(created) < DATE '1998-03-01'")
def j11_every_version_predates_whole(spark, sf):
    return T.decisions(spark, sf).groupBy("topic").agg(F.max("created").alias("m")).where("m < date'1998-03-01'").select("topic")


@query("""SELECT coalesce(d.doc_id, l.doc_id + 50) AS id, CASE WHEN l.doc_id IS NULL THEN 'unindexed' WHEN d.doc_id IS NULL THEN 'removed' WHEN l.quality = 0 THEN 'stale' ELSE 'fresh' END AS state
 FROM documents d FULL OUTER JOIN labels l ON l.doc_id + 50 = d.doc_id""")
def j12_reconcile(spark, sf):
    d = T.memories(spark, sf).select(F.col("id").alias("d"))
    i = T.table(spark, sf, "labels").select((F.col("doc_id") + 50).alias("i"), "quality")
    state = F.when(F.col("i").isNull(), "unindexed").when(F.col("d").isNull(), "removed").when(F.col("quality") == 0, "stale").otherwise("fresh")
    return d.join(i, F.col("d") == F.col("i"), "full_outer").select(F.coalesce("d", "i").alias("id"), state.alias("state"))


@query(f"""SELECT a.id FROM (SELECT * FROM {EVENTS} WHERE name = 'view') a WHERE NOT EXISTS (SELECT 1 FROM {EVENTS} WHERE e.name = 'purchase' AND e.session = a.session AND e.ts_us BETWEEN a.ts_us AND a.ts_us + 86400000000)""")
def j14_not_followed(spark, sf):
    return R.not_followed(T.events(spark, sf), ["session"], "ts_us", F.col("name") == "view", F.col("name") == "purchase", 86_400_000_000).select("id")


@query(f"""SELECT session, seq, max(p) AS before, min(n) AS after FROM (SELECT u.session, u.seq, CASE WHEN m.seq < u.seq THEN m.seq END AS p, CASE WHEN m.seq > u.seq THEN m.seq END AS n
 FROM (SELECT * FROM {TURNS} WHERE role = 'user') u LEFT JOIN (SELECT session, seq FROM {TURNS} WHERE role = 'assistant') m ON m.session = u.session AND abs(m.seq - u.seq) <= 3) x GROUP BY session, seq""")
def j15_nearest_mutation(spark, sf):
    w = Window.partitionBy("session").orderBy("seq")
    of = F.when(F.col("role") == "assistant", F.col("seq"))
    t = T.turns(spark, sf).select("session", "seq", "role", F.max(of).over(w.rangeBetween(-3, -1)).alias("before"), F.min(of).over(w.rangeBetween(1, 3)).alias("after"))
    return t.where("role = 'user'").select("session", "seq", "before", "after")


@query("""SELECT topic, ring, value FROM (SELECT topic, ring, value, row_number() OVER (PARTITION BY topic ORDER BY ring) AS rn FROM (
 SELECT c_custkey AS topic, 0 AS ring, c_mktsegment AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'peer' FROM customer) u) t WHERE rn = 1""")
def j19_nearest_ring(spark, sf):
    c = T.table(spark, sf, "customer").withColumnRenamed("c_custkey", "topic")
    ring = lambda where, k, v: c.where(where).select("topic", F.lit(k).alias("ring"), v.alias("value"))
    every = ring("topic % 3 = 0", 0, F.col("c_mktsegment")).unionByName(ring("topic % 2 = 0", 1, F.col("c_name"))).unionByName(ring("true", 2, F.lit("peer")))
    return every.groupBy("topic").agg(F.min(F.struct("ring", "value")).alias("b")).select("topic", "b.ring", "b.value")


@query("""SELECT p_partkey AS id, rule FROM part JOIN (VALUES ('big', 'ECO.*', 30), ('small', 'SMALL', 10), ('any', '.*', 45)) r(rule, pattern, least) ON regexp_full_match(p_type, pattern) AND p_size >= least""")
def j20_entry_point_rules(spark, sf):
    # the rules are a fixed list of three rows
    rules = spark.createDataFrame([("big", "ECO.*", 30), ("small", "SMALL", 10), ("any", ".*", 45)], "rule string, pattern string, least int")
    p = T.table(spark, sf, "part")
    return p.join(F.broadcast(rules), F.rlike("p_type", F.concat(F.lit("^"), "pattern", F.lit("$"))) & (p["p_size"] >= rules["least"])).select(F.col("p_partkey").alias("id"), "rule")


@query("SELECT 'document' AS kind, doc_id AS id FROM documents WHERE contains(lower(text), 'stupid') UNION ALL SELECT 'page', page_id FROM pages WHERE contains(lower(html), 'stupid') UNION ALL SELECT 'turn', conv_id FROM conversations WHERE contains(lower(text), 'stupid')")
def u1_cross_search(spark, sf):
    def hits(t, key, text, kind):
        return T.table(spark, sf, t).where(F.contains(F.lower(text), F.lit("stupid"))).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))

    return hits("documents", "doc_id", "text", "document").unionByName(hits("pages", "page_id", "html", "page")).unionByName(hits("conversations", "conv_id", "text", "turn"))


@query("SELECT id FROM (SELECT doc_id AS id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE n_chars < 100) t")
def u2_union_distinct(spark, sf):
    a = T.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return a.unionByName(T.memories(spark, sf).where("size < 100").select("id")).distinct()


@query("SELECT min(doc_id) AS id, sha1(lang || chr(0) || text) AS signature FROM documents WHERE doc_id % 2 = 0 AND sha1(lang || chr(0) || text) NOT IN (SELECT sha1(lang || chr(0) || text) FROM documents WHERE doc_id % 2 = 1) GROUP BY 2")
def u6_dedup_by_signature(spark, sf):
    m = T.memories(spark, sf).select("id", F.sha1(F.concat("category", F.lit("\0"), "content").cast("binary")).alias("signature"))
    fresh = m.where("id % 2 = 0").groupBy("signature").agg(F.min("id").alias("id"))
    return fresh.join(m.where("id % 2 = 1").select("signature"), "signature", "left_anti").select("id", "signature")


@query(f"SELECT id FROM {EVENTS} WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def r1_event_retention(spark, sf):
    e = T.events(spark, sf)
    cut = e.agg((F.max("ts") - F.expr("interval 10 days")).alias("cut"))
    return e.join(F.broadcast(cut), F.col("ts") >= F.col("cut")).select("id")


@query("SELECT l_orderkey AS agent, l_linenumber AS field FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS newest FROM lineitem) t WHERE newest >= TIMESTAMP '1996-01-01'")
def r5_group_staleness(spark, sf):
    s = T.state(spark, sf)
    kept = s.groupBy("agent").agg(F.max("updated").alias("newest")).where("newest >= date'1996-01-01'").select("agent")
    return s.join(kept, "agent", "left_semi").select("agent", "field")


@query(f"SELECT id, CASE WHEN name = 'error' AND k < 30 THEN 'expired' ELSE name END AS status FROM {EVENTS} WHERE NOT (name = 'signup' AND k < 50)")
def r6_proposal_cleanup(spark, sf):
    e = T.events(spark, sf).where(~((F.col("name") == "signup") & (F.col("k") < 50)))
    return e.select("id", F.when((F.col("name") == "error") & (F.col("k") < 30), "expired").otherwise(F.col("name")).alias("status"))
