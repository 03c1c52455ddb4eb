"""Further predicates, mutations, retention rules, aggregates and analyzers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import DECISIONS, EVENTS, FINDINGS, MEMORIES
from .registry import query


@query(f"SELECT id, kind FROM {EVENTS} WHERE kind = 'failure' AND session = 3")
def s28_tasks_by_status(spark, sf):
    return T.events(spark, sf).where("kind = 'failure' and session = 3").select("id", "kind")


@query(f"SELECT id, analyzer FROM {FINDINGS} WHERE contains(file, 'en/src') ORDER BY id LIMIT 1000")
def s32_file_findings(spark, sf):
    return R.top_k(T.findings(spark, sf).where(F.contains("file", F.lit("en/src"))).select("id", "analyzer"), 1000, "id")


@query("SELECT page_id AS id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^https?://')")
def s33_import_extraction(spark, sf):
    p = T.table(spark, sf, "pages").where(F.rlike("url", F.lit("^https?://")))
    return p.select(F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))


@query("""WITH p AS (SELECT DISTINCT lang || '/' || source AS path FROM documents UNION SELECT DISTINCT lang FROM documents WHERE lang IN ('en', 'de')) SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE starts_with(p.path, q.path || '/'))""")
def s34_nested_projects(spark, sf):
    m = T.memories(spark, sf)
    paths = m.select(F.concat_ws("/", "category", "source").alias("path")).unionByName(m.where("category in ('en', 'de')").select(F.col("category").alias("path"))).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    # each path meets only its own ancestors
    covered = paths.where(F.size(parts) > 1).select("path", F.explode(above).alias("up")).join(paths.select(F.col("path").alias("up")), "up", "left_semi").select("path")
    return paths.join(covered, "path", "left_anti")


@query(f"SELECT id, CASE WHEN session % 10 = 1 THEN 'all' ELSE CAST(session AS VARCHAR) END AS addressee FROM {EVENTS} WHERE (session % 10 = 1 OR session = 7) AND k >= 20")
def p13_messages_for_agent(spark, sf):
    e = T.events(spark, sf).where("(session % 10 = 1 or session = 7) and k >= 20")
    return e.select("id", F.when(F.col("session") % 10 == 1, "all").otherwise(F.col("session").cast("string")).alias("addressee"))


@query("SELECT p_partkey AS id FROM part WHERE p_type NOT IN ('SMALL') AND NOT regexp_matches(p_name, 'bolt|^hot') AND upper(p_name[1:1]) <> '_' AND p_size > 5")
def p20_dead_code_eligible(spark, sf):
    p = T.table(spark, sf, "part")
    return p.where(~F.col("p_type").isin("SMALL") & ~F.rlike("p_name", F.lit("bolt|^hot")) & (F.substring("p_name", 1, 1) != "_") & (F.col("p_size") > 5)).select(F.col("p_partkey").alias("id"))


@query("""SELECT session, prompts, CAST(seq AS BIGINT) AS last_seq, role = 'user' AS waiting FROM (SELECT conv_id AS session, turn AS seq, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS prompts, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) t WHERE rn = 1""")
def p25_agent_signals(spark, sf):
    t = T.turns(spark, sf).groupBy("session").agg(F.count_if(F.col("role") == "user").alias("prompts"), F.max(F.struct("seq", "role")).alias("last"))
    return t.select("session", "prompts", F.col("last.seq").alias("last_seq"), (F.col("last.role") == "user").alias("waiting"))


@query(f"""SELECT session, CAST(sum(w) FILTER (ts_us // 86400000000 = now // 86400000000) AS BIGINT) AS today, CAST(sum(w) FILTER (ts_us > now - 18000000000) AS BIGINT) AS last_5h, CAST(sum(w) AS BIGINT) AS weighted
 FROM (SELECT session, ts_us, tokens + k + floor(0.1 * tokens) + floor(1.25 * k) AS w, max(ts_us) OVER () AS now FROM {EVENTS}) x GROUP BY session""")
def a18_usage_windows(spark, sf):
    """Today and the last five hours, up to the newest event."""
    e = T.events(spark, sf)
    weighted = F.col("tokens") + F.col("k") + F.floor(F.col("tokens") * F.lit(0.1)) + F.floor(F.col("k") * F.lit(1.25))
    # one row
    e = e.withColumn("w", weighted).join(F.broadcast(e.agg(F.max("ts_us").alias("now"))))
    total = lambda c: F.sum(F.when(c, F.col("w"))).cast("bigint")
    return e.groupBy("session").agg(total(F.expr("ts_us div 86400000000 = now div 86400000000")).alias("today"), total(F.expr("ts_us > now - 18000000000")).alias("last_5h"), F.sum("w").cast("bigint").alias("weighted"))


@query("""WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey), m AS (SELECT a % 7 AS g, count(*) AS inside FROM e WHERE a % 7 = b % 7 GROUP BY 1),
 n AS (SELECT p_partkey % 7 AS g, count(*) AS n FROM part GROUP BY 1) SELECT g, inside, n, round(inside / ((n * (n - 1)) // 2), 9) AS cohesion FROM m JOIN n USING (g)""")
def a17_cohesion(spark, sf):
    e = T.edges(spark, sf).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    inside = e.where("a % 7 = b % 7").groupBy((F.col("a") % 7).alias("g")).agg(F.count("*").alias("inside"))
    n = T.table(spark, sf, "part").groupBy((F.col("p_partkey") % 7).alias("g")).agg(F.count("*").alias("n"))
    return inside.join(n, "g").withColumn("cohesion", F.round(F.col("inside") / F.expr("(n * (n - 1)) div 2"), 9))


@query("""SELECT lang, lo, hi, CAST(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda k: lo[1:k] = hi[1:k])) AS BIGINT) AS shared FROM (SELECT lang, min(source) AS lo, max(source) AS hi FROM documents GROUP BY lang) t""")
def a20_common_prefix_whole(spark, sf):
    g = T.memories(spark, sf).groupBy(F.col("category").alias("lang")).agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))), lambda k: F.substring(F.col("lo"), F.lit(1), k) == F.substring(F.col("hi"), F.lit(1), k))
    return g.withColumn("shared", F.array_max(same).cast("bigint"))


@query("SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(source, 'src1.*') THEN 'src1*' WHEN lang = 'fr' THEN 'fr' ELSE 'published' END AS pattern FROM documents) t GROUP BY pattern")
def a27_filter_preview(spark, sf):
    first = F.when(F.rlike("source", F.lit(S.glob_to_regex("src1*"))), "src1*").when(F.col("category") == "fr", "fr").otherwise("published")
    return T.memories(spark, sf).groupBy(first.alias("pattern")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(sum(n) AS BIGINT) AS calls, CAST(sum(n - 1) AS BIGINT) AS pruned, count(*) FILTER (n > 1) AS texts_repeated, CAST(sum((n - 1) * b) AS BIGINT) AS bytes_saved, CAST(sum(b) AS BIGINT) AS context_bytes FROM (SELECT md5(text) AS h, count(*) AS n, octet_length(encode(any_value(text))) AS b FROM documents GROUP BY 1) t""")
def a33_pruning_statistics(spark, sf):
    g = T.memories(spark, sf).groupBy(F.md5(F.col("content").cast("binary")).alias("h")).agg(F.count("*").alias("n"), F.max(F.octet_length("content")).cast("bigint").alias("b"))
    return g.agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("pruned"), F.count_if(F.col("n") > 1).alias("texts_repeated"), F.sum((F.col("n") - 1) * F.col("b")).alias("bytes_saved"), F.sum("b").alias("context_bytes"))


@query("""SELECT id, target FROM (SELECT p.p_partkey AS id, c.target, row_number() OVER (PARTITION BY p.p_partkey ORDER BY c.rank) AS rn FROM part p JOIN (SELECT s_name AS target, s_suppkey AS key, 1 AS rank FROM supplier UNION ALL SELECT n_name, n_nationkey, 2 FROM nation) c ON c.key = p.p_size) t WHERE rn = 1""")
def j16_import_resolution(spark, sf):
    unit = T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).alias("rank"), F.col("s_name").alias("target"))
    unit = unit.unionByName(T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.lit(2).alias("rank"), F.col("n_name").alias("target")))
    best = unit.groupBy("key").agg(F.min_by("target", "rank").alias("target"))
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("key")).join(best, "key").select("id", "target")


@query(f"SELECT DISTINCT id FROM (SELECT id FROM {MEMORIES} WHERE list_has_any(tags, ['src4', 'src5']) AND NOT list_contains(tags, 'forget') UNION ALL SELECT id FROM {MEMORIES} WHERE id IN (3, 5, 8)) u")
def j21_superseded_memories(spark, sf):
    m = T.memories(spark, sf)
    a = m.where(S.any_tag(F.col("tags"), ["src4", "src5"]) & ~F.array_contains("tags", "forget")).select("id")
    return a.unionByName(m.where(F.col("id").isin(3, 5, 8)).select("id")).distinct()


@query(f"SELECT topic, max(created) AS deleted FROM {DECISIONS} WHERE created >= DATE '1996-01-01' GROUP BY topic")
def r8_live_tombstones_whole(spark, sf):
    return T.decisions(spark, sf).where("created >= date'1996-01-01'").groupBy("topic").agg(F.max("created").alias("deleted"))


@query(f"SELECT id FROM {EVENTS} WHERE NOT (name = 'purchase' AND (k IS NULL OR k < 40))")
def r3_done_tasks(spark, sf):
    return T.events(spark, sf).where(~((F.col("name") == "purchase") & (F.col("k").isNull() | (F.col("k") < 40)))).select("id")


@query("""SELECT node, fan_out, fan_in FROM (SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS fan_out FROM lineitem GROUP BY 1) o FULL OUTER JOIN (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS fan_in FROM lineitem GROUP BY 1) i USING (node)""")
def f2_coupling_degrees(spark, sf):
    e = T.edges(spark, sf).select("src", "dst").distinct()
    out, into = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out")), e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(into, "node", "full_outer")


@query("""SELECT p_partkey AS id FROM part WHERE p_size > 5 AND p_type <> 'SMALL' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)""")
def f4_dead_code(spark, sf):
    p = T.table(spark, sf, "part").where("p_size > 5 and p_type <> 'SMALL'").select(F.col("p_partkey").alias("id"))
    return p.join(T.edges(spark, sf).where("w >= 48").select(F.col("src").alias("id")), "id", "left_anti")


@query("""SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS indexed, coalesce(l.quality = 1, false) AS fresh, CAST(floor(d.n_chars / 3.0 + 0.5) AS BIGINT) AS tokens FROM documents d LEFT JOIN labels l USING (doc_id)""")
def f20_read_check(spark, sf):
    i = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    out = T.memories(spark, sf).select("id", "size").join(i, "id", "left")
    return out.select("id", F.col("quality").isNotNull().alias("indexed"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("fresh"), S.estimated_tokens(F.col("size"), F.lit(3.0)).alias("tokens"))


@query()
def f22_mining_findings(spark, sf):
    return R.mining(T.events(spark, sf))


@query(f"SELECT id, CASE WHEN name = 'error' THEN 'failed:' || kind ELSE coalesce(kind, name) END AS signature FROM {EVENTS}")
def fs7_failure_signature(spark, sf):
    return T.events(spark, sf).select("id", F.when(F.col("name") == "error", F.concat(F.lit("failed:"), "kind")).otherwise(F.coalesce("kind", "name")).alias("signature"))


@query("SELECT page_id AS id, trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '-') AS path FROM pages")
def fs21_topic_path(spark, sf):
    return T.table(spark, sf, "pages").select(F.col("page_id").alias("id"), S.topic_path(F.col("url")).alias("path"))


@query("SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 ELSE 1 END AS rank FROM labels")
def fm9_severity_rank(spark, sf):
    return T.findings(spark, sf).select("id", S.severity_rank(F.col("severity")).alias("rank"))


@query("SELECT doc_id AS id, coalesce(TRY_CAST(regexp_extract(text, '[0-9]+', 0) AS BIGINT), 0) AS n FROM documents")
def fj1_map_int_whole(spark, sf):
    return T.memories(spark, sf).select("id", S.map_int(F.regexp_extract("content", "[0-9]+", 0)).alias("n"))


@query(f"SELECT f.id, f.analyzer FROM {FINDINGS} JOIN documents d ON d.doc_id = f.id WHERE f.analyzer = 'src7' AND contains(lower(d.text), 'th')")
def x8_findings_search(spark, sf):
    hits = T.findings(spark, sf).where("analyzer = 'src7'").select("id", "analyzer")
    return hits.join(T.memories(spark, sf).where(F.contains(F.lower("content"), F.lit("th"))).select("id"), "id", "left_semi")
