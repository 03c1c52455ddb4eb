"""Rankings, summaries, text functions and analyzers on the entities."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import DECISIONS, EVENTS, FINDINGS, MEMORIES
from .registry import query
from .stores import PROPOSALS, REFS, SURVEY, SYMBOLS


@query(f"""SELECT analyzer, kind, count(*) AS n FROM {SURVEY} GROUP BY GROUPING SETS ((), (analyzer), (kind))""")
def a5_survey_stats(spark, sf):
    return T.survey(spark, sf).groupingSets([[], [F.col("analyzer")], [F.col("kind")]], F.col("analyzer"), F.col("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT sum(est_tokens) AS est_tokens FROM {SURVEY} WHERE analyzer = 'Brand#2'")
def a21_counterfactual_tokens(spark, sf):
    return T.survey(spark, sf).where("analyzer = 'Brand#2'").agg(F.sum("est_tokens").alias("est_tokens"))


@query(f"SELECT analyzer, arg_max(name, (size, id)) AS latest FROM {SURVEY} GROUP BY analyzer")
def a22_latest_stamp(spark, sf):
    return T.survey(spark, sf).groupBy("analyzer").agg(F.max_by("name", F.struct("size", "id")).alias("latest"))


@query(f"""SELECT coalesce(a.k, b.k, c.k) AS k, coalesce(calls, 0) AS calls, coalesce(spent, 0) AS spent, coalesce(saved, 0) AS saved FROM
 (SELECT k, count(*) AS calls FROM {EVENTS} WHERE kind = 'read' GROUP BY k) a FULL JOIN (SELECT k, sum(tokens) AS spent FROM {EVENTS} WHERE kind = 'outline' GROUP BY k) b ON a.k = b.k
 FULL JOIN (SELECT k, sum(tokens) AS saved FROM {EVENTS} WHERE kind = 'symbol' GROUP BY k) c ON c.k = coalesce(a.k, b.k) WHERE coalesce(calls, 0) > 0""")
def a23_per_tool_rows(spark, sf):
    """An outer union of three maps is one pass with conditional sums; rows without calls go."""
    of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    out = T.events(spark, sf).where("kind in ('read', 'outline', 'symbol')").groupBy("k").agg(of("read", F.lit(1)).cast("bigint").alias("calls"), of("outline", F.col("tokens")).alias("spent"), of("symbol", F.col("tokens")).alias("saved"))
    return out.where("calls > 0")


@query(f"SELECT session, name, list(DISTINCT k ORDER BY k) AS bullets FROM {EVENTS} WHERE name IN ('click', 'error') GROUP BY session, name")
def a24_categorised_bullets(spark, sf):
    return T.events(spark, sf).where("name in ('click', 'error')").groupBy("session", "name").agg(F.sort_array(F.collect_set("k")).alias("bullets"))


@query(f"SELECT shape, status, count(*) AS n FROM {PROPOSALS} GROUP BY shape, status")
def a25_proposals_per_shape(spark, sf):
    return T.proposals(spark, sf).groupBy("shape", "status").agg(F.count("*").alias("n"))


@query(f"""SELECT session, CASE WHEN length(s) >= 50 THEN s END AS summary FROM (SELECT session, 'tasks: ' || array_to_string(list_slice(list(DISTINCT k ORDER BY k) FILTER (name = 'click'), 1, 5), ', ')
 || ' files: ' || array_to_string(list_slice(list(DISTINCT k ORDER BY k) FILTER (name = 'view'), 1, 15), ', ') AS s FROM {EVENTS} GROUP BY session) x""")
def a26_session_summary(spark, sf):
    some = lambda name, n: F.array_join(F.slice(F.sort_array(F.collect_set(F.when(F.col("name") == name, F.col("k")))), 1, n), ", ")
    both = T.events(spark, sf).groupBy("session").agg(some("click", 5).alias("a"), some("view", 15).alias("b"))
    s = F.concat(F.lit("tasks: "), "a", F.lit(" files: "), "b")
    return both.select("session", F.when(F.length(s) >= 50, s).alias("summary"))


@query(f"SELECT parent, session, started, max(started) OVER (PARTITION BY parent) AS newest FROM (SELECT session % 7 AS parent, session, min(ts_us) AS started FROM {EVENTS} GROUP BY session) x")
def a30_agents_by_parent(spark, sf):
    a = T.events(spark, sf).groupBy("session").agg(F.min("ts_us").alias("started")).withColumn("parent", F.col("session") % 7)
    newest = a.groupBy("parent").agg(F.max("started").alias("newest"))  # partial sums meet, however few parents there are
    return a.join(newest, "parent").select("parent", "session", "started", "newest").orderBy(F.desc("newest"), "parent", "session")


@query("WITH RECURSIVE i AS (SELECT c_custkey AS id, c_custkey // 5 AS parent FROM customer), f(id, level) AS (SELECT id, 0 FROM i WHERE id = 0 UNION SELECT i.id, level + 1 FROM f JOIN i ON i.parent = f.id AND i.id <> f.id) SELECT id, level FROM f")
def a32_instance_forest(spark, sf):
    i = T.table(spark, sf, "customer").select(F.expr("c_custkey div 5").alias("src"), F.col("c_custkey").alias("dst")).where("src <> dst")
    return R.bfs(i, spark.range(1).select(F.col("id").alias("node")), 12).select(F.col("node").alias("id"), "level")


@query(f"SELECT id, row_number() OVER (PARTITION BY analyzer ORDER BY size DESC, id) AS position FROM {SURVEY}")
def w13_positions(spark, sf):
    """Places in one order of all rows, less the first one of each analyzer: no task holds an analyzer."""
    placed = R.ranked(T.survey(spark, sf).select("id", "analyzer", "size"), "analyzer", F.desc("size"), "id")
    first = placed.groupBy("analyzer").agg(F.min("rank").alias("first"))
    return placed.join(first, "analyzer").select("id", (F.col("rank") - F.col("first") + 1).alias("position"))


@query(f"""SELECT id, coalesce(CASE WHEN earlier IS NOT NULL THEN 'repeat' END, CASE WHEN later IS NOT NULL THEN 'superseded' END, CASE WHEN size >= 2048 THEN 'purge' END, 'keep') AS strategy FROM
 (SELECT id, size, lag(id) OVER (PARTITION BY source, md5(content) ORDER BY id) AS earlier, lead(id) OVER (PARTITION BY source, category, size ORDER BY id) AS later FROM {MEMORIES}) x""")
def w16_first_strategy_wins(spark, sf):
    m = T.memories(spark, sf).withColumn("h", F.md5(F.col("content").cast("binary")))
    m = m.withColumn("earlier", F.lag("id").over(Window.partitionBy("source", "h").orderBy("id"))).withColumn("later", F.lead("id").over(Window.partitionBy("source", "category", "size").orderBy("id")))
    return m.select("id", F.coalesce(F.when(F.col("earlier").isNotNull(), "repeat"), F.when(F.col("later").isNotNull(), "superseded"), F.when(F.col("size") >= 2048, "purge"), F.lit("keep")).alias("strategy"))


@query(f"SELECT id, size FROM {SURVEY} ORDER BY size DESC, name, id LIMIT 12")
def t5_codebase_map(spark, sf):
    return R.top_k(T.survey(spark, sf), 12, F.desc("size"), "name", "id").select("id", "size")


@query(f"SELECT name, sum(size) AS score FROM {SURVEY} GROUP BY name ORDER BY score DESC, name LIMIT 3")
def t6_top_skills(spark, sf):
    return R.top_k(T.survey(spark, sf).groupBy("name").agg(F.sum("size").alias("score")), 3, F.desc("score"), "name")


@query("SELECT src, arg_max(dst, (w, -dst)) AS hub FROM (SELECT l_partkey AS src, l_suppkey AS dst, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2) x GROUP BY src")
def t7_hub_member(spark, sf):
    e = T.edges(spark, sf).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return e.groupBy("src").agg(F.max_by("dst", F.struct("w", -F.col("dst"))).alias("hub"))


@query(f"SELECT session, min(ts_us) AS started FROM {EVENTS} GROUP BY session")
def t8_agents(spark, sf):
    return T.events(spark, sf).groupBy("session").agg(F.min("ts_us").alias("started")).orderBy(F.desc("started"), "session")


@query(f"SELECT DISTINCT 'run ' || name || ' | grep ' || (k % 3) AS signature FROM {EVENTS}")
def fs1_command_signatures(spark, sf):
    command = F.concat(F.lit("HOME=/x /usr/bin/run   "), "name", F.lit(" 2>/dev/null|grep "), (F.col("k") % 3).cast("string"))
    return T.events(spark, sf).select(S.command_signature(command).alias("signature")).distinct()


@query(f"SELECT id, CAST(floor(strlen(content) / 3.0 + 0.5) AS BIGINT) AS tokens, (strlen(content) + 2) // 3 AS cost FROM {MEMORIES}")
def fs12_tokens_of_text(spark, sf):
    n = F.octet_length("content")
    return T.memories(spark, sf).select("id", S.estimated_tokens(n, F.lit(3.0)).alias("tokens"), F.expr("(octet_length(content) + 2) div 3").alias("cost"))


@query("SELECT DISTINCT url, CASE WHEN contains(url, '/en/') THEN 'en' WHEN contains(url, '/de/') THEN 'de' ELSE 'other' END AS language FROM pages")
def fs14_language_of_path(spark, sf):
    u = F.col("url")
    return T.table(spark, sf, "pages").select(u, F.when(F.contains(u, F.lit("/en/")), "en").when(F.contains(u, F.lit("/de/")), "de").otherwise("other").alias("language")).distinct()


@query(f"SELECT id, CASE WHEN length(content) > 80 THEN substr(content, 1, 77) || '...' ELSE content END AS shown FROM {MEMORIES}")
def fs18_truncate(spark, sf):
    return T.memories(spark, sf).select("id", F.when(F.length("content") > 80, F.concat(F.substring("content", 1, 77), F.lit("..."))).otherwise(F.col("content")).alias("shown"))


@query(f"SELECT id, CASE WHEN age < 60 THEN 'just now' WHEN age < 3600 THEN (age // 60) || ' min ago' WHEN age < 86400 THEN (age // 3600) || ' h ago' ELSE (age // 86400) || ' d ago' END AS said FROM (SELECT id, ((SELECT max(ts_us) FROM {EVENTS}) - ts_us) // 1000000 AS age FROM {EVENTS}) x")
def fd2_relative_time(spark, sf):
    e = T.events(spark, sf)
    aged = e.join(F.broadcast(e.agg(F.max("ts_us").alias("now")))).selectExpr("id", "(now - ts_us) div 1000000 as age")
    part = lambda n, unit: F.concat(F.expr(f"age div {n}").cast("string"), F.lit(unit))
    return aged.select("id", F.when(F.col("age") < 60, "just now").when(F.col("age") < 3600, part(60, " min ago")).when(F.col("age") < 86400, part(3600, " h ago")).otherwise(part(86400, " d ago")).alias("said"))


@query(f"SELECT file, count(*) AS commits, sum(lines) AS lines, count(*) * (1 + sum(lines) / 100) AS score FROM (SELECT l_suppkey AS file, CAST(l_quantity AS BIGINT) AS lines FROM lineitem) c GROUP BY file ORDER BY score DESC, file LIMIT 50")
def f11_churn(spark, sf):
    c = T.churn(spark, sf).groupBy("file").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"))
    return R.top_k(c.withColumn("score", S.churn_score(F.col("commits"), F.col("lines"))), 50, F.desc("score"), "file")


@query("SELECT doc_id AS id, count(*) AS secrets FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l WHERE regexp_matches(line, '(AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z_]*(secret|token|password)[A-Za-z_]*[ ]*[:=][ ]*[^ ]{8,})') GROUP BY doc_id")
def f6_secrets(spark, sf):
    rule = "(AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|[A-Za-z_]*(secret|token|password)[A-Za-z_]*[ ]*[:=][ ]*[^ ]{8,})"
    return T.lines(spark, sf).where(F.rlike("text", F.lit(rule))).groupBy("id").agg(F.count("*").alias("secrets"))


@query(f'SELECT r.id, arg_min(y.symbol, (y."end" - y."start", y.symbol)) AS caller FROM {REFS} JOIN {SYMBOLS} ON y.file = r.file AND r.line BETWEEN y."start" AND y."end" GROUP BY r.id')
def j4_callers(spark, sf):
    return R.narrowest_range(T.references(spark, sf), T.symbols(spark, sf), "file", "line", "start", "end", "id", "symbol").select("id", F.col("symbol").alias("caller"))
