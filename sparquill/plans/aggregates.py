"""Grouped, conditional and ordered aggregates, top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import DECISIONS, EVENTS, FINDINGS, MEMORIES
from .registry import query


KINDS = list(T.TOKEN_KINDS.values())


@query(f"""SELECT session, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(k) AS BIGINT) AS saved, min(ts_us) AS first, max(ts_us) AS last, count(DISTINCT name) AS kinds,
 count(*) FILTER (kind = 'read') AS reads, count(*) FILTER (kind = 'failure') AS failures, {", ".join(f"coalesce(CAST(sum(tokens) FILTER (kind = '{x}') AS BIGINT), 0) AS {x}_tokens" for x in KINDS)} FROM {EVENTS} GROUP BY session""")
def a1_token_stats(spark, sf):
    is_a = lambda x: F.col("kind") == x
    per_kind = [F.coalesce(F.sum(F.when(is_a(x), F.col("tokens"))), F.lit(0)).alias(f"{x}_tokens") for x in KINDS]
    scalars = [F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("k").alias("saved"), F.min("ts_us").alias("first"), F.max("ts_us").alias("last")]
    # a kind stands for one name, so a set of five at most tells how many there are without a second shuffle
    return T.events(spark, sf).groupBy("session").agg(*scalars, F.size(F.collect_set("name")).cast("bigint").alias("kinds"), F.count_if(is_a("read")).alias("reads"), F.count_if(is_a("failure")).alias("failures"), *per_kind)


@query(f"""SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(name) = 0 THEN 'name' ELSE 'k' END AS grp, coalesce(kind, name, CAST(k AS VARCHAR)) AS key, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(k1) AS BIGINT) AS saved
 FROM (SELECT *, k AS k1 FROM {EVENTS}) x GROUP BY GROUPING SETS ((kind), (name), (k))""")
def a2_observe_summary(spark, sf):
    e = T.events(spark, sf).withColumn("saved", F.col("k"))
    sums = [F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("saved").alias("saved")]
    out = e.groupingSets([["kind"], ["name"], ["k"]], "kind", "name", "k").agg(F.grouping("kind").alias("g"), F.grouping("name").alias("h"), *sums)
    return out.select(F.when(F.col("g") == 0, "kind").when(F.col("h") == 0, "name").otherwise("k").alias("grp"), F.coalesce("kind", "name", F.col("k").cast("string")).alias("key"), "n", "tokens", "saved")


@query(f"""SELECT *, 100 * saved / nullif(counterfactual, 0) AS percent FROM (SELECT coalesce(name, 'total') AS tool, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS actual, CAST(sum(k) AS BIGINT) AS saved,
 CAST(sum(tokens) + sum(k) AS BIGINT) AS counterfactual FROM {EVENTS} GROUP BY ROLLUP (name)) t""")
def a3_efficiency(spark, sf):
    out = T.events(spark, sf).rollup("name").agg(F.count("*").alias("calls"), F.sum("tokens").alias("actual"), F.sum("k").alias("saved"))
    out = out.select(F.coalesce("name", F.lit("total")).alias("tool"), "calls", "actual", "saved", (F.col("actual") + F.col("saved")).alias("counterfactual"))
    return out.withColumn("percent", 100 * F.col("saved") / F.nullif("counterfactual", F.lit(0))).orderBy(F.desc("saved"), "tool")


@query(f"SELECT analyzer, severity, count(*) AS n FROM {FINDINGS} GROUP BY GROUPING SETS ((), (analyzer), (severity))")
def a4_finding_stats(spark, sf):
    return T.findings(spark, sf).groupingSets([[], ["analyzer"], ["severity"]], "analyzer", "severity").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM lineitem) AS symbols, (SELECT count(*) FROM events) AS refs")
def a6_index_stats(spark, sf):
    one = lambda t, c: T.table(spark, sf, t).agg(F.count("*").alias(c))
    # three tables of one row
    return one("documents", "files").join(F.broadcast(one("lineitem", "symbols"))).join(F.broadcast(one("events", "refs")))


@query("SELECT l_partkey AS symbol, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, symbol LIMIT 25")
def t2_top_referenced(spark, sf):
    return R.top_k(T.edges(spark, sf).groupBy(F.col("src").alias("symbol")).agg(F.count("*").alias("n")), 25, F.desc("n"), "symbol")


@query("SELECT l_partkey AS symbol, count(*) AS n FROM lineitem GROUP BY 1")
def a7_reference_counts(spark, sf):
    return T.edges(spark, sf).groupBy(F.col("src").alias("symbol")).agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS file, count(*) AS commits, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS lines FROM lineitem GROUP BY 1")
def a8_churn(spark, sf):
    return T.churn(spark, sf).groupBy("file").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"))


@query("SELECT l_suppkey AS file, round(count(*) * (1 + sum(CAST(l_quantity AS BIGINT)) / 100), 4) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, file LIMIT 50")
def t3_top_churn(spark, sf):
    c = T.churn(spark, sf).groupBy("file").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"))
    return R.top_k(c.select("file", F.round(S.churn_score(F.col("commits"), F.col("lines")), 4).alias("score")), 50, F.desc("score"), "file")


@query(f"SELECT topic, created, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created DESC, seq) AS rn FROM {DECISIONS}) t WHERE rn = 1")
def a9_latest_per_topic(spark, sf):
    return R.latest(T.decisions(spark, sf), ["topic"], F.desc("created"), F.col("seq")).select("topic", "created", "seq", "value")


@query(f"SELECT grp, id FROM (SELECT array_to_string(list_sort(tags), ',') AS grp, id, row_number() OVER (PARTITION BY array_to_string(list_sort(tags), ',') ORDER BY id DESC) AS rn FROM {MEMORIES}) t WHERE rn = 1")
def a10_latest_per_tag_group(spark, sf):
    m = T.memories(spark, sf).withColumn("grp", F.array_join(F.sort_array("tags"), ","))
    return m.groupBy("grp").agg(F.max("id").alias("id"))


@query(f"SELECT session, count(*) AS n, max(ts_us) AS newest FROM {EVENTS} GROUP BY session ORDER BY newest DESC, session LIMIT 20")
def a11_recent_sessions(spark, sf):
    return R.top_k(T.events(spark, sf).groupBy("session").agg(F.count("*").alias("n"), F.max("ts_us").alias("newest")), 20, F.desc("newest"), "session")


@query(f"SELECT session, coalesce(arg_max(id, id) FILTER (name = 'purchase'), arg_max(id, id) FILTER (name <> 'error')) AS chosen FROM {EVENTS} GROUP BY session HAVING chosen IS NOT NULL")
def a12_preferred_summary(spark, sf):
    of = lambda c: F.max(F.when(c, F.col("id")))
    out = T.events(spark, sf).groupBy("session").agg(F.coalesce(of(F.col("name") == "purchase"), of(F.col("name") != "error")).alias("chosen"))
    return out.where("chosen is not null")


@query("""SELECT l_orderkey AS agent, max(CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS BIGINT) END) AS f1, max(CASE WHEN l_linenumber = 2 THEN CAST(l_quantity AS BIGINT) END) AS f2,
 max(CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) END) AS f3, max(CAST(l_shipdate AS DATE)) AS newest FROM lineitem GROUP BY 1 HAVING newest >= DATE '1995-06-01'""")
def a13_pivot_agents(spark, sf):
    """Agents whose newest field is stale go; the rest come newest first. Conditional sums, as a pivot would aggregate twice."""
    field = [F.max(F.when(F.col("field") == i, F.col("value"))).alias(f"f{i}") for i in (1, 2, 3)]
    out = T.state(spark, sf).groupBy("agent").agg(*field, F.max("updated").alias("newest"))
    return out.where("newest >= date'1995-06-01'").orderBy(F.desc("newest"), "agent")


@query("""SELECT node, fan_out, fan_in, CASE WHEN fan_out >= 40 OR fan_in >= 500 THEN 'critical' WHEN fan_out >= 25 OR fan_in >= 100 THEN 'warning' ELSE 'info' END AS severity FROM
 (SELECT node, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in FROM (SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS fan_out FROM lineitem GROUP BY 1) o FULL JOIN (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS fan_in FROM lineitem GROUP BY 1) i USING (node)) t""")
def a14_fan_out(spark, sf):
    e = T.edges(spark, sf).select("src", "dst").distinct()
    # each edge counts once at either end, so degrees of both kinds come from one aggregate and no join
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    d = e.select(ends.alias("x")).groupBy("x.node").agg(F.sum("x.o").alias("fan_out"), F.sum("x.i").alias("fan_in"))
    at = lambda out, into: (F.col("fan_out") >= out) | (F.col("fan_in") >= into)
    return d.withColumn("severity", F.when(at(40, 500), "critical").when(at(25, 100), "warning").otherwise("info"))


@query("SELECT l_suppkey AS node, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS degree FROM lineitem GROUP BY 1")
def a15_weighted_degree(spark, sf):
    return T.edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("degree"))


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY ALL")
def a16_edge_weights(spark, sf):
    e = T.edges(spark, sf).where("src <> dst")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))


@query(f"SELECT analyzer, severity, n FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, analyzer) AS rn FROM (SELECT analyzer, severity, count(*) AS n FROM {FINDINGS} GROUP BY analyzer, severity) g) t WHERE rn <= 3")
def a19_most_frequent(spark, sf):
    c = T.findings(spark, sf).groupBy("analyzer", "severity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("severity").orderBy(F.desc("n"), "analyzer")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query(f"SELECT session, name, ts_us // 5000000 AS bucket, min(ts_us) AS first, max(ts_us) AS last, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n FROM {EVENTS} GROUP BY ALL")
def a29_tumbling_buckets(spark, sf):
    e = T.events(spark, sf).withColumn("bucket", F.expr("ts_us div 5000000"))
    out = e.groupBy("session", "name", "bucket").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return out.orderBy(F.desc("last"), "session", "name")


@query(f"SELECT seq, topic, row_number() OVER (PARTITION BY topic ORDER BY created DESC, seq) > 1 AS superseded FROM {DECISIONS}")
def a31_superseded(spark, sf):
    w = Window.partitionBy("topic").orderBy(F.desc("created"), "seq")
    return T.decisions(spark, sf).select("seq", "topic", (F.row_number().over(w) > 1).alias("superseded"))


@query(f"SELECT seq, topic, precedence FROM {DECISIONS} ORDER BY precedence DESC, topic, seq LIMIT 100")
def t4_decision_order(spark, sf):
    return R.top_k(T.decisions(spark, sf).select("seq", "topic", "precedence"), 100, F.desc("precedence"), "topic", "seq")


@query("""SELECT conv_id AS session, count(*) FILTER (role = 'user') AS prompts, count(*) FILTER (role = 'user' AND length(text) BETWEEN 11 AND 499) AS shown, count(DISTINCT role) AS roles,
 arg_max(substr(text, 1, 200), (turn, text)) FILTER (role = 'user' AND length(text) BETWEEN 11 AND 499) AS latest FROM conversations GROUP BY 1""")
def a28_transcript_summary(spark, sf):
    user = F.col("role") == "user"
    shown = user & F.length("text").between(11, 499)
    latest = F.max(F.when(shown, F.struct("seq", "text")))
    return T.turns(spark, sf).groupBy("session").agg(F.count_if(user).alias("prompts"), F.count_if(shown).alias("shown"), F.count_distinct("role").alias("roles"), F.substring(latest["text"], 1, 200).alias("latest"))


@query("""WITH d AS (SELECT lang, n_chars AS c, octet_length(encode(text)) AS b FROM documents), r AS (SELECT lang, sum(c) / sum(b) AS ratio, count(*) AS n FROM d GROUP BY 1)
 SELECT lang, round(any_value(ratio), 9) AS ratio, any_value(n) AS n, round(sqrt(avg((c / nullif(b, 0) - ratio) * (c / nullif(b, 0) - ratio))), 6) AS spread FROM d JOIN r USING (lang) GROUP BY lang""")
def f24_ratio_calibration(spark, sf):
    """The spread is the root of the mean square distance to the weighted ratio, from three sums of one pass."""
    m = T.memories(spark, sf).select(F.col("category").alias("lang"), F.col("size").alias("c"), F.octet_length("content").alias("b"))
    x = F.col("c") / F.nullif("b", F.lit(0))
    g = m.groupBy("lang").agg((F.sum("c") / F.nullif(F.sum("b"), F.lit(0))).alias("ratio"), F.count("*").alias("n"), F.avg(x).alias("m1"), F.avg(x * x).alias("m2"))
    square = F.col("m2") - 2 * F.col("ratio") * F.col("m1") + F.col("ratio") * F.col("ratio")
    return g.select("lang", F.round("ratio", 9).alias("ratio"), "n", F.round(F.sqrt(F.greatest(square, F.lit(0.0))), 6).alias("spread"))
