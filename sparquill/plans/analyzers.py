"""Full-text search and composite analyzers."""

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as T
from .registry import query

POSTINGS = "(SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents) p"


def postings(spark, sf):
    """id, term, tf: how often each document holds each term."""
    terms = T.memories(spark, sf).select("id", F.explode(F.split(F.lower("content"), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


@query("""SELECT DISTINCT p_partkey AS id, lower(p_name)[1:k] AS gram FROM part, range(2, 16) r(k) WHERE length(p_name) >= k""")
def x2_edge_grams(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("n")).where("length(n) >= 2")
    grams = F.transform(F.sequence(F.lit(2), F.least(F.lit(15), F.length("n"))), lambda k: F.substring(F.col("n"), F.lit(1), k))
    return p.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


@query("""SELECT DISTINCT p_partkey AS id, lower(p_name)[i:i + k - 1] AS gram FROM part, range(3, 9) n(k), range(1, (SELECT max(length(p_name)) + 1 FROM part)) r(i) WHERE length(p_name) >= i + k - 1""")
def x3_substring_grams(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("n")).where("length(n) >= 3")
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substring(F.col("n"), i, k))
    grams = F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(8), F.length("n"))), of_length))
    return p.select("id", F.explode(F.array_distinct(grams)).alias("gram"))


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'moron') ORDER BY doc_id LIMIT 50")
def x5_substring_fallback(spark, sf):
    return R.top_k(T.memories(spark, sf).where(F.contains(F.lower("content"), F.lit("moron"))).select("id"), 50, "id")


@query("""SELECT id, score FROM (SELECT p_partkey AS id, CASE WHEN starts_with(lower(p_name), 'a') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_name), 'e') THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END AS score FROM part) t WHERE score > 0 ORDER BY score DESC, id LIMIT 40""")
def x7_symbol_search(spark, sf):
    p = T.table(spark, sf, "part")
    at = lambda c, v: F.when(c, v).otherwise(0)
    score = at(F.startswith(F.lower("p_name"), F.lit("a")), 4) + at(F.contains(F.lower("p_name"), F.lit("e")), 2) + at(F.contains(F.lower("p_type"), F.lit("steel")), 1)
    return R.top_k(p.select(F.col("p_partkey").alias("id"), score.alias("score")).where("score > 0"), 40, F.desc("score"), "id")


LINES = "(SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents) l"


@query(f"""SELECT id, line_no, rule FROM {LINES} JOIN (VALUES ('secret', 'password=[0-9a-f]+'), ('key', 'AKIA[A-Z0-9]+'), ('mail', '[a-z]+\\.[0-9]+@[a-z0-9]+\\.example')) r(rule, pattern) ON regexp_matches(text, pattern)""")
def f7_security_rules(spark, sf):
    rules = {"secret": "password=[0-9a-f]+", "key": "AKIA[A-Z0-9]+", "mail": r"[a-z]+\.[0-9]+@[a-z0-9]+\.example"}
    hits = F.filter(F.array(*[F.when(F.rlike("text", F.lit(p)), F.lit(r)) for r, p in rules.items()]), lambda r: r.isNotNull())
    return T.lines(spark, sf).select("id", F.col("line_no").cast("bigint").alias("line_no"), F.explode(hits).alias("rule"))


@query(f"SELECT id, line_no, regexp_extract(text, '(?i)(license|copyright)', 1) AS keyword FROM {LINES} WHERE regexp_matches(text, '(?i)license|copyright')")
def f8_todo_scan(spark, sf):
    held = T.lines(spark, sf).where(F.rlike("text", F.lit("(?i)license|copyright")))
    return held.select("id", F.col("line_no").cast("bigint").alias("line_no"), F.regexp_extract("text", "(?i)(license|copyright)", 1).alias("keyword"))


@query()
def f1_clone_findings(spark, sf):
    return R.clones(T.memories(spark, sf).select("id", F.col("category").alias("lang"), "content"))


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000 AS dst FROM lineitem), s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l1 AS (SELECT DISTINCT dst AS node FROM s WHERE src = 17),
 l2 AS (SELECT DISTINCT dst AS node FROM s JOIN l1 ON src = node WHERE dst <> 17 AND dst NOT IN (SELECT node FROM l1)) SELECT CAST(17 AS BIGINT) AS node, 0 AS level UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""")
def f17_call_graph(spark, sf):
    e = T.edges(spark, sf).select("src", (F.col("dst") + 1_000_000).alias("dst"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return R.bfs(both, spark.range(17, 18).select(F.col("id").alias("node")), 2)


@query(f"""SELECT id, sum(CASE WHEN contains(text, '|') THEN 1 ELSE 0 END) AS marked, count(*) FILTER (trim(text) <> '') AS lines FROM {LINES} GROUP BY id HAVING marked > 5 AND marked > 0.3 * lines""")
def f23_excess_comments(spark, sf):
    c = T.lines(spark, sf).groupBy("id").agg(F.count_if(F.contains("text", F.lit("|"))).alias("marked"), F.count_if(F.trim("text") != "").alias("lines"))
    return c.where("marked > 5 and marked > 0.3 * lines")
