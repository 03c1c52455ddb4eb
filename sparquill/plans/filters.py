"""Scans, predicates, projections and limits."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .registry import query

EVENTS = """(SELECT event_id AS id, ts, epoch_us(ts) AS ts_us, user_id AS session, event_type AS name,
 CASE event_type WHEN 'purchase' THEN 'read' WHEN 'view' THEN 'outline' WHEN 'click' THEN 'symbol' WHEN 'signup' THEN 'injected' WHEN 'error' THEN 'failure' END AS kind,
 CAST(floor(value) AS BIGINT) AS tokens, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e"""
MEMORIES = """(SELECT doc_id AS id, lang AS category, source, text AS content, n_chars AS size,
 list_filter([source, 'lang:' || lang, CASE WHEN n_chars > 2000 THEN 'long' END, CASE WHEN n_chars < 100 THEN 'forget' END], lambda x: x IS NOT NULL) AS tags FROM documents) m"""
FINDINGS = """(SELECT l.doc_id AS id, d.source AS analyzer, CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity,
 d.lang || '/' || d.source AS file, quality = 1 AS accepted FROM labels l JOIN documents d USING (doc_id)) f"""
DECISIONS = "(SELECT o_custkey AS topic, CAST(o_orderdate AS DATE) AS created, o_orderkey AS seq, o_orderpriority AS value, CAST(substr(o_orderpriority, 1, 1) AS INT) AS precedence FROM orders) d"


@query(f"SELECT id, session, tokens FROM {EVENTS} WHERE kind = 'read' ORDER BY id LIMIT 1000")
def s1_scan_filter_limit(spark, sf):
    return R.top_k(T.events(spark, sf).where("kind = 'read'").select("id", "session", "tokens"), 1000, "id")


@query(f"SELECT id, session, name, tokens FROM {EVENTS} WHERE id = 77")
def s3_point_lookup(spark, sf):
    return T.events(spark, sf).where("id = 77").select("id", "session", "name", "tokens")


@query("SELECT l_orderkey AS agent, l_linenumber AS field, CAST(l_quantity AS BIGINT) AS value FROM lineitem WHERE l_orderkey BETWEEN 100 AND 199")
def s5_prefix_range_scan(spark, sf):
    return T.state(spark, sf).where("agent between 100 and 199").select("agent", "field", "value")


@query(f"SELECT id, ts_us, name FROM {EVENTS} WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) ORDER BY ts_us DESC, id DESC LIMIT 50")
def s8_newest_since(spark, sf):
    e = T.events(spark, sf)
    since = e.agg((F.max("ts") - F.expr("interval 7 days")).alias("since"))
    return R.top_k(e.join(F.broadcast(since), F.col("ts") >= F.col("since")).select("id", "ts_us", "name"), 50, F.desc("ts_us"), F.desc("id"))


@query(f"SELECT id FROM {EVENTS} ORDER BY id LIMIT 1000")
def s9_capped_listing(spark, sf):
    return R.capped(T.events(spark, sf).select("id").orderBy("id"), 0)


@query(f"SELECT topic, max(created) AS created, arg_max(value, (created, -seq)) AS value FROM {DECISIONS} WHERE topic = 37 GROUP BY topic")
def s25_latest_of_topic(spark, sf):
    d = T.decisions(spark, sf).where("topic = 37")
    return d.groupBy("topic").agg(F.max("created").alias("created"), F.max_by("value", F.struct("created", -F.col("seq"))).alias("value"))


@query(f"SELECT topic, created, seq, value FROM {DECISIONS} WHERE topic = 37")
def s26_decision_history(spark, sf):
    return T.decisions(spark, sf).where("topic = 37").select("topic", "created", "seq", "value").orderBy("created", "seq")


@query(f"SELECT id, kind, tokens FROM {EVENTS} WHERE kind IN ('read', 'outline', 'symbol') ORDER BY ts_us DESC, id DESC LIMIT 200")
def s29_token_view(spark, sf):
    return R.top_k(T.events(spark, sf).where(F.col("kind").isin("read", "outline", "symbol")), 200, F.desc("ts_us"), F.desc("id")).select("id", "kind", "tokens")


@query(f"SELECT id, category, source FROM {MEMORIES} WHERE category = 'en' AND list_has_any(tags, ['src1', 'src2', 'long']) AND NOT list_has_any(tags, ['forget'])")
def p1_memory_filter(spark, sf):
    m = T.memories(spark, sf)
    return m.where((F.col("category") == "en") & S.any_tag(F.col("tags"), ["src1", "src2", "long"]) & ~S.any_tag(F.col("tags"), ["forget"])).select("id", "category", "source")


@query(f"SELECT id FROM {MEMORIES} WHERE NOT list_contains(tags, 'forget')")
def p2_default_exclusion(spark, sf):
    return T.memories(spark, sf).where(~F.array_contains("tags", "forget")).select("id")


@query(f"SELECT id FROM {MEMORIES} WHERE list_contains(tags, 'long') AND list_contains(tags, 'lang:de')")
def p5_all_tags(spark, sf):
    return T.memories(spark, sf).where(S.all_tags(F.col("tags"), ["long", "lang:de"])).select("id")


@query(f"SELECT id, name, tokens FROM {EVENTS} WHERE name = 'click' AND ts BETWEEN (SELECT min(ts) + INTERVAL 3 DAY FROM events) AND (SELECT min(ts) + INTERVAL 12 DAY FROM events)")
def p6_event_filter_whole(spark, sf):
    e = T.events(spark, sf)
    first = e.agg(F.min("ts").alias("first"))
    held = e.where("name = 'click'").join(F.broadcast(first), F.expr("ts between first + interval 3 days and first + interval 12 days"))
    return held.select("id", "name", "tokens")


@query(f"SELECT id, analyzer, severity, file FROM {FINDINGS} WHERE severity = 'warning' AND contains(file, 'src1') AND NOT accepted")
def p7_finding_predicate(spark, sf):
    return T.findings(spark, sf).where((F.col("severity") == "warning") & F.contains("file", F.lit("src1")) & ~F.col("accepted")).select("id", "analyzer", "severity", "file")


@query("SELECT source, first_exclude, count(*) AS n FROM (SELECT source, CASE WHEN regexp_full_match(source, 'src1.*') THEN 'src1*' WHEN regexp_full_match(source, '.*5') THEN '*5' END AS first_exclude FROM documents) t GROUP BY ALL")
def p9_glob_filter(spark, sf):
    first = F.coalesce(*[F.when(F.rlike("source", F.lit(S.glob_to_regex(g))), F.lit(g)) for g in ("src1*", "*5")])
    return T.memories(spark, sf).groupBy("source", first.alias("first_exclude")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), lower('THErEr'))")
def p12_contains_fold(spark, sf):
    return T.memories(spark, sf).where(S.contains_fold(F.col("content"), "THErEr")).select("id")


@query(f"SELECT id, kind, k AS start_line, tokens FROM {EVENTS} WHERE kind IS NOT NULL AND k IS NOT NULL")
def p16_observe_to_token(spark, sf):
    return T.events(spark, sf).where("kind is not null and k is not null").select("id", "kind", F.col("k").alias("start_line"), "tokens")


@query("SELECT doc_id AS id, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS kept FROM documents WHERE length(text) >= 2048 AND regexp_matches(text, '(?i)error|stupid|fatal')")
def p27_trim_error_output(spark, sf):
    d = T.memories(spark, sf).where((F.length("content") >= 2048) & F.rlike("content", F.lit("(?i)error|stupid|fatal")))
    return d.select("id", F.array_join(F.slice(F.split("content", "\n"), 1, 30), "\n").alias("kept"))


@query("SELECT doc_id AS id, CAST(floor(n_chars / CASE lang WHEN 'en' THEN 3.5 WHEN 'de' THEN 3.1 WHEN 'fr' THEN 3.2 WHEN 'es' THEN 3.3 ELSE 3.0 END + 0.5) AS BIGINT) AS est_tokens, CAST(floor(octet_length(encode(text)) / 3.0 + 0.5) AS BIGINT) AS text_tokens FROM documents")
def fs11_token_estimates(spark, sf):
    m = T.memories(spark, sf)
    return m.select("id", S.estimated_tokens(F.col("size"), S.lookup(F.col("category"), S.CHARS_PER_TOKEN, 3.0)).alias("est_tokens"), S.estimated_tokens(F.octet_length("content"), F.lit(3.0)).alias("text_tokens"))


@query("""SELECT doc_id AS id, round(least(1.0, greatest(0.0, 0.50 * CASE lang WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.6 WHEN 'es' THEN 0.5 ELSE 0.4 END
 + 0.15 * CASE WHEN n_chars > 2000 THEN 0.5 ELSE 0.2 END + 0.25 * CASE WHEN doc_id % 90 <= 0 THEN 1.0 ELSE pow(0.5, (doc_id % 90) / 30.0) END
 + 0.10 * least(1.0, greatest(0.0, log10((doc_id % 12) + 1)))) ), 6) AS score FROM documents""")
def fm5_memory_score(spark, sf):
    m = T.memories(spark, sf)
    score = S.memory_score(S.lookup(F.col("category"), S.CATEGORY_WEIGHTS, 0.4), F.when(F.col("size") > 2000, 0.5).otherwise(0.2), F.col("id") % 90, F.col("id") % 12, F.lit(0))
    return m.select("id", F.round(score, 6).alias("score"))


@query("SELECT doc_id AS id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 257 + c) % 1000000007) AS h FROM documents WHERE length(text) > 0")
def fh1_polynomial_hash_whole(spark, sf):
    codes = F.transform(F.split("content", ""), lambda c: F.ascii(c).cast("bigint"))
    return T.memories(spark, sf).where("length(content) > 0").select("id", S.polynomial_hash(codes).alias("h"))


@query("SELECT doc_id AS id, sha1(source || chr(0) || lang) AS h FROM documents")
def fh2_identity(spark, sf):
    return T.memories(spark, sf).select("id", F.sha1(F.concat("source", F.lit("\0"), "category").cast("binary")).alias("h"))


@query("SELECT doc_id AS id, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS n_words FROM documents")
def fs5_words(spark, sf):
    return T.memories(spark, sf).select("id", F.size(S.words(F.col("content"))).cast("bigint").alias("n_words"))


@query("SELECT p_partkey AS id, levenshtein(p_name, p_type) AS distance FROM part")
def fs8_levenshtein(spark, sf):
    return T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", "p_type").cast("bigint").alias("distance"))
