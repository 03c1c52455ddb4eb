"""Scans of further entities, and mutations of stores: each writes its change and reads the state back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from ..sources.store import Store
from .filters import DECISIONS, EVENTS, FINDINGS, MEMORIES
from .registry import query

TASKS = """(SELECT o_orderkey AS id, o_orderpriority AS title, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE 'done' END AS status,
 CASE WHEN o_orderstatus <> 'O' THEN o_custkey END AS owner, CAST(o_orderdate AS DATE) AS created, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS completed, o_custkey % 50 AS parent FROM orders) t"""
MESSAGES = f"""(SELECT id, session AS sender, CASE WHEN session % 10 = 1 THEN 0 ELSE CAST(k AS BIGINT) END AS addressee, name AS content,
 CASE WHEN tokens >= 60 THEN 'high' ELSE 'normal' END AS priority, session % 7 AS parent, ts_us AS created, ts_us + 3600000000 AS expires FROM {EVENTS}) m"""
PROPOSALS = f"""(SELECT id, ts_us, session, name AS shape, CASE WHEN k < 40 THEN 'open' WHEN k < 70 THEN 'accepted' ELSE 'rejected' END AS status,
 CASE WHEN k >= 70 THEN 1 ELSE 0 END AS rejections, CASE WHEN k BETWEEN 40 AND 69 THEN id END AS memory FROM {EVENTS}) p"""
SURVEY = "(SELECT p_partkey AS id, p_brand AS analyzer, p_type AS kind, p_name AS name, p_brand || '/' || p_type AS file, CAST(p_size AS INT) AS size, CAST(floor(p_retailprice) AS BIGINT) AS est_tokens FROM part) s"
TOMBS = "(SELECT c_custkey AS id, c_mktsegment AS kind, CAST(floor(c_acctbal) AS BIGINT) AS deleted FROM customer WHERE c_acctbal < 0) z"
SYMBOLS = "(SELECT l_partkey AS file, l_orderkey * 10 + l_linenumber AS symbol, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS \"start\", CAST(l_shipdate AS DATE) - DATE '1992-01-01' + CAST(l_quantity AS INT) AS \"end\" FROM lineitem) y"
REFS = "(SELECT event_id AS id, event_id % 2000 + 1 AS file, CAST(user_id * 37 % 2500 AS INT) AS line FROM events) r"


# scans


@query(f"SELECT name, count(*) AS n, sum(tokens) AS tokens FROM {EVENTS} WHERE k >= 30 GROUP BY name")
def s2_scan_for_aggregates(spark, sf):
    return T.events(spark, sf).where("k >= 30").groupBy("name").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@query(f"SELECT id, category, source, content FROM {MEMORIES} WHERE id = 42")
def s4_memory_lookup(spark, sf):
    return T.memories(spark, sf).where("id = 42").select("id", "category", "source", "content")


@query(f"SELECT id, line FROM {REFS} WHERE file = 11")
def s6_references_of_file(spark, sf):
    return T.references(spark, sf).where("file = 11").select("id", "line")


@query(f'SELECT symbol, "start", "end" FROM {SYMBOLS} WHERE file = 7')
def s7_symbols_of_file(spark, sf):
    ids = T.files(spark, sf).where("path = 7").select("path", F.explode("symbols").alias("symbol"))
    return T.symbols(spark, sf).withColumnRenamed("file", "path").join(ids, ["path", "symbol"], "left_semi").select("symbol", "start", "end")


@query(f"SELECT id, file, line FROM {REFS}")
def s10_all_references(spark, sf):
    return R.capped(T.references(spark, sf), -1)


@query(f'SELECT file AS path, list(symbol ORDER BY symbol) AS symbols, CAST(sum("end" - "start") AS BIGINT) AS size FROM {SYMBOLS} GROUP BY file')
def s11_all_files(spark, sf):
    return T.files(spark, sf)


@query("SELECT l_linenumber AS field, CAST(l_quantity AS BIGINT) AS value FROM lineitem WHERE l_orderkey = 101")
def s12_state_of_agent(spark, sf):
    return T.state(spark, sf).where("agent = 101").select("field", "value")


@query("SELECT count(*) FILTER (ok) AS taken, count(*) FILTER (NOT ok) AS skipped, sum(k) FILTER (ok) AS k FROM (SELECT k, k IS NOT NULL AND event_type <> 'error' AS ok FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) a) b")
def s13_json_lines(spark, sf):
    """Lines without a name, or that aren't JSON, are skipped and counted."""
    e = T.table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("k"))))
    read = e.select(F.from_json(line, "name string, k int").alias("r"))
    ok = F.coalesce(F.col("r.name").isNotNull() & F.col("r.k").isNotNull(), F.lit(False))
    return read.agg(F.count(F.when(ok, 1)).alias("taken"), F.count(F.when(~ok, 1)).alias("skipped"), F.sum(F.when(ok, F.col("r.k"))).alias("k"))


@query("SELECT conv_id AS session, turn AS seq FROM conversations WHERE contains(text, 'e') AND role = 'assistant'")
def s14_session_log(spark, sf):
    """The cheap substring test comes before the parse."""
    t = T.turns(spark, sf).select(F.to_json(F.struct("session", "seq", "role", "text")).alias("line")).where(F.contains("line", F.lit('"role":"assistant"')))
    r = t.select(F.from_json("line", "session bigint, seq bigint, role string, text string").alias("r")).select("r.*")
    return r.where(F.contains("text", F.lit("e")) & (F.col("role") == "assistant")).select("session", "seq")


@query(f"SELECT topic, created, seq, value FROM {DECISIONS}")
def s27_all_decisions(spark, sf):
    return T.decisions(spark, sf).select("topic", "created", "seq", "value")


@query(f"SELECT id, session, ts_us FROM {PROPOSALS} WHERE status = 'open' AND shape = 'click' ORDER BY ts_us DESC, id DESC LIMIT 100")
def s30_proposals(spark, sf):
    return R.top_k(T.proposals(spark, sf).where("status = 'open' and shape = 'click'").select("id", "session", "ts_us"), 100, F.desc("ts_us"), F.desc("id"))


@query(f"SELECT id, kind, deleted FROM {TOMBS}")
def s31_tombstones(spark, sf):
    return T.tombstones(spark, sf)


@query(f"""WITH p AS (SELECT DISTINCT file AS path FROM {SURVEY}), m(marker, project) AS (VALUES ('ECONOMY', 'a'), ('PROMO', 'b'), ('MEDIUM', 'a'))
 SELECT split_part(path, '/', 1) AS root, list(DISTINCT project ORDER BY project) AS projects FROM p JOIN m ON split_part(path, '/', 2) = marker GROUP BY 1""")
def s21_project_markers(spark, sf):
    marks = spark.createDataFrame([("ECONOMY", "a"), ("PROMO", "b"), ("MEDIUM", "a")], "marker string, project string")
    paths = T.survey(spark, sf).select(F.split_part("file", F.lit("/"), F.lit(1)).alias("root"), F.split_part("file", F.lit("/"), F.lit(2)).alias("marker")).distinct()
    return paths.join(F.broadcast(marks), "marker").groupBy("root").agg(F.sort_array(F.collect_set("project")).alias("projects"))


@query(f"SELECT id, name FROM {SURVEY} WHERE kind = 'PROMO' ORDER BY id LIMIT 200")
def s22_read_only_entries(spark, sf):
    return R.top_k(T.survey(spark, sf).where("kind = 'PROMO'").select("id", "name"), 200, "id")


@query(f"SELECT name, min(id) AS id FROM {SURVEY} GROUP BY name")
def s23_first_skill_wins(spark, sf):
    return T.survey(spark, sf).groupBy("name").agg(F.min("id").alias("id"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS name, n_regionkey AS inc FROM nation), c(name, inc) AS (SELECT name, inc FROM e UNION SELECT c.name, e.inc FROM c JOIN e ON e.name = c.inc) SELECT name, inc FROM c""")
def s24_include_closure(spark, sf):
    """Blueprints name others that they include; all that are reached count once."""
    e = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("name"), F.col("n_regionkey").cast("int").alias("inc"))
    return R.closure(e, "name", "inc")


# mutations


@query(f"SELECT id, category, size FROM {MEMORIES} UNION ALL SELECT id + 1000000000, 'new', size FROM {MEMORIES} WHERE category = 'en'")
def k1_insert(spark, sf):
    m = T.memories(spark, sf).select("id", "category", "size")
    store = Store(m, ["id"], "memory")
    store.insert(m.where("category = 'en'").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("new").alias("category"), "size").unionByName(m))
    return store.current()


@query(f"SELECT id, CASE WHEN size > 2000 THEN 'long' ELSE category END AS category, size FROM {MEMORIES}")
def k2_update_if_exists(spark, sf):
    store = Store(T.memories(spark, sf).select("id", "category", "size"), ["id"])
    store.update(F.col("size") > 2000, category=F.lit("long"))
    return store.current()


@query(f"SELECT topic, seq, value, precedence FROM {DECISIONS} UNION ALL SELECT topic, seq + 1000000000, '0-NEW', 0 FROM {DECISIONS} WHERE value = '1-URGENT'")
def k6_append_version(spark, sf):
    d = T.decisions(spark, sf).select("topic", "seq", "value", "precedence")
    store = Store(d, ["topic", "seq"], "decision")
    store.insert(d.where("value = '1-URGENT'").select("topic", (F.col("seq") + 1_000_000_000).alias("seq"), F.lit("0-NEW").alias("value"), F.lit(0).alias("precedence")))
    return store.current()


@query(f"SELECT id, CASE WHEN status = 'claimed' THEN 'done' ELSE status END AS status, CASE WHEN status = 'claimed' THEN DATE '2024-01-01' ELSE completed END AS completed FROM {TASKS}")
def k9_complete_task(spark, sf):
    store = Store(T.tasks(spark, sf).select("id", "status", "completed"), ["id"])
    store.update(F.col("status") == "claimed", status=F.lit("done"), completed=F.lit("2024-01-01"))
    return store.current()


@query(f"SELECT id, analyzer, file, severity FROM {FINDINGS} WHERE NOT (analyzer = 'src1' AND starts_with(file, 'en/')) UNION ALL SELECT id + 1000000000, analyzer, file, 'info' FROM {FINDINGS} WHERE analyzer = 'src1' AND starts_with(file, 'en/')")
def k12_replace_analyzer_and_file(spark, sf):
    f = T.findings(spark, sf).select("id", "analyzer", "file", "severity")
    store = Store(f, ["id"])
    there = (F.col("analyzer") == "src1") & F.startswith("file", F.lit("en/"))
    store.replace(there, f.where(there).select((F.col("id") + 1_000_000_000).alias("id"), "analyzer", "file", F.lit("info").alias("severity")))
    return store.current()


@query(f'SELECT file, symbol, "start" FROM {SYMBOLS} WHERE file <> 9 UNION ALL SELECT file, symbol, "start" + 1 FROM {SYMBOLS} WHERE file = 9')
def k13_replace_file_index(spark, sf):
    s = T.symbols(spark, sf).select("file", "symbol", "start")
    store = Store(s, ["file", "symbol"])
    store.replace(F.col("file") == 9, s.where("file = 9").withColumn("start", F.col("start") + 1))
    return store.current()


@query(f"SELECT count(*) FILTER (id <= 100 AND NOT accepted) AS changed, count(*) FILTER (accepted OR id <= 100) AS accepted FROM {FINDINGS}")
def k14_accept_by_id(spark, sf):
    """Accepting twice changes nothing the second time."""
    store = Store(T.findings(spark, sf).select("id", "accepted"), ["id"])
    pending = (F.col("id") <= 100) & ~F.col("accepted")
    changed = store.update(pending, accepted=F.lit(True)) + store.update(pending, accepted=F.lit(True))
    return store.current().agg(F.lit(changed).cast("bigint").alias("changed"), F.count(F.when(F.col("accepted"), 1)).alias("accepted"))


@query(f"SELECT (SELECT count(*) FROM {DECISIONS} WHERE topic <> 37) AS rows_left, (SELECT count(*) FROM {DECISIONS} WHERE topic = 37) AS buried, 'decision' AS kind")
def k21_delete_topic(spark, sf):
    store = Store(T.decisions(spark, sf), ["topic", "seq"], "decision")
    store.delete(F.col("topic") == 37, tombstone=True)
    return store.current().agg(F.count("*").alias("rows_left")).crossJoin(store.tombstones().agg(F.count("*").alias("buried"))).withColumn("kind", F.lit("decision"))


@query(f"SELECT file, list(symbol ORDER BY symbol) AS symbols FROM {SYMBOLS} WHERE symbol <> (SELECT min(symbol) FROM {SYMBOLS}) GROUP BY file")
def k22_delete_symbol(spark, sf):
    """The file index derives from the rows, so a deleted symbol leaves it as well."""
    s = T.symbols(spark, sf).select("file", "symbol")
    store = Store(s, ["symbol"])
    first = s.agg(F.min("symbol")).first()[0]
    store.delete(F.col("symbol") == first)
    return store.current().groupBy("file").agg(F.sort_array(F.collect_list("symbol")).alias("symbols"))


@query(f"SELECT file, symbol FROM {SYMBOLS} WHERE file <> 12")
def k23_clear_file(spark, sf):
    store = Store(T.symbols(spark, sf).select("file", "symbol"), ["file", "symbol"])
    store.delete(F.col("file") == 12)
    return store.current()


@query(f"SELECT id, category FROM {MEMORIES} WHERE category = 'de'")
def k24_clear_and_refill(spark, sf):
    m = T.memories(spark, sf).select("id", "category")
    store = Store(m, ["id"])
    store.clear()
    store.put(m.where("category = 'de'"))
    return store.current()


@query(f"SELECT id, status, rejections FROM {PROPOSALS} UNION ALL SELECT id + 1000000000, 'open', 0 FROM {PROPOSALS} WHERE shape = 'signup'")
def k26_add_proposal(spark, sf):
    p = T.proposals(spark, sf).select("id", "status", "rejections")
    store = Store(p, ["id"])
    fresh = T.proposals(spark, sf).where("shape = 'signup'").select((F.col("id") + 1_000_000_000).alias("id"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("rejections"))
    store.insert(fresh.select("id", F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("rejections", F.lit(0)).alias("rejections")))
    return store.current()


@query(f"""SELECT id, CASE WHEN status = 'open' AND session % 2 = 0 THEN 'accepted' WHEN status = 'open' THEN 'rejected' ELSE status END AS status,
 CASE WHEN status = 'open' AND session % 2 <> 0 THEN rejections + 1 ELSE rejections END AS rejections, CASE WHEN status = 'open' AND session % 2 = 0 THEN id + 7 ELSE memory END AS memory FROM {PROPOSALS}""")
def k27_proposal_states(spark, sf):
    store = Store(T.proposals(spark, sf).select("id", "session", "status", "rejections", "memory"), ["id"])
    store.update((F.col("status") == "open") & (F.col("session") % 2 == 0), status=F.lit("accepted"), memory=F.col("id") + 7)
    store.update(F.col("status") == "open", status=F.lit("rejected"), rejections=F.col("rejections") + 1)
    return store.current().select("id", "status", "rejections", "memory")


@query(f"SELECT id, name FROM {EVENTS} UNION ALL SELECT id + 1000000000, 'legacy' FROM {EVENTS} WHERE kind = 'read'")
def k28_drain_legacy(spark, sf):
    """Draining is guarded by what is there already, so a second run adds nothing."""
    e = T.events(spark, sf)
    store = Store(e.select("id", "name"), ["id"])
    legacy = e.where("kind = 'read'").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("legacy").alias("name"))
    store.insert(legacy)
    store.insert(legacy)
    return store.current()


@query(f"SELECT id, kind, max(deleted) AS deleted FROM (SELECT id, kind, deleted FROM {TOMBS} UNION ALL SELECT id, kind, 5 FROM {TOMBS} WHERE kind = 'BUILDING') x GROUP BY id, kind")
def k29_record_tombstone(spark, sf):
    t = T.tombstones(spark, sf)
    store = Store(t, ["kind", "id"])
    store.put(t.where("kind = 'BUILDING'").withColumn("deleted", F.lit(5).cast("bigint")))
    return store.current().select("id", "kind", "deleted")


@query(f"SELECT id, CASE WHEN kind IN ('read', 'outline') THEN tokens ELSE CAST(round((length(name) + 1) / 3.0) AS BIGINT) END AS cost, CASE WHEN kind = 'failure' THEN 'error ' || k END AS error FROM {EVENTS}")
def k30_record_tool_event(spark, sf):
    e = T.events(spark, sf)
    cost = F.when(F.col("kind").isin("read", "outline"), F.col("tokens")).otherwise(F.round((F.length("name") + 1) / 3.0).cast("bigint"))
    store = Store(e.select("id", F.lit(0).cast("bigint").alias("cost"), F.lit(None).cast("string").alias("error")).limit(0), ["id"])
    store.put(e.select("id", cost.alias("cost"), F.when(F.col("kind") == "failure", F.concat(F.lit("error "), F.col("k").cast("string"))).alias("error")))
    return store.current()


# retention


@query(f"SELECT id FROM {EVENTS} WHERE kind <> 'read' OR ts_us >= (SELECT max(ts_us) - 10 * 86400000000 FROM {EVENTS})")
def r2_legacy_retention(spark, sf):
    e = T.events(spark, sf)
    cutoff = e.agg((F.max("ts_us") - 10 * 86_400_000_000).alias("cutoff"))
    return e.join(F.broadcast(cutoff), (F.col("kind") != "read") | (F.col("ts_us") >= F.col("cutoff"))).select("id")


@query(f"SELECT id FROM {MESSAGES} WHERE expires >= (SELECT max(created) - 86400000000 FROM {MESSAGES})")
def r4_message_retention(spark, sf):
    m = T.messages(spark, sf)
    now = m.agg((F.max("created") - 86_400_000_000).alias("now"))
    return m.join(F.broadcast(now), F.col("expires") >= F.col("now")).select("id")


@query(f"SELECT status, count(*) AS n FROM {TASKS} WHERE status <> 'done' GROUP BY status")
def r7_clear_by_status(spark, sf):
    store = Store(T.tasks(spark, sf).select("id", "status"), ["id"])
    store.delete(F.col("status") == "done")
    return store.current().groupBy("status").agg(F.count("*").alias("n"))


# predicates


@query(f"SELECT id FROM {MEMORIES} WHERE NOT list_has_any(tags, ['long', 'lang:de'])")
def p3_exclude_tags(spark, sf):
    return T.memories(spark, sf).where(~S.any_tag(F.col("tags"), ["long", "lang:de"])).select("id")


@query(f"SELECT id FROM {MEMORIES} WHERE list_has_any(tags, ['forget', 'lang:fr']) AND list_contains(tags, 'src1')")
def p4_any_tag(spark, sf):
    return T.memories(spark, sf).where(S.any_tag(F.col("tags"), ["forget", "lang:fr"]) & F.array_contains("tags", "src1")).select("id")


@query(f"SELECT id FROM {SURVEY} WHERE analyzer = 'Brand#2' AND kind = 'PROMO' AND contains(file, 'd#2/')")
def p8_survey_predicate(spark, sf):
    return T.survey(spark, sf).where((F.col("analyzer") == "Brand#2") & (F.col("kind") == "PROMO") & F.contains("file", F.lit("d#2/"))).select("id")


@query(f"SELECT id, CASE WHEN list_bool_or(list_transform(tags, lambda x: x LIKE 'lang:d%')) THEN 'lang:d*' WHEN list_bool_or(list_transform(tags, lambda x: x LIKE '%1')) THEN '*1' END AS excluded_by FROM {MEMORIES}")
def p10_first_exclude(spark, sf):
    return T.memories(spark, sf).select("id", S.first_match(F.col("tags"), ["lang:d*", "*1"]).alias("excluded_by"))


@query("SELECT url, regexp_full_match(url, 'http.*/fr/.*') AS matches FROM (SELECT DISTINCT url FROM pages) u")
def p11_anchored_glob(spark, sf):
    return T.table(spark, sf, "pages").select("url").distinct().select("url", F.rlike("url", F.lit("(?s)" + S.glob_to_regex("http*/fr/*"))).alias("matches"))


@query(f"SELECT id FROM {MESSAGES} WHERE (addressee = 0 OR addressee = 7) AND parent = 3")
def p14_messages_of_parent(spark, sf):
    return T.messages(spark, sf).where("(addressee = 0 or addressee = 7) and parent = 3").select("id")


@query(f"SELECT id, CASE kind WHEN 'read' THEN 'purchase' WHEN 'outline' THEN 'view' WHEN 'symbol' THEN 'click' WHEN 'injected' THEN 'signup' ELSE 'error' END AS name, CAST(tokens AS VARCHAR) AS tokens_attr FROM {EVENTS} WHERE kind IS NOT NULL")
def p17_token_to_observe(spark, sf):
    back = {v: k for k, v in T.TOKEN_KINDS.items()}
    e = T.events(spark, sf).where("kind is not null")
    attrs = F.create_map(F.lit("tokens"), F.col("tokens").cast("string"))
    return e.select("id", S.lookup(F.col("kind"), back, "error").alias("name"), attrs["tokens"].alias("tokens_attr"))


@query(f"SELECT id FROM {EVENTS} WHERE ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 12:00:00'")
def p18_time_range(spark, sf):
    since, until = S.time_range("2024-01-03T00:00:00Z", "2024-01-05T12:00:00Z")
    return T.events(spark, sf).where(F.col("ts_us").between(since, until)).select("id")


@query(f"SELECT id FROM {EVENTS} WHERE name = 'click' AND (contains(lower(kind), 'sym') OR contains(CAST(session AS VARCHAR), '3') OR contains(CAST(k AS VARCHAR), '3')) AND contains(CAST(k AS VARCHAR), '3')")
def p19_dashboard_filter(spark, sf):
    e = T.events(spark, sf).where("name = 'click'")
    hit = S.contains_fold(F.col("k").cast("string"), "3")
    return e.where((S.contains_fold(F.col("kind"), "sym") | S.contains_fold(F.col("session").cast("string"), "3") | hit) & hit).select("id")


@query(f"SELECT DISTINCT name, regexp_matches(name, '^[A-Z]') OR NOT starts_with(name, '_') AS exported FROM {SURVEY}")
def p21_exported(spark, sf):
    n = F.col("name")
    return T.survey(spark, sf).select(n, (F.rlike(n, F.lit("^[A-Z]")) | ~F.startswith(n, F.lit("_"))).alias("exported")).distinct()


@query(f"SELECT kind, min(deleted) AS horizon, min(deleted) > -500 AS fresh FROM {TOMBS} GROUP BY kind")
def p22_stale_guard(spark, sf):
    return T.tombstones(spark, sf).groupBy("kind").agg(F.min("deleted").alias("horizon")).withColumn("fresh", F.col("horizon") > -500)


@query(f"SELECT id, session FROM (SELECT id, session, kind, k, lag(id) OVER (PARTITION BY session, k ORDER BY ts_us, id) AS earlier FROM {EVENTS} WHERE kind IN ('read', 'outline')) x WHERE earlier IS NOT NULL AND kind = 'read' AND k >= 20")
def p23_reread_hint(spark, sf):
    """k stands for the file: a read of one that the session has seen before, unless it is a targeted one (k < 20)."""
    w = Window.partitionBy("session", "k").orderBy("ts_us", "id")
    e = T.events(spark, sf).where(F.col("kind").isin("read", "outline")).withColumn("earlier", F.lag("id").over(w))
    return e.where("earlier is not null and kind = 'read' and k >= 20").select("id", "session")


@query(f'SELECT y.symbol, coalesce(n, 0) AS n FROM {SYMBOLS} LEFT JOIN (SELECT file, count(*) AS n FROM {REFS} GROUP BY file) c ON c.file = y.file WHERE regexp_matches(CAST(y.symbol AS VARCHAR), \'^12\')')
def p24_search_enrichment(spark, sf):
    """Symbols that a plain pattern matches, each with the references to its file."""
    counts = T.references(spark, sf).groupBy("file").agg(F.count("*").alias("n"))
    hits = T.symbols(spark, sf).where(F.rlike(F.col("symbol").cast("string"), F.lit("^12")))
    return hits.join(counts, "file", "left").select("symbol", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"SELECT id, status FROM {TASKS} WHERE status <> 'done' AND (owner IS NULL OR owner = 77)")
def p26_incomplete_tasks(spark, sf):
    return T.tasks(spark, sf).where("status <> 'done' and (owner is null or owner = 77)").select("id", "status")
