"""Summaries, hints and checks with all parts of their definitions, over tool events, changes and pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .detectors import OS, TOOL_EVENTS
from .filters import EVENTS, MEMORIES
from .joins import REFS
from .registry import query
from .windows import SYMBOLS

# token statistics and summaries


@query(f"""SELECT kind, name, k, day, count(*) AS n, sum(tokens) AS tokens, coalesce(sum(tokens) FILTER (kind = 'read'), 0) AS read_tokens, coalesce(sum(tokens) FILTER (kind IN ('outline', 'symbol')), 0) AS saved, count(*) FILTER (kind = 'failure') AS failures, count(DISTINCT session) AS sessions
 FROM (SELECT *, CAST(ts AS DATE) AS day FROM {EVENTS}) e GROUP BY GROUPING SETS ((), (kind), (name), (k), (day))""")
def a1_token_stats_overall(spark, sf):
    """All events, and by kind, name, attribute and day, in one pass; what reads cost and outlines saved, and how many sessions."""
    e = T.events(spark, sf).withColumn("day", F.col("ts").cast("date"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("tokens"))), F.lit(0))
    keys = [F.col(c) for c in ("kind", "name", "k", "day")]
    out = e.groupingSets([[], *[[k] for k in keys]], *keys)
    return out.agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), of(F.col("kind") == "read").alias("read_tokens"), of(F.col("kind").isin("outline", "symbol")).alias("saved"), F.count_if(F.col("kind") == "failure").alias("failures"), F.count_distinct("session").alias("sessions"))


@query(f"""SELECT kind, os, count(*) AS n, CAST(sum(floor((epoch_us(arrived_at) - epoch_us(ts)) / 1000.0)) AS BIGINT) AS total_ms, sum(CAST(floor(value) AS BIGINT)) AS tokens FROM (SELECT kind, {OS} AS os, arrived_at, ts, value FROM clicks WHERE ts IS NOT NULL AND arrived_at IS NOT NULL AND value IS NOT NULL) c
 GROUP BY GROUPING SETS ((kind), (os)) HAVING kind IS NOT NULL OR os IS NOT NULL""")
def a2_summary_with_durations(spark, sf):
    """How often, how long (until they arrived) and how much, by kind and by system; rows without the key are skipped."""
    c = T.table(spark, sf, "clicks").where("ts is not null and arrived_at is not null and value is not null")
    os = F.nullif(F.regexp_extract("props", '"os": "([a-z]+)"', 1), F.lit("")).alias("os")
    took = F.floor((T.micros(F.col("arrived_at")) - T.micros(F.col("ts"))) / 1000)
    c = c.select("kind", os, took.alias("ms"), F.floor("value").cast("bigint").alias("tokens"))
    out = c.groupingSets([[F.col("kind")], [F.col("os")]], F.col("kind"), F.col("os")).agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.sum("tokens").alias("tokens"))
    return out.where("kind is not null or os is not null")


@query(f"""WITH s AS (SELECT session, max(ts_us) AS newest FROM {TOOL_EVENTS} GROUP BY session ORDER BY newest DESC, session LIMIT 20)
 SELECT session, newest, list(DISTINCT file ORDER BY file) FILTER (file IS NOT NULL) AS files FROM {TOOL_EVENTS} JOIN s USING (session) GROUP BY session, newest""")
def a11_sessions_with_members(spark, sf):
    """The sessions are chosen first, so only theirs are gathered."""
    e = T.tool_events(spark, sf)
    top = R.top_k(e.groupBy("session").agg(F.max("ts_us").alias("newest")), 20, F.desc("newest"), "session")
    # twenty rows
    return e.join(F.broadcast(top), "session").groupBy("session", "newest").agg(F.sort_array(F.collect_set("file")).alias("files"))


@query("""WITH s AS (SELECT 'agent:' || client_id || ':' || f AS key, v, valid_at, seq, change_id FROM (SELECT client_id, unnest(['city', 'segment', 'balance']) AS f, unnest([city, segment, CAST(CAST(floor(balance) AS BIGINT) AS VARCHAR)]) AS v, valid_at, seq, change_id FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL) x),
 k AS (SELECT CAST(split_part(key, ':', 2) AS BIGINT) AS agent, split_part(key, ':', 3) AS field, v, valid_at, seq, change_id FROM s), l AS (SELECT agent, field, arg_max({'v': v}, (valid_at, seq, change_id)).v AS v, max(valid_at) AS updated FROM k GROUP BY ALL)
 SELECT agent, max(v) FILTER (field = 'city') AS city, max(v) FILTER (field = 'segment') AS segment, max(v) FILTER (field = 'balance') AS balance FROM l GROUP BY agent HAVING max(updated) >= TIMESTAMP '2024-03-01'""")
def a13_agents_of_state(spark, sf):
    """State is rows of a key with three parts and a value; the latest of each key counts, agents without a change since March are stale."""
    c = T.table(spark, sf, "client_changes").where("client_id is not null and valid_at is not null")
    fields = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), v.alias("v")) for n, v in (("city", F.col("city")), ("segment", F.col("segment")), ("balance", F.floor("balance").cast("bigint").cast("string")))]))
    state = c.select("client_id", "valid_at", "seq", "change_id", fields.alias("x")).select(F.concat_ws(":", F.lit("agent"), "client_id", "x.f").alias("key"), "x.v", "valid_at", "seq", "change_id")
    parts = F.split("key", ":", 3)
    latest = state.groupBy("key").agg(F.max_by("v", F.struct("valid_at", "seq", "change_id")).alias("v"), F.max("valid_at").alias("updated"))
    rows = latest.select(parts[1].cast("bigint").alias("agent"), parts[2].alias("field"), "v", "updated")
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("v"))).alias(f)
    return rows.groupBy("agent").agg(of("city"), of("segment"), of("balance"), F.max("updated").alias("u")).where("u >= timestamp_ntz'2024-03-01 00:00:00'").drop("u").orderBy("agent")


DIRS = "(SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, list_slice(string_split(regexp_replace(url, '[?#].*$', ''), '/'), 4, -2) AS dirs FROM pages) u"


@query(f"SELECT host, array_to_string(list_slice(a, 1, coalesce(list_position(list_transform(range(1, greatest(len(a), len(b)) + 2), lambda i: coalesce(a[i] = b[i], false)), false) - 1, 0)), '/') AS shared FROM (SELECT host, min(dirs) AS a, max(dirs) AS b FROM {DIRS} GROUP BY host) x")
def a20_common_directory(spark, sf):
    """The directories that all pages of a host share: those that the least and the largest list of directories share."""
    names = F.split(F.regexp_replace("url", "[?#].*$", ""), "/")
    p = T.table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.slice(names, F.lit(4), F.greatest(F.size(names) - 4, F.lit(0))).alias("dirs"))
    ends = p.groupBy("host").agg(F.min("dirs").alias("a"), F.max("dirs").alias("b"))
    same = F.transform(F.sequence(F.lit(1), F.size("a") + 1), lambda i: F.coalesce(F.try_element_at("a", i) == F.try_element_at("b", i), F.lit(False)))
    return ends.select("host", F.array_join(F.slice("a", F.lit(1), F.array_position(same, False).cast("int") - 1), "/").alias("shared"))


_FIRST = "CASE WHEN list_bool_or(list_transform(tags, lambda x: x LIKE 'lang:d%')) THEN 'lang:d*' WHEN list_bool_or(list_transform(tags, lambda x: x LIKE '%1')) THEN '*1' END"
_IN = "list_bool_or(list_transform(tags, lambda x: x LIKE 'lang:%' OR x = 'src2'))"


@query(f"SELECT id, {_FIRST} IS NULL AND {_IN} AS published FROM {MEMORIES}")
def p9_include_and_exclude(spark, sf):
    """A pattern of the include list has to match unless the list is empty, and none of the exclude list may."""
    return T.memories(spark, sf).select("id", S.included(F.col("tags"), ["lang:*", "src2"], ["lang:d*", "*1"]).alias("published"))


@query(f"SELECT excluded_by, count(*) AS n, sum(count(*)) OVER () AS total, sum(count(*) FILTER (excluded_by IS NULL)) OVER () AS published FROM (SELECT {_FIRST} AS excluded_by FROM {MEMORIES}) x GROUP BY excluded_by")
def a27_preview_with_totals(spark, sf):
    """How many a filter would publish and which pattern holds back how many; the groups are as few as the patterns."""
    by = T.memories(spark, sf).groupBy(S.first_match(F.col("tags"), ["lang:d*", "*1"]).alias("excluded_by")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return by.select("excluded_by", "n", F.sum("n").over(w).alias("total"), F.sum(F.when(F.col("excluded_by").isNull(), F.col("n"))).over(w).alias("published")).orderBy(F.desc("n"), "excluded_by")


@query(f"""WITH e AS (SELECT session, count(DISTINCT file) AS files, count(DISTINCT name) AS tools FROM {TOOL_EVENTS} GROUP BY session),
 u AS (SELECT conv_id AS session, list(left(text, 200) ORDER BY turn, text) AS said FROM conversations WHERE role = 'user' AND length(text) BETWEEN 11 AND 499 GROUP BY conv_id) SELECT coalesce(e.session, u.session) AS session, coalesce(files, 0) AS files, coalesce(tools, 0) AS tools, said FROM e FULL JOIN u ON u.session = e.session""")
def a28_transcripts(spark, sf):
    """Distinct files and tools of a session, and what its user said, neither very short nor long."""
    e = T.tool_events(spark, sf).groupBy("session").agg(F.count_distinct("file").alias("files"), F.count_distinct("name").alias("tools"))
    turns = T.turns(spark, sf).where("role = 'user' and length(text) between 11 and 499")
    said = turns.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l")).select("session", F.transform("l", lambda x: F.substring(x["text"], 1, 200)).alias("said"))
    return e.join(said, "session", "full_outer").select("session", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("tools", F.lit(0)).alias("tools"), "said")


# checks and hints


@query("""WITH h AS (SELECT source, max(valid_at) AS horizon FROM client_changes WHERE op = 'D' AND valid_at < TIMESTAMP '2024-02-15' GROUP BY source), i AS (SELECT source, max(updated_at) AS imported FROM clients GROUP BY source)
 SELECT i.source, coalesce(imported < horizon, false) AS refuse FROM i LEFT JOIN h ON h.source = i.source""")
def p22_refuse_stale_trees(spark, sf):
    """A tree is refused when its last import precedes the newest deletion that is no longer kept."""
    gone = T.table(spark, sf, "client_changes").where("op = 'D' and valid_at < timestamp_ntz'2024-02-15 00:00:00'").groupBy("source").agg(F.max("valid_at").alias("horizon"))
    imported = T.table(spark, sf, "clients").groupBy("source").agg(F.max("updated_at").alias("imported"))
    return imported.join(gone, "source", "left").select("source", F.coalesce(F.col("imported") < F.col("horizon"), F.lit(False)).alias("refuse"))


@query(f"""SELECT id, session, file FROM (SELECT *, lag(name) OVER w AS before, count(*) FILTER (name = 'view') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reads FROM {TOOL_EVENTS} WHERE file IS NOT NULL AND name IN ('view', 'purchase') WINDOW w AS (PARTITION BY session, file ORDER BY ts_us, id)) x
 WHERE name = 'view' AND reads > 0 AND before = 'view' AND CAST(file AS BIGINT) IN (SELECT item_id FROM items WHERE name IS NOT NULL)""")
def p23_reread_of_fresh_files(spark, sf):
    """A file that the session has read, that is indexed, and that nothing has changed since."""
    w = Window.partitionBy("session", "file").orderBy("ts_us", "id")
    e = T.tool_events(spark, sf).where("file is not null and name in ('view', 'purchase')").withColumn("before", F.lag("name").over(w))
    indexed = T.table(spark, sf, "items").where("name is not null").select(F.col("item_id").cast("string").alias("file"))
    return e.where("name = 'view' and before = 'view'").join(indexed, "file", "left_semi").select("id", "session", "file")


@query("""SELECT q.pattern, w.symbol, coalesce(n, 0) AS n FROM (VALUES ('bolt'), ('wid'), ('la[rs]ge'), ('a b')) q(pattern) JOIN (SELECT DISTINCT split_part(name, ' ', 2) AS symbol FROM items WHERE name IS NOT NULL) w ON contains(w.symbol, q.pattern)
 LEFT JOIN (SELECT split_part(i.name, ' ', 2) AS symbol, count(*) AS n FROM sale_lines l JOIN items i USING (item_id) WHERE i.name IS NOT NULL GROUP BY 1) c ON c.symbol = w.symbol WHERE regexp_full_match(q.pattern, '[A-Za-z_][A-Za-z0-9_]*')""")
def p24_enriched_patterns(spark, sf):
    """Only a pattern that is a plain symbol is looked up; its matches come with their references."""
    asked = spark.createDataFrame([("bolt",), ("wid",), ("la[rs]ge",), ("a b",)], "pattern string")  # a fixed list
    items = T.table(spark, sf, "items").where("name is not null").select("item_id", F.split_part("name", F.lit(" "), F.lit(2)).alias("symbol"))
    counts = T.table(spark, sf, "sale_lines").join(items, "item_id").groupBy("symbol").agg(F.count("*").alias("n"))
    plain = asked.where(F.rlike("pattern", F.lit("^[A-Za-z_][A-Za-z0-9_]*$")))
    hits = items.select("symbol").distinct().join(F.broadcast(plain), F.contains("symbol", "pattern"))
    return hits.join(counts, "symbol", "left").select("pattern", "symbol", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH m AS (SELECT session, count(*) AS unread FROM {TOOL_EVENTS} e WHERE name = 'error' AND NOT EXISTS (SELECT 1 FROM {TOOL_EVENTS.replace("WHERE client_id", "AS z WHERE client_id")} r WHERE r.session = e.session AND r.file = e.file AND r.name = 'view' AND r.ts_us > e.ts_us) GROUP BY session)
 SELECT CAST(o.client_id AS BIGINT) AS agent, max(o.status = 'held') AS held, epoch(max(o.sold_at)) - epoch(TIMESTAMP '2024-04-01') AS seconds_left, coalesce(max(m.unread), 0) AS unread FROM sales o LEFT JOIN m ON m.session = o.client_id WHERE o.client_id IS NOT NULL AND o.sold_at IS NOT NULL GROUP BY o.client_id""")
def p25_signals_of_agents(spark, sf):
    """A flag, the seconds to an agent's last deadline, and errors of it whose file nobody has looked at since."""
    e = T.tool_events(spark, sf)
    seen = e.where("name = 'view'").groupBy("session", "file").agg(F.max("ts_us").alias("seen"))
    unread = e.where("name = 'error'").join(seen, ["session", "file"], "left").where("seen is null or seen <= ts_us").groupBy("session").agg(F.count("*").alias("unread"))
    s = T.table(spark, sf, "sales").where("client_id is not null and sold_at is not null")
    now = 1_711_929_600
    agents = s.groupBy(F.col("client_id").alias("agent")).agg(F.max(F.col("status") == "held").alias("held"), (F.max(T.micros(F.col("sold_at"))) / 1_000_000 - now).cast("bigint").alias("seconds_left"))
    return agents.join(unread.withColumnRenamed("session", "agent"), "agent", "left").select("agent", "held", "seconds_left", F.coalesce("unread", F.lit(0)).alias("unread"))


# joins of code


@query(f"""SELECT symbol, target, line FROM (SELECT s.symbol, t.symbol AS target, r.line, row_number() OVER (PARTITION BY s.symbol, t.symbol ORDER BY r.line, r.id) AS rn FROM {SYMBOLS} JOIN {REFS} ON s.file = r.file AND r.line BETWEEN s."start" AND s."end"
 JOIN (SELECT file, min(symbol) AS symbol FROM {SYMBOLS} GROUP BY file) t ON t.file = r.id % 500 + 1 WHERE t.symbol <> s.symbol) x WHERE rn = 1""")
def j3_callees_first_per_target(spark, sf):
    """What a symbol's body refers to: each target once, where it comes first, without the symbol itself. A reference names the first symbol of a file."""
    s = T.symbols(spark, sf)
    defined = s.groupBy(F.col("file").alias("names")).agg(F.min("symbol").alias("target"))
    refs = T.references(spark, sf).withColumn("names", F.col("id") % 500 + 1).join(defined, "names").withColumn("b", F.floor(F.col("line") / 64))
    cut = s.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / 64), F.floor(F.col("end") / 64))))
    met = refs.join(cut, ["file", "b"]).where("line between start and end and target <> symbol")
    return met.groupBy("symbol", "target").agg(F.min("line").alias("line"))


@query(f"""SELECT DISTINCT caller, file FROM (SELECT r.id, r.file, arg_min(y.symbol, (y."end" - y."start", y.symbol)) AS caller FROM {REFS} JOIN {SYMBOLS.replace(') s', ') y')} ON y.file = r.file AND r.line BETWEEN y."start" AND y."end" GROUP BY r.id, r.file) x""")
def j4_callers_once(spark, sf):
    """Each caller of a file once, however often it refers."""
    refs = T.references(spark, sf)
    found = R.narrowest_range(refs, T.symbols(spark, sf), "file", "line", "start", "end", "id", "symbol")
    return found.join(refs.select("id", "file"), "id").select(F.col("symbol").alias("caller"), "file").distinct()


@query("""WITH n AS (SELECT item_id AS id, name, brand, split_part(name, ' ', 2) AS word FROM items WHERE name IS NOT NULL AND kind <> 'toys' AND brand <> 'B1'),
 k AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part WHERE p_retailprice < 900.3)
 SELECT id FROM n WHERE regexp_matches(name, '^[a-z]') AND id NOT IN (SELECT item_id FROM sale_lines WHERE item_id IS NOT NULL AND flag = 'returned' AND quantity >= 30) AND word NOT IN (SELECT word FROM k)""")
def f4_dead_symbols(spark, sf):
    """Eligible (no toys), exported by its first letter, not of a suppressed brand, in no large return (its references), and named by no cheap part (its words elsewhere)."""
    n = T.table(spark, sf, "items").where("name is not null and kind <> 'toys' and brand <> 'B1'").where(F.rlike("name", F.lit("^[a-z]")))
    n = n.select(F.col("item_id").alias("id"), F.split_part("name", F.lit(" "), F.lit(2)).alias("word"))
    used = T.table(spark, sf, "sale_lines").where("flag = 'returned' and quantity >= 30").select(F.col("item_id").alias("id"))
    elsewhere = T.table(spark, sf, "part").where("p_retailprice < 900.3").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word"))
    return n.join(used, "id", "left_anti").join(elsewhere, "word", "left_anti").select("id")


@query(f"SELECT id, CASE WHEN name = 'click' THEN 'Bash `' || command || ' | sort`' WHEN file IS NOT NULL THEN name || ' ' || file ELSE name END AS signature FROM {TOOL_EVENTS} WHERE name IS NOT NULL")
def fs7_signature_of_what_failed(spark, sf):
    """The command of a shell call (clicks are these), else the tool and its file, else the tool."""
    e = T.tool_events(spark, sf).where("name is not null")
    shell = F.concat(F.lit("Bash `"), S.command_signature(F.col("command")), F.lit("`"))
    return e.select("id", F.when(F.col("name") == "click", shell).when(F.col("file").isNotNull(), F.concat_ws(" ", "name", "file")).otherwise(F.col("name")).alias("signature"))


# ranks and repeats


@query("SELECT item_id AS id, row_number() OVER (ORDER BY price DESC NULLS LAST, item_id) AS position FROM items")
def w13_positions_overall(spark, sf):
    """The place of every item by price, from ranges that count their own rows."""
    i = T.table(spark, sf, "items").select(F.col("item_id").alias("id"), "price")
    return R.ranked(i, F.desc_nulls_last("price"), "id").select("id", (F.col("rank") + 1).alias("position"))


_CALLS = f"(SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_us, id) AS seq FROM {TOOL_EVENTS}) c"


@query(f"SELECT id, earlier FROM (SELECT id, seq, lag(id) OVER w AS earlier, lag(seq) OVER w AS at_seq FROM {_CALLS} WHERE file IS NOT NULL AND name IS NOT NULL WINDOW w AS (PARTITION BY session, name, file, coalesce(error, '') ORDER BY seq)) x WHERE seq - at_seq <= 200")
def w14_repeats_within_200_calls(spark, sf):
    """A call equal to an earlier one of its session in tool, file and output, among the 200 calls before it; the most recent one."""
    e = T.tool_events(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("ts_us", "id"))).where("file is not null and name is not null")
    w = Window.partitionBy("session", "name", "file", F.coalesce("error", F.lit(""))).orderBy("seq")
    return e.withColumns({"earlier": F.lag("id").over(w), "at_seq": F.lag("seq").over(w)}).where("seq - at_seq <= 200").select("id", "earlier")


@query(f"""SELECT id, CASE WHEN seq - same <= 200 THEN 'repeat' WHEN name = 'view' AND later - seq <= 200 THEN 'superseded' WHEN name = 'error' THEN 'purge' ELSE 'keep' END AS strategy FROM (SELECT *, lag(seq) OVER (PARTITION BY session, name, file ORDER BY seq) AS same,
 min(CASE WHEN name = 'purchase' THEN seq END) OVER (PARTITION BY session, file ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM {_CALLS} WHERE file IS NOT NULL) x""")
def w16_strategies_with_history(spark, sf):
    """The first strategy that applies, looking no further than 200 calls of the session."""
    e = T.tool_events(spark, sf).withColumn("seq", F.row_number().over(Window.partitionBy("session").orderBy("ts_us", "id"))).where("file is not null")
    same = F.lag("seq").over(Window.partitionBy("session", "name", "file").orderBy("seq"))
    later = F.min(F.when(F.col("name") == "purchase", F.col("seq"))).over(Window.partitionBy("session", "file").orderBy("seq").rowsBetween(1, Window.unboundedFollowing))
    e = e.withColumns({"same": same, "later": later})
    strategy = F.when(F.col("seq") - F.col("same") <= 200, "repeat").when((F.col("name") == "view") & (F.col("later") - F.col("seq") <= 200), "superseded").when(F.col("name") == "error", "purge").otherwise("keep")
    return e.select("id", strategy.alias("strategy"))
