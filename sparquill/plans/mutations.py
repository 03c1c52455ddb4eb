"""Mutations that go through a store's log: each commits its change and reads the state back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import tables as T
from ..sources.store import Store
from .filters import DECISIONS, EVENTS, FINDINGS, MEMORIES
from .registry import query
from .stores import TASKS


@query(f"SELECT id, 'kept' AS state FROM {MEMORIES} WHERE category <> 'fr' UNION ALL SELECT id, 'tombstone' FROM {MEMORIES} WHERE category = 'fr'")
def k3_delete_with_tombstone(spark, sf):
    store = Store(T.memories(spark, sf).select("id", "category"), ["id"], "memory")
    store.delete(F.col("category") == "fr", tombstone=True)
    return store.current().select("id", F.lit("kept").alias("state")).unionByName(store.tombstones().select("id", F.lit("tombstone").alias("state")))


@query(f"SELECT id, CASE WHEN session = 5 THEN tokens + 2 ELSE tokens END AS tokens FROM {EVENTS}")
def k4_touch(spark, sf):
    """Two touches add two, whoever has seen which state."""
    store = Store(T.events(spark, sf).select("id", "session", "tokens"), ["id"])
    for _ in range(2):
        store.update(F.col("session") == 5, tokens=F.col("tokens") + 1)
    return store.current().select("id", "tokens")


@query(f"SELECT session AS key, arg_max(tokens, (ts_us, id)) AS value FROM {EVENTS} GROUP BY session")
def k5_upsert_latest(spark, sf):
    """Writes come in two parts of time; the later value of a key is what stays."""
    e = T.events(spark, sf)
    of = lambda part: part.groupBy(F.col("session").alias("key")).agg(F.max_by("tokens", F.struct("ts_us", "id")).alias("value"))
    store = Store(of(e.where("ts < timestamp_ntz'2024-01-10 00:00:00'")), ["key"])
    store.put(of(e.where("ts >= timestamp_ntz'2024-01-10 00:00:00'")))
    return store.current()


@query(f"""SELECT topic, seq, CASE WHEN created < DATE '1996-01-01' THEN precedence ELSE coalesce(CASE WHEN value IN ('1-URGENT', '2-HIGH') THEN precedence END,
 last_value(CASE WHEN created < DATE '1996-01-01' OR value IN ('1-URGENT', '2-HIGH') THEN precedence END IGNORE NULLS) OVER (PARTITION BY topic ORDER BY created, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS precedence FROM {DECISIONS}""")
def k7_precedence_carried(spark, sf):
    """New versions that name no precedence (only urgent and high ones do) carry on that of the version before them."""
    d = T.decisions(spark, sf)
    store = Store(d.where("created < date'1996-01-01'").select("topic", "seq", "precedence"), ["topic", "seq"], "decision")
    said = F.when((F.col("created") < "1996-01-01") | F.col("value").isin("1-URGENT", "2-HIGH"), F.col("precedence"))
    w = Window.partitionBy("topic").orderBy("created", "seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = d.select("topic", "seq", "created", F.coalesce(said, F.last(said, ignorenulls=True).over(w), F.lit(0)).alias("precedence"))
    store.insert(carried.where("created >= date'1996-01-01'").select("topic", "seq", "precedence"))
    return store.current()


@query(f"""SELECT t.id AS task, CASE WHEN t.status = 'pending' THEN coalesce(c.agent, CAST(NULL AS BIGINT)) ELSE t.owner END AS owner, CASE WHEN t.status = 'pending' AND c.agent IS NOT NULL THEN 'claimed' ELSE t.status END AS status
 FROM {TASKS} LEFT JOIN (SELECT k + 1 AS task, arg_min(session, (ts_us, id)) AS agent FROM {EVENTS} WHERE name IN ('click', 'view') AND k IS NOT NULL GROUP BY k) c ON c.task = t.id""")
def k8_first_claim(spark, sf):
    """Agents ask for tasks; the first who asks for a pending one gets it, and asking again changes nothing."""
    store = Store(T.tasks(spark, sf).select("id", "status", "owner"), ["id"], "task")
    e = T.events(spark, sf).where("k is not null").select((F.col("k") + 1).cast("bigint").alias("id"), F.col("session").alias("agent"), F.col("ts_us").alias("asked"), F.col("id").alias("nth"), "name")
    first, again = e.where("name in ('click', 'view')").drop("name"), e.where("name = 'purchase'").drop("name")
    values = {"status": F.lit("claimed"), "owner": F.col("agent")}
    store.claim(first, F.col("status") == "pending", ["asked", "nth"], **values)
    # tasks that only later agents ask for are for a later commit, so these come from those already taken
    store.claim(again.join(first.select("id").distinct(), "id", "left_semi"), F.col("status") == "pending", ["asked", "nth"], **values)
    return store.current().select(F.col("id").alias("task"), "owner", "status")


@query(f"SELECT id, list_sort(list_distinct(list_append(tags, 'reader'))) AS read_by FROM {MEMORIES}")
def k10_acknowledge(spark, sf):
    """Acknowledged once for each reader: the second time finds nothing to do."""
    store = Store(T.memories(spark, sf).select("id", F.col("tags").alias("read_by")), ["id"], "message")
    for _ in range(2):
        store.update(~F.array_contains("read_by", "reader"), read_by=F.array_union("read_by", F.array(F.lit("reader"))))
    return store.current().select("id", F.sort_array("read_by").alias("read_by"))


@query(f"SELECT id, analyzer, severity FROM {FINDINGS} WHERE analyzer <> 'src3' UNION ALL SELECT id + 1000000, 'src3', 'info' FROM {FINDINGS} WHERE analyzer = 'src3' AND severity = 'warning'")
def k11_replace_analyzer(spark, sf):
    f = T.findings(spark, sf).select("id", "analyzer", "severity")
    store = Store(f, ["id"])
    new = f.where("analyzer = 'src3' and severity = 'warning'").select((F.col("id") + 1_000_000).alias("id"), "analyzer", F.lit("info").alias("severity"))
    store.replace(F.col("analyzer") == "src3", new)
    return store.current()


@query(f"SELECT id, accepted OR severity = 'warning' AS accepted, severity = 'warning' AND NOT accepted AS changed FROM {FINDINGS}")
def k15_accept_by_filter(spark, sf):
    store = Store(T.findings(spark, sf).select("id", "severity", "accepted"), ["id"])
    for _ in range(2):
        store.update((F.col("severity") == "warning") & ~F.col("accepted"), accepted=F.lit(True))
    changed = store.log().select("id", F.lit(True).alias("changed")).distinct()
    return store.current().join(changed, "id", "left").select("id", "accepted", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("SELECT doc_id AS id, list_sort(list_distinct(list_filter(list_append([source, 'lang:' || lang], 'seen'), lambda x: x <> 'lang:en'))) AS tags FROM documents")
def k16_tag_update(spark, sf):
    m = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array("source", F.concat(F.lit("lang:"), "lang")).alias("tags"))
    store = Store(m, ["id"], "memory")
    store.update(F.lit(True), tags=F.array_except(F.array_union("tags", F.array(F.lit("seen"))), F.array(F.lit("lang:en"))))
    return store.current().select("id", F.sort_array("tags").alias("tags"))


@query(f"SELECT row_number() OVER (ORDER BY ts_us, id) AS seq, session AS sender, coalesce(CASE WHEN k > 50 THEN ts_us + k END, ts_us + 3600000000) AS expires FROM {EVENTS}")
def k25_message_ttl(spark, sf):
    """Messages get the next numbers in the order of their time; one without an end expires after an hour."""
    e = T.events(spark, sf)
    fresh = e.select("id", F.col("session").alias("sender"), "ts_us", F.when(F.col("k") > 50, F.col("ts_us") + F.col("k")).alias("expires"))
    early = fresh.where("ts_us < 1704700000000000")
    store = Store(spark.createDataFrame([], "seq bigint, sender bigint, expires bigint"), ["seq"], "message")
    last = 0
    for part in (early, fresh.where("ts_us >= 1704700000000000")):
        numbered = R.ranked(part, "ts_us", "id").select((F.col("rank") + 1 + last).alias("seq"), "sender", F.coalesce("expires", F.col("ts_us") + 3_600_000_000).alias("expires"))
        store.insert(numbered)
        last = store.current().agg(F.max("seq")).first()[0] or 0
    return store.current()


@query(f"""SELECT 'status' AS cleared, count(*) AS n FROM {TASKS} WHERE status = 'done' UNION ALL SELECT 'agent', count(*) FROM {TASKS} WHERE status <> 'done' AND owner < 50
 UNION ALL SELECT 'all', count(*) FROM {TASKS} WHERE status <> 'done' AND (owner IS NULL OR owner >= 50) UNION ALL SELECT 'left', 0""")
def r7_clear_in_steps(spark, sf):
    """By status, by agent, and then all that is left."""
    store = Store(T.tasks(spark, sf).select("id", "status", "owner"), ["id"], "task")
    counts = [("status", store.delete(F.col("status") == "done")), ("agent", store.delete(F.col("owner") < 50)), ("all", store.clear())]
    return spark.createDataFrame([*counts, ("left", store.current().count())], "cleared string, n bigint")


@query(f"""WITH c AS (SELECT CAST(max(created) - INTERVAL 900 DAY AS DATE) AS cut FROM {DECISIONS}), h AS (SELECT max(created) AS horizon FROM {DECISIONS}, c WHERE created < cut)
 SELECT topic, max(created) AS deleted, any_value(horizon) AS horizon FROM {DECISIONS}, c, h WHERE created >= cut GROUP BY topic""")
def r8_tombstone_horizon(spark, sf):
    """Of each topic the newest tombstone within 900 days, and the newest time among those that were dropped."""
    d = T.decisions(spark, sf).select("topic", F.col("created").alias("deleted"))
    cut = d.agg(F.date_sub(F.max("deleted"), 900).alias("cut"))
    aged = d.join(F.broadcast(cut))  # one row
    horizon = aged.where("deleted < cut").agg(F.max("deleted").alias("horizon"))
    return aged.where("deleted >= cut").groupBy("topic").agg(F.max("deleted").alias("deleted")).join(F.broadcast(horizon))


# both sides of these come from columns of the data


@query("SELECT p_partkey AS symbol FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linestatus = 'F' AND l_discount > 0.08)")
def j6_unreferenced(spark, sf):
    """References are the returned lines with a high discount; all parts are looked at."""
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("symbol"))
    references = T.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F' and l_discount > 0.08").select(F.col("l_partkey").alias("symbol"))
    return p.join(references, "symbol", "left_anti")


@query("""SELECT l.doc_id AS id, CASE WHEN d.doc_id IS NULL OR d.text IS NULL THEN 'corrupt' WHEN s.doc_id IS NOT NULL THEN 'in-file' ELSE 'path' END AS orphan
 FROM (SELECT DISTINCT client_id AS doc_id FROM clients) l LEFT JOIN (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id) d USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) s USING (doc_id)""")
def j13_orphan_classes(spark, sf):
    """Entries that name no stored text are corrupt; of the others those that a labelled document lists are in-file."""
    entries = T.table(spark, sf, "clients").select(F.col("client_id").alias("id")).distinct()
    d = T.memories(spark, sf).groupBy("id").agg(F.first("content", ignorenulls=True).alias("content"))
    listed = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("listed")).distinct()
    kind = F.when(F.col("content").isNull(), "corrupt").when(F.col("listed"), "in-file").otherwise("path")
    return entries.join(d, "id", "left").join(listed, "id", "left").select("id", kind.alias("orphan"))


@query("""WITH o AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate < TIMESTAMP '1993-06-01'), n AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-06-01')
 SELECT id, 'removed' AS side FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, 'added' FROM n WHERE id NOT IN (SELECT id FROM o)""")
def j17_entry_diff(spark, sf):
    """Parts shipped in the first period and in the last one as old and new entries."""
    li = T.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), "l_shipdate")
    old, new = li.where("l_shipdate < '1993-06-01'").select("id").distinct(), li.where("l_shipdate >= '1997-06-01'").select("id").distinct()
    return old.join(new, "id", "left_anti").withColumn("side", F.lit("removed")).unionByName(new.join(old, "id", "left_anti").withColumn("side", F.lit("added")))


CHANGES = "(SELECT client_id AS id, seq, op, source, segment, city, valid_at, change_id FROM client_changes) g"


@query(f"""WITH l AS (SELECT id, arg_max((valid_at, seq, city, list_filter([segment, CASE WHEN op = 'D' THEN 'forget' END], lambda x: x IS NOT NULL)), (coalesce(valid_at, TIMESTAMP '1900-01-01'), seq, change_id)) AS r FROM {CHANGES} WHERE id IS NOT NULL AND source = 'web' GROUP BY id),
 i AS (SELECT id, arg_max((valid_at, seq, city, list_filter([segment, CASE WHEN op = 'D' THEN 'forget' END], lambda x: x IS NOT NULL)), (coalesce(valid_at, TIMESTAMP '1900-01-01'), seq, change_id)) AS r FROM {CHANGES} WHERE id IS NOT NULL AND (source IS NULL OR source <> 'web') GROUP BY id),
 m AS (SELECT coalesce(l.id, i.id) AS id, l.r AS a, i.r AS b, l.id IS NULL OR coalesce(b[1] > a[1], false) AS newer FROM l FULL OUTER JOIN i ON l.id = i.id)
 SELECT id, epoch_us(CASE WHEN newer THEN b[1] ELSE a[1] END) AS version, CASE WHEN newer THEN b[3] ELSE a[3] END AS city, list_sort(list_distinct(list_concat(coalesce(CASE WHEN newer THEN b[4] ELSE a[4] END, []), CASE WHEN list_contains(a[4], 'forget') OR list_contains(b[4], 'forget') THEN ['forget'] ELSE [] END))) AS tags FROM m""")
def u4_last_write_wins(spark, sf):
    """Web's rows of a client are the local ones, all others come in; the newer wins, and what either side has forgotten stays so."""
    c = T.table(spark, sf, "client_changes").where("client_id is not null")
    tags = F.filter(F.array("segment", F.when(F.col("op") == "D", "forget")), lambda t: t.isNotNull())
    rows = c.select(F.col("client_id").alias("id"), "source", "seq", "change_id", T.micros(F.col("valid_at")).alias("version"), "city", tags.alias("tags"))
    newest = F.struct(F.coalesce("version", F.lit(-(1 << 60))), "seq", "change_id")
    side = lambda where: rows.where(where).groupBy("id").agg(F.max_by(F.struct("version", "city", "tags"), newest).alias("r")).select("id", "r.*")
    out = R.last_write_wins(side("source = 'web'"), side("source is null or source <> 'web'"), "id", "version", ["city", "tags"], sticky=("tags", "forget"))
    return out.select("id", "version", "city", F.sort_array(F.array_distinct("tags")).alias("tags"))


@query("""SELECT DISTINCT client_id AS topic, epoch_us(valid_at) AS version FROM client_changes WHERE source IN ('web', 'store') AND valid_at IS NOT NULL""")
def u5_version_union(spark, sf):
    """Versions that two sources hold, each topic and time once."""
    c = T.table(spark, sf, "client_changes").where("valid_at is not null").select(F.col("client_id").alias("topic"), T.micros(F.col("valid_at")).alias("version"), "source")
    web, store = c.where("source = 'web'").drop("source"), c.where("source = 'store'").drop("source")
    return web.unionByName(store).distinct()
