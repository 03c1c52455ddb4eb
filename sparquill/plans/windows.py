"""Windows over event order: density, sequences, islands, budgets, ranks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import EVENTS
from .registry import query

DAY = 86_400_000_000


@query(f"""SELECT session, name, n, -e AS window_end FROM (SELECT session, name, max((n, -ts_us)) AS b, b[1] AS n, b[2] AS e FROM
 (SELECT session, name, ts_us, count(*) OVER (PARTITION BY session, name ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS n FROM {EVENTS}) c GROUP BY session, name) t WHERE n >= 2""")
def w1_densest_window(spark, sf):
    return R.densest_window(T.events(spark, sf), ["session", "name"], "ts_us", DAY, 2)


@query(f"""SELECT session, max(n) AS n FROM (SELECT session, count(*) OVER (PARTITION BY session ORDER BY ts_us RANGE BETWEEN {7 * DAY} PRECEDING AND CURRENT ROW) AS n FROM {EVENTS} WHERE name = 'error') t GROUP BY session HAVING max(n) >= 2""")
def w3_friction(spark, sf):
    return R.densest_window(T.events(spark, sf).where("name = 'error'"), ["session"], "ts_us", 7 * DAY, 2).select("session", "n")


@query()
def w6_window_hashes(spark, sf):
    m = T.memories(spark, sf).select("id", S.tokens(F.col("content")).alias("t"))
    return R.window_hashes(m, ["id"], "t", 50)


@query(f"""WITH s AS (SELECT session, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY session ORDER BY ts_us) <= {DAY} THEN 0 ELSE 1 END AS new FROM {EVENTS}),
 i AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT session, min(ts_us) AS first, max(ts_us) AS last, count(*) AS n FROM i GROUP BY session, k""")
def w7_islands(spark, sf):
    return R.islands(T.events(spark, sf), ["session"], "ts_us", DAY)


SYMBOLS = "(SELECT l_partkey AS file, l_orderkey * 10 + l_linenumber AS symbol, CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS \"start\", CAST(l_shipdate AS DATE) - DATE '1992-01-01' + CAST(l_quantity AS INT) AS \"end\" FROM lineitem) s"


@query(f"""WITH m AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY file ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM {SYMBOLS}),
 i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT file, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY file, k""")
def w8_interval_merge(spark, sf):
    return R.merge_intervals(T.symbols(spark, sf), ["file"], "start", "end")


@query(f"""WITH s AS (SELECT *, lag("start") OVER w AS pa, lag("end") OVER w AS pb FROM {SYMBOLS} WINDOW w AS (PARTITION BY file ORDER BY "start", "end")), m AS (SELECT *, CASE WHEN "start" - pa <= 64 AND "end" - pb BETWEEN 0 AND 64 THEN 0 ELSE 1 END AS new FROM s),
 i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT file, min("start") AS start_from, max("start") AS start_to, min("end") AS end_from, max("end") AS end_to, count(*) AS n FROM i GROUP BY file, k""")
def w7_regions(spark, sf):
    return R.regions(T.symbols(spark, sf), ["file"], "start", "end", 64)


@query("""SELECT category, id FROM (SELECT lang AS category, doc_id AS id, n_chars, sum(n_chars) OVER w AS spent, row_number() OVER w AS rn FROM documents WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)) t WHERE rn = 1 OR spent <= 20000""")
def w10_running_budget(spark, sf):
    return R.within_budget(T.memories(spark, sf), ["category"], ["size", "id"], "size", 20000).select("category", "id")


@query("""SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS rn FROM (SELECT min(doc_id) AS id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)) d) t WHERE rn <= 3""")
def w11_capped_after_dedup(spark, sf):
    d = T.memories(spark, sf).groupBy(F.md5(F.col("content").cast("binary")).alias("h")).agg(F.min(F.struct("id", "source")).alias("m")).select("m.*")
    w = Window.partitionBy("source").orderBy("id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("source", "id")


@query("""SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree, node) AS rn, count(*) OVER () AS n FROM (SELECT l_suppkey AS node, count(*) AS degree FROM lineitem GROUP BY 1) d) t WHERE rn = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)""")
def w12_nearest_rank(spark, sf):
    d = T.edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("degree"))
    # a histogram of degrees is short; ranks come from its running sum, not from a sort of the nodes on one task
    h = d.groupBy("degree").agg(F.count("*").alias("c"))
    run = h.withColumn("upto", F.sum("c").over(Window.orderBy("degree"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.where(F.col("upto") >= F.least("n", F.floor(F.col("n") * 0.95) + 1)).agg(F.min("degree").alias("degree"))


@query("""SELECT id, earlier FROM (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY source, md5(text) ORDER BY doc_id) AS earlier FROM documents) t WHERE earlier IS NOT NULL AND id - earlier <= 5000""")
def w14_repeat_output(spark, sf):
    w = Window.partitionBy("source", "h").orderBy("id")
    m = T.memories(spark, sf).withColumn("h", F.md5(F.col("content").cast("binary")))
    return m.select("id", F.lag("id").over(w).alias("earlier")).where("earlier is not null and id - earlier <= 5000")


@query(f"""SELECT id, earlier_reads FROM (SELECT id, name, count(*) FILTER (name = 'view') OVER (PARTITION BY session, k ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier_reads FROM {EVENTS}) t WHERE name = 'purchase'""")
def w15_superseded_reads(spark, sf):
    w = Window.partitionBy("session", "k").orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    return T.events(spark, sf).withColumn("earlier_reads", F.count(F.when(F.col("name") == "view", 1)).over(w)).where("name = 'purchase'").select("id", "earlier_reads")


@query(f"""SELECT id, ts_us FROM (SELECT e.id, e.ts_us FROM {EVENTS} JOIN (SELECT user_id AS s, epoch_us(ts) AS t FROM events WHERE event_id = 77) a ON e.session = s AND e.ts_us >= t WHERE e.id = 77 OR e.kind IN ('read', 'outline', 'symbol') ORDER BY e.ts_us, e.id LIMIT 11) x WHERE id <> 77""")
def w17_calls_after_anchor(spark, sf):
    """Eleven rows from the anchor on, itself among them, and then without it."""
    e = T.events(spark, sf)
    anchor = e.where("id = 77").select(F.col("session").alias("s"), F.col("ts_us").alias("t"))
    # the row of one id
    after = e.join(F.broadcast(anchor), (F.col("session") == F.col("s")) & (F.col("ts_us") >= F.col("t"))).where((F.col("id") == 77) | F.col("kind").isin("read", "outline", "symbol"))
    return R.top_k(after.select("id", "ts_us"), 11, "ts_us", "id").where("id <> 77")
