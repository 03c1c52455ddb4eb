"""Detectors of behaviour in tool events: repetition, friction, convergence, and the runner of all three."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import sequences as Q
from ..sources import tables as T
from .registry import query

IGNORED = ["view --on any"]
OS = "nullif(regexp_extract(props, '\"os\": \"([a-z]+)\"', 1), '')"
TOOL_EVENTS = f"""(SELECT click_id AS id, epoch_us(ts) AS ts_us, client_id AS session, kind AS name, nullif(regexp_extract(props, '"k": ([0-9]+)', 1), '') AS file, kind || ' --on ' || coalesce({OS}, 'any') AS command,
 CASE WHEN kind = 'error' THEN 'failed on ' || coalesce({OS}, 'any') END AS error FROM (SELECT DISTINCT click_id, ts, client_id, kind, props FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL)"""


def densest_sql(rows: str, least: int) -> str:
    """Session, signature, n, since and until of the densest half hour of rows (session, signature, ts_us)."""
    return f"""SELECT session, signature, n, since, ts_us AS until FROM (SELECT *, row_number() OVER (PARTITION BY session, signature ORDER BY n DESC, ts_us) AS r FROM (SELECT session, signature, ts_us, count(*) OVER w AS n, min(ts_us) OVER w AS since
 FROM ({rows}) WINDOW w AS (PARTITION BY session, signature ORDER BY ts_us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW))) WHERE r = 1 AND n >= {least}"""


REPETITION = densest_sql(f"SELECT session, command || ' | sort' AS signature, ts_us FROM {TOOL_EVENTS} WHERE command IS NOT NULL AND command <> 'view --on any'", 4)
FRICTION = densest_sql(f"SELECT session, error AS signature, ts_us FROM {TOOL_EVENTS} WHERE error IS NOT NULL", 2)
CONVERGENCE = f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_us, id) AS r FROM {TOOL_EVENTS}),
 a AS (SELECT a.session, a.file, a.id, a.ts_us, a.r, min(c.r) AS cr FROM e a JOIN e c ON c.session = a.session AND c.name = 'error' AND c.r BETWEEN a.r + 1 AND a.r + 6 WHERE a.name = 'purchase' GROUP BY ALL),
 b AS (SELECT a.*, min(b.r) AS br FROM a JOIN e b ON b.session = a.session AND b.name = 'purchase' AND (coalesce(a.file, '') = '' OR b.file = a.file) AND b.r BETWEEN a.cr + 1 AND a.cr + 6 GROUP BY ALL)
 SELECT b.session, b.file, b.id AS first, c.id AS correction, t.id AS "then", EXISTS (SELECT 1 FROM e p WHERE p.session = b.session AND p.name = 'signup' AND p.r BETWEEN b.br + 1 AND b.br + 6) AS positive, b.ts_us
 FROM b JOIN e c ON c.session = b.session AND c.r = b.cr JOIN e t ON t.session = b.session AND t.r = b.br WHERE t.ts_us - b.ts_us <= 1800000000"""


def commands(events):
    """Normalised commands; ignored ones are null."""
    signature = S.command_signature(F.col("command"))
    bare = F.regexp_replace(signature, r" \| sort$", "")
    return events.withColumn("signature", F.when(~S.ignored_command(bare, IGNORED), signature))


def converged(events):
    name = F.col("name")
    return Q.convergence(events, F.coalesce(name == "purchase", F.lit(False)), F.coalesce(name == "error", F.lit(False)), F.coalesce(name == "signup", F.lit(False)))


@query(REPETITION)
def w2_repetition(spark, sf):
    """The same command at least four times within 30 minutes; environment, path and redirections don't count."""
    return Q.repeated(commands(T.tool_events(spark, sf)), F.col("signature"), 4)


@query(FRICTION)
def w3_friction_signatures(spark, sf):
    """The same failure at least twice within 30 minutes."""
    return Q.repeated(T.tool_events(spark, sf), F.col("error"), 2)


@query(f"SELECT session, file, first, correction, \"then\", positive, ts_us FROM ({CONVERGENCE})")
def w4_sequence_match(spark, sf):
    """Purchases are mutations of a file, errors corrections and signups positive signals."""
    return converged(T.tool_events(spark, sf))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts_us, id) AS r FROM {TOOL_EVENTS}), n AS (SELECT a.id, a.session, min(b.r) FILTER (b.name = 'error') AS c, min(b.r) FILTER (b.name = 'purchase') AS m, min(b.r) FILTER (b.name = 'signup') AS p
 FROM e a LEFT JOIN e b ON b.session = a.session AND b.r BETWEEN a.r + 1 AND a.r + 6 WHERE a.name = 'purchase' GROUP BY ALL)
 SELECT n.id, n.session, c.id AS correction, m.id AS mutation, p.id AS positive FROM n LEFT JOIN e c ON c.session = n.session AND c.r = n.c LEFT JOIN e m ON m.session = n.session AND m.r = n.m LEFT JOIN e p ON p.session = n.session AND p.r = n.p""")
def w5_bounded_look_ahead(spark, sf):
    """What comes first of each kind within six rows of a mutation."""
    name = F.col("name")
    out = Q.look_ahead(T.tool_events(spark, sf), ["session"], ["ts_us", "id"], name == "purchase", 6, correction=name == "error", mutation=name == "purchase", positive=name == "signup")
    return out.select("id", "session", "correction", "mutation", "positive")


@query(f"""WITH f AS (SELECT session, 'repetition' AS shape, signature || ' ' || n || ' ' || CAST(round_even((until - since) / 60000000, 0) AS BIGINT) AS content, until AS at_us FROM ({REPETITION})
 UNION ALL SELECT session, 'friction', signature || ' ' || n || ' ' || CAST(round_even((until - since) / 60000000, 0) AS BIGINT), until FROM ({FRICTION})
 UNION ALL SELECT session, 'convergence', coalesce(file, '') || CASE WHEN positive THEN ' kept' ELSE ' changed' END, ts_us FROM ({CONVERGENCE})),
 g AS (SELECT session, shape, content, min(at_us) AS at_us FROM f GROUP BY ALL)
 SELECT session, shape, content, at_us AS at FROM (SELECT *, row_number() OVER (PARTITION BY session, shape ORDER BY at_us, content) AS rn FROM g) WHERE rn <= 3""".replace(" AS at FROM", ' AS "at" FROM'))
def f22_mining_runner(spark, sf):
    e = T.tool_events(spark, sf)
    return Q.proposals(Q.repeated(commands(e), F.col("signature"), 4), Q.repeated(e, F.col("error"), 2), converged(e))
