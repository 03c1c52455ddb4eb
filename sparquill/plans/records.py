"""Records of files and logs: usage, markers, includes, read checks, secrets, marked lines, languages, tests, searches."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import files as N
from ..operators import lookups as K
from ..sources import tables as T
from .detectors import TOOL_EVENTS
from .graphs import EDGES, moves
from .registry import query

DAY = 86_400_000_000


@query(f"""WITH n AS (SELECT max(epoch_us(ts)) AS now FROM clicks), c AS (SELECT epoch_us(ts) AS us, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, n.now FROM clicks, n WHERE contains(props, '"os"') AND json_valid(props) AND json_extract_string(props, '$.device.os') = 'ios')
 SELECT count(*) AS messages, CAST(coalesce(sum(k), 0) AS BIGINT) AS amount, count(*) FILTER (us > now - 18000000000) AS messages_window, CAST(coalesce(sum(k) FILTER (us > now - 18000000000), 0) AS BIGINT) AS amount_window FROM c WHERE us // {DAY} = now // {DAY}""")
def s14_usage_of_day(spark, sf):
    """Attributes of clicks are lines of a log, the system is the role; the day is that of the last click."""
    lines = T.table(spark, sf, "clicks").select(T.micros(F.col("ts")).alias("at_us"), F.col("props").alias("line"))
    now = lines.agg(F.max("at_us")).first()[0] or 0
    return K.usage_of_day(lines, '"os"', "k string, device struct<os:string>", F.col("m.device.os") == "ios", F.col("m.k").try_cast("bigint"), 5 * 3_600_000_000, now)


MARKERS = [
    {"check": "file", "file": "plate", "label": "plates", "max_depth": -1, "skip": ["toys"]},
    {"check": "file", "file": "lamp", "label": "lamps", "max_depth": 1},
    {"check": "directory", "file": "garden", "label": "gardens"},
    {"check": "sibling", "file": "bolt", "label": "bolts", "sibling_of": "plate"},
]


def item_paths(spark, sf):
    """root, path: items as files of their brand, in folders by kind and size, those of kind home at the top of theirs."""
    name = F.replace(F.col("name"), F.lit(" "), F.lit("/"))
    path = F.when(F.col("kind") == "home", F.concat(F.lit("home/"), F.element_at(F.split("name", " "), -1))).otherwise(F.concat("kind", F.lit("/"), name))
    return T.table(spark, sf, "items").where("brand is not null").select(F.col("brand").alias("root"), path.alias("path"))


@query("""WITH p AS (SELECT DISTINCT brand AS root, CASE WHEN kind = 'home' THEN 'home/' || string_split(name, ' ')[-1] ELSE kind || '/' || replace(name, ' ', '/') END AS path FROM items WHERE brand IS NOT NULL),
 f AS (SELECT root, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS base FROM p WHERE path IS NOT NULL), plates AS (SELECT root, folder FROM f WHERE base = 'plate' AND NOT list_contains(string_split(folder, '/'), 'toys'))
 SELECT DISTINCT root, folder, 'plates' AS label, 'plate' AS marker FROM plates UNION ALL SELECT DISTINCT root, folder, 'lamps', 'lamp' FROM f WHERE base = 'lamp' AND NOT contains(folder, '/')
 UNION ALL SELECT DISTINCT root, '', 'gardens', 'garden' FROM f WHERE split_part(folder, '/', 1) = 'garden' UNION ALL SELECT DISTINCT root, folder, 'bolts', 'bolt' FROM f WHERE base = 'bolt' AND (root, folder) IN (SELECT (root, folder) FROM plates)""")
def s21_markers_of_folders(spark, sf):
    """Files at any depth or near the root, folders at the root, and files beside others."""
    return K.project_markers(item_paths(spark, sf), MARKERS)


@query()
def s24_includes_in_order(spark, sf):
    """A city includes those further in the alphabet that its clients have moved to; all that the first one needs, in order."""
    e = moves(spark, sf).select("src", "dst").distinct().where(F.substring("dst", 1, 1) > F.substring("src", 1, 1))
    root = e.agg(F.min("src")).first()[0]
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dst")))
    return K.include_order(e.select(F.col("src").alias("name"), nth.alias("nth"), F.col("dst").alias("inc")), root)


SECRETS = [("password", "critical", r"(?:password|token|secret)=([0-9a-f]{8,})"), ("key", "critical", "(AKIA[A-Z0-9]{8,})"), ("mail", "info", r"([a-z]+\.[0-9]+@[a-z0-9]+\.example)")]
LINES = "(SELECT doc_id AS id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents) l"
RULES = ", ".join(f"('{n}', '{s}', '{p}')" for n, s, p in SECRETS)


@query(f"""SELECT id, line_no, rule, severity, left(s, 4) || repeat('*', len(s) - 4) AS masked FROM (SELECT id, line_no, rule, severity, regexp_extract(text, pattern, 1) AS s FROM {LINES}, (VALUES {RULES}) r(rule, severity, pattern)) x WHERE s <> ''""")
def f6_masked_secrets(spark, sf):
    hits = T.lines(spark, sf).select("id", F.col("line_no").cast("bigint").alias("line_no"), F.explode(N.secrets(F.col("text"), SECRETS)).alias("h"))
    return hits.select("id", "line_no", "h.*")


@query("""WITH d AS (SELECT client_id AS path, arg_max(valid_at, (valid_at, seq, change_id)) AS mtime, arg_max(balance, (valid_at, seq, change_id)) AS balance, arg_max(source, (valid_at, seq, change_id)) AS language FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL AND balance IS NOT NULL AND source IS NOT NULL GROUP BY client_id),
 s AS (SELECT client_id, count(*) AS n FROM sales GROUP BY client_id), i AS (SELECT c.client_id AS path, updated_at AS mtime, coalesce(n, 0) AS symbols, CASE WHEN balance >= 1000 THEN CAST(floor(balance) AS BIGINT) ELSE 0 END AS known FROM clients c LEFT JOIN s ON s.client_id = c.client_id)
 SELECT a.path, i.path IS NOT NULL AS indexed, coalesce(CAST(i.mtime AS DATE) = CAST(d.mtime AS DATE), false) AS fresh, coalesce(symbols, 0) AS symbols, coalesce(symbols, 0) > 0 AS outline,
 CASE WHEN i.path IS NULL THEN 0 WHEN known = 0 AND floor(abs(d.balance)) > 0 THEN CAST(floor(floor(abs(d.balance)) / CASE d.language WHEN 'store' THEN 3.5 WHEN 'partner' THEN 3.2 ELSE 3.0 END + 0.5) AS BIGINT) ELSE known END AS tokens
 FROM (SELECT DISTINCT client_id AS path FROM clicks WHERE client_id IS NOT NULL) a LEFT JOIN i ON i.path = a.path LEFT JOIN d ON d.path = a.path""")
def f20_read_checks(spark, sf):
    """Clients are files: their master rows the index, their last changes the files on disk, their sales the symbols."""
    of = T.table(spark, sf, "sales").groupBy("client_id").agg(F.count("*").alias("symbols"))
    known = F.when(F.col("balance") >= 1000, F.floor("balance")).otherwise(0)
    index = T.table(spark, sf, "clients").join(of, "client_id", "left").select(F.col("client_id").alias("path"), F.to_date("updated_at").alias("mtime"), F.coalesce("symbols", F.lit(0)).alias("symbols"), known.alias("tokens"))
    whole = T.table(spark, sf, "client_changes").where("client_id is not null and valid_at is not null and balance is not null and source is not null")
    last = whole.groupBy(F.col("client_id").alias("path")).agg(F.max_by(F.struct("valid_at", "balance", "source"), F.struct("valid_at", "seq", "change_id")).alias("l"))
    disk = last.select("path", F.to_date("l.valid_at").alias("mtime"), F.floor(F.abs("l.balance")).alias("size"), F.col("l.source").alias("language"))
    asked = T.table(spark, sf, "clicks").where("client_id is not null").select(F.col("client_id").alias("path"))
    return K.read_check(asked, index, disk, {"store": 3.5, "partner": 3.2})


TRIGGERS = ["late", "blue bold", "smal lamp"]


@query("""WITH w AS (SELECT item_id AS id, string_split_regex(lower(name), '\\s+') AS w FROM items WHERE name IS NOT NULL)
 SELECT id, t.trigger FROM w, (VALUES ('late', 1, 1), ('blue bold', 2, 2), ('smal lamp', 2, 2)) t(trigger, n, allowed) WHERE len(list_filter(range(1, len(w) - n + 2), lambda i: levenshtein(array_to_string(w[i:i + n - 1], ' '), trigger) <= allowed)) > 0""")
def fs9_triggers_by_length(spark, sf):
    """Windows of as many words as the trigger has, within a distance by its length."""
    i = T.table(spark, sf, "items").where("name is not null").select(F.col("item_id").alias("id"), F.lower("name").alias("n"))
    near = F.filter(F.array(*[F.when(N.fuzzy_trigger(F.col("n"), t), F.lit(t)) for t in TRIGGERS]), lambda t: t.isNotNull())
    return i.select("id", F.explode(near).alias("trigger"))


@query("""SELECT item_id AS id, CASE WHEN size < 20 AND brand IS NOT NULL AND regexp_matches(name, ' plate$') THEN 'go' WHEN size < 20 AND brand IS NOT NULL AND regexp_matches(name, ' bolt$') THEN 'rust' WHEN size >= 20 AND brand IS NOT NULL AND name = 'blue bolt' THEN 'make' WHEN kind = 'tools' THEN 'bash' WHEN kind = 'toys' THEN 'python' ELSE '' END AS language FROM items""")
def fs14_languages(spark, sf):
    """Small items are files whose extension is the last word of their name; the first line names the kind."""
    name = F.when(F.col("size") < 20, F.replace(F.col("name"), F.lit(" "), F.lit("."))).otherwise(F.col("name"))
    language = N.language_of(F.concat("brand", F.lit("/"), name), F.concat(F.lit("#!/usr/bin/env -S "), "kind", F.lit(" -u\n")), {"plate": "go", "bolt": "rust"}, {"blue bolt": "make"}, {"tools": "bash", "toys": "python"})
    return T.table(spark, sf, "items").select(F.col("item_id").alias("id"), language.alias("language"))


@query("""SELECT item_id AS id, CASE kind WHEN 'tools' THEN brand || '/' || name || '.go' WHEN 'toys' THEN brand || '/' || name || '.tsx' WHEN 'home' THEN brand || '/' || name || '.py' END AS subject FROM items""")
def fs15_subjects(spark, sf):
    at = lambda *parts: F.concat("brand", F.lit("/"), *parts)
    kind = F.col("kind")
    path = F.when(kind == "tools", at("name", F.lit("_test.go"))).when(kind == "toys", at("name", F.lit(".spec.tsx"))).when(kind == "home", at(F.lit("test_"), "name", F.lit(".py"))).otherwise(at("name", F.lit(".go")))
    return T.table(spark, sf, "items").select(F.col("item_id").alias("id"), N.subject_of_test(path).alias("subject"))


MARKED = r"\b(And|To|The)\b(?:\(([^)]*)\))?\s*:?\s*(.*)$"


@query(f"""SELECT id, line_no, keyword, nullif(trim(regexp_extract(text, '{MARKED}', 2)), '') AS owner, said, CASE keyword WHEN 'And' THEN 'info' WHEN 'To' THEN 'warning' ELSE 'critical' END AS severity, nullif(regexp_extract(said, '\\b([A-Z][A-Z0-9]+-[0-9]+)\\b', 1), '') AS ticket
 FROM (SELECT id, line_no, text, regexp_extract(text, '{MARKED}', 1) AS keyword, trim(regexp_extract(text, '{MARKED}', 3)) AS said FROM {LINES}) x WHERE keyword <> ''""")
def fs16_owner_and_ticket(spark, sf):
    m = T.lines(spark, sf).select("id", F.col("line_no").cast("bigint").alias("line_no"), N.marked(F.col("text"), {"And": "info", "To": "warning", "The": "critical"}).alias("m"))
    return m.where("m is not null").select("id", "line_no", "m.*")


@query("""SELECT doc_id AS id, CASE WHEN concat_ws('/', lang, source) = '' THEN 'an unknown file' WHEN lang IS NOT NULL AND source IS NOT NULL AND source <> '' THEN '.../' || source ELSE concat_ws('/', lang, source) END AS path, CASE WHEN length(trim(text)) <= 80 THEN trim(text) ELSE left(trim(text), 80) || '…' END AS said FROM documents""")
def fs18_display(spark, sf):
    return T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), N.shown_path(F.concat_ws("/", "lang", "source")).alias("path"), N.shortened(F.col("text"), 80).alias("said"))


@query(f"SELECT name, arg_max(file, (ts_us, -id)) FILTER (coalesce(file, '') <> '') AS file FROM {TOOL_EVENTS} GROUP BY name")
def a22_stamp_of_run(spark, sf):
    """Of each tool the file of its latest call that has one."""
    return K.latest_stamp(T.tool_events(spark, sf), "name", "file", "ts_us", "id")


@query("""WITH h AS (SELECT source AS instance, 'memory' AS type, doc_id AS id, '[' || lang || ']' AS title, text AS detail, 10 AS most FROM documents UNION ALL SELECT source, 'decision', client_id, segment, name, NULL FROM clients
 UNION ALL SELECT brand, 'survey', item_id, kind, name, 5 FROM items), r AS (SELECT *, row_number() OVER (PARTITION BY type, instance ORDER BY id) AS rn FROM h WHERE contains(lower(coalesce(title, '')), 'or') OR contains(lower(coalesce(detail, '')), 'or'))
 SELECT instance, type, id, CASE WHEN length(trim(title)) <= 80 THEN trim(title) ELSE left(trim(title), 80) || '…' END AS title, CASE WHEN length(trim(detail)) <= 80 THEN trim(detail) ELSE left(trim(detail), 80) || '…' END AS detail FROM r WHERE most IS NULL OR rn <= most""")
def u1_search_of_instances(spark, sf):
    """Documents of a source, clients of a source and items of a brand; what is capped for each instance is the first by id."""
    of = lambda t, instance, key, title, detail: T.table(spark, sf, t).select(F.col(instance).alias("instance"), F.col(key).alias("id"), title.alias("title"), F.col(detail).alias("detail"))
    documents = of("documents", "source", "doc_id", F.concat(F.lit("["), "lang", F.lit("]")), "text")
    return K.cross_search([("memory", documents, 10), ("decision", of("clients", "source", "client_id", F.col("segment"), "name"), None), ("survey", of("items", "brand", "item_id", F.col("kind"), "name"), 5)], "OR")


@query("""WITH s AS (SELECT doc_id AS id, lang AS kind, source AS path, coalesce(lower(split_part(text, ' ', 1)), '') AS name, string_split_regex(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+') AS sig, string_split_regex(lower(text), '[^a-z0-9]+') AS doc FROM documents),
 h AS (SELECT id, kind, path, CAST(starts_with(name, 'the') AS INT) AS a, CAST(contains(name, 'the') AS INT) AS b, CAST(coalesce(list_contains(sig, 'the'), false) AS INT) AS c, CAST(coalesce(list_contains(doc, 'the'), false) AS INT) AS d FROM s), n AS (SELECT count(*) AS n, sum(a) AS na, sum(b) AS nb, sum(c) AS nc, sum(d) AS nd FROM h),
 t AS (SELECT id, kind, path, CAST(CASE WHEN a = 1 THEN floor(ln(1 + n / na) * 1000000 + 0.5) ELSE 0 END + CASE WHEN b = 1 THEN floor(ln(1 + n / nb) * 1000000 + 0.5) ELSE 0 END + CASE WHEN c = 1 THEN floor(ln(1 + n / nc) * 1000000 + 0.5) ELSE 0 END + CASE WHEN d = 1 THEN floor(ln(1 + n / nd) * 1000000 + 0.5) ELSE 0 END AS BIGINT) AS score FROM h, n WHERE a + b + c + d > 0 ORDER BY score DESC, id LIMIT 40)
 SELECT id, score FROM t WHERE kind = 'en' AND contains(path, '1')""")
def x7_symbols_by_four_legs(spark, sf):
    """Documents as symbols: the first word is the name, the first line the signature; twenty asked for, forty fetched, then filtered."""
    d = T.table(spark, sf, "documents")
    s = d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("signature"), F.col("text").alias("doc"), F.col("lang").alias("kind"), F.col("source").alias("path"))
    return K.symbol_search(s, "the", 20, "en", "1")
