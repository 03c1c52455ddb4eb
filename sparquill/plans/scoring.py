"""Scalar functions of text, score and structure, each over a whole entity."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import EVENTS, MEMORIES
from .registry import query
from .stores import SURVEY


@query(f"SELECT id, name = 'click' OR starts_with(name || ' ' || k, 'view ') AS ignored FROM {EVENTS}")
def fs2_ignored_commands(spark, sf):
    command = F.when(F.col("name") == "view", F.concat("name", F.lit(" "), F.col("k").cast("string"))).otherwise(F.col("name"))
    return T.events(spark, sf).select("id", S.ignored_command(command, ["click", "view"]).alias("ignored"))


@query(f"SELECT id, coalesce(nullif(CASE WHEN k >= 50 THEN 'cmd ' || k ELSE '' END, ''), name) AS command FROM {EVENTS}")
def fs3_command_or_name(spark, sf):
    given = F.when(F.col("k") >= 50, F.concat(F.lit("cmd "), F.col("k").cast("string"))).otherwise("")
    return T.events(spark, sf).select("id", F.coalesce(F.nullif(given, F.lit("")), "name").alias("command"))


@query("SELECT conv_id AS session, turn AS seq, list_has_any(regexp_extract_all(lower(text), '[a-z0-9'']+'), ['no', 'la', 'the', 'ship it']) AS marked FROM conversations")
def fs6_any_marker(spark, sf):
    """Markers are compared with single words, so one of two words never matches."""
    t = T.turns(spark, sf)
    return t.select("session", "seq", S.any_tag(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+"), F.lit(0)), ["no", "la", "the", "ship it"]).alias("marked"))


@query(f"SELECT name, min(least(levenshtein(split_part(name, ' ', 1), 'reed'), levenshtein(split_part(name, ' ', 2), 'reed'))) AS distance FROM {SURVEY} GROUP BY name HAVING min(least(levenshtein(split_part(name, ' ', 1), 'reed'), levenshtein(split_part(name, ' ', 2), 'reed'))) <= 1")
def fs9_fuzzy_trigger(spark, sf):
    """A trigger of up to five letters may differ from a word in one place."""
    w = lambda k: F.levenshtein(F.split_part("name", F.lit(" "), F.lit(k)), F.lit("reed"))
    return T.survey(spark, sf).groupBy("name").agg(F.min(F.least(w(1), w(2))).alias("distance")).where("distance <= 1")


@query(f"SELECT name, CASE WHEN contains(name, 'red') THEN 6 ELSE 0 END + CASE WHEN contains(name, 'widget') THEN 12 WHEN levenshtein(split_part(name, ' ', 2), 'widget') <= 2 THEN 6 ELSE 0 END AS score FROM (SELECT DISTINCT name FROM {SURVEY}) x")
def fs10_skill_score(spark, sf):
    """Twice its length for a trigger found as it is, its length for one found nearly."""
    n = F.col("name")
    near = F.levenshtein(F.split_part(n, F.lit(" "), F.lit(2)), F.lit("widget")) <= 2
    score = F.when(F.contains(n, F.lit("red")), 6).otherwise(0) + F.when(F.contains(n, F.lit("widget")), 12).when(near, 6).otherwise(0)
    return T.survey(spark, sf).select(n).distinct().select(n, score.alias("score"))


@query("SELECT DISTINCT url, regexp_replace(regexp_replace(url, '[?].*$', ''), '/([0-9]+)$', '/subject') AS subject FROM pages")
def fs15_subject_of_test(spark, sf):
    u = F.col("url")
    return T.table(spark, sf, "pages").select(u, F.regexp_replace(F.regexp_replace(u, "[?].*$", ""), "/([0-9]+)$", "/subject").alias("subject")).distinct()


@query("SELECT id, keyword, CASE lower(keyword) WHEN 'license' THEN 'warning' ELSE 'info' END AS severity, said FROM (SELECT doc_id AS id, regexp_extract(line, '(?i)(license|copyright)', 1) AS keyword, trim(regexp_extract(line, '(?i)(?:license|copyright)[: ]*(.*)$', 1)) AS said FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l) x WHERE keyword <> ''")
def fs16_marked_comments(spark, sf):
    keyword = F.regexp_extract("text", "(?i)(license|copyright)", 1)
    said = F.trim(F.regexp_extract("text", "(?i)(?:license|copyright)[: ]*(.*)$", 1))
    found = T.lines(spark, sf).select("id", keyword.alias("keyword"), said.alias("said")).where("keyword <> ''")
    return found.select("id", "keyword", F.when(F.lower("keyword") == "license", "warning").otherwise("info").alias("severity"), "said")


@query(f"SELECT DISTINCT file, split_part(file, '/', 1) AS area, split_part(file, '/', 2) AS agent, 'on' = 'on' AND contains(file, 'PROMO') AS active FROM {SURVEY}")
def fs19_key_parts(spark, sf):
    parts = F.split("file", "/", 3)
    return T.survey(spark, sf).select("file", F.element_at(parts, 1).alias("area"), F.element_at(parts, 2).alias("agent"), (F.lit("on").isin("1", "true", "yes", "on") & F.contains("file", F.lit("PROMO"))).alias("active")).distinct()


@query(f"SELECT id FROM {EVENTS} WHERE ts_us >= (SELECT max(ts_us) FROM {EVENTS}) - 129600000000")
def fd1_since_duration(spark, sf):
    e = T.events(spark, sf)
    since = e.agg((F.max("ts_us") - S.duration_us("1d12h")).alias("since"))
    return e.join(F.broadcast(since), F.col("ts_us") >= F.col("since")).select("id")


@query(f"""SELECT id, round(CASE WHEN list_contains(tags, 'forget') THEN 1.0 ELSE CASE category WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.6 WHEN 'es' THEN 0.5 ELSE 0.3 END END, 6) AS category_part,
 round(least(1.0, CASE WHEN list_contains(tags, 'src1') THEN 0.7 ELSE 0 END + CASE WHEN list_contains(tags, 'long') THEN 0.6 ELSE 0 END), 6) AS provenance_part,
 round(pow(0.5, id % 100 / 30.0), 6) AS recency_part, round(least(1.0, log10(id % 12 + 1)), 6) AS access_part FROM {MEMORIES}""")
def fm6_score_breakdown(spark, sf):
    """Category with its override, added and clamped boosts of tags, decay by age in days, and accesses."""
    category = F.when(F.array_contains("tags", "forget"), F.lit(1.0)).otherwise(S.lookup(F.col("category"), S.CATEGORY_WEIGHTS, 0.3))
    boosts = F.when(F.array_contains("tags", "src1"), 0.7).otherwise(0.0) + F.when(F.array_contains("tags", "long"), 0.6).otherwise(0.0)
    parts = {"category_part": category, "provenance_part": S.clamp(boosts), "recency_part": S.recency(F.col("id") % 100), "access_part": S.access_factor(F.col("id") % 12)}
    return T.memories(spark, sf).select("id", *(F.round(c, 6).alias(n) for n, c in parts.items()))


@query(f"SELECT id, list_sort(list_distinct(list_append(tags, 'seen'))) AS tags, len(list_filter(tags, lambda x: starts_with(x, 'lang:'))) = len(tags) AS all_lang FROM {MEMORIES}")
def fa1_arrays(spark, sf):
    t = F.col("tags")
    return T.memories(spark, sf).select("id", F.sort_array(F.array_union(t, F.array(F.lit("seen")))).alias("tags"), F.forall(t, lambda x: F.startswith(x, F.lit("lang:"))).alias("all_lang"))


@query(f"SELECT analyzer, len(members) AS n, members[1] AS first FROM (SELECT analyzer, list(name ORDER BY name, id) AS members FROM {SURVEY} GROUP BY analyzer) x")
def fj2_members_from_json(spark, sf):
    made = T.survey(spark, sf).groupBy("analyzer").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("name", "id"))), lambda m: m["name"])).alias("j"))
    members = F.from_json("j", "array<string>")
    return made.select("analyzer", F.size(members).alias("n"), F.element_at(members, 1).alias("first"))


@query(f"SELECT id, size FROM {MEMORIES} ORDER BY size DESC, id LIMIT 100")
def t1_memory_ranking(spark, sf):
    return R.top_k(T.memories(spark, sf).select("id", "size"), 100, F.desc("size"), "id")


@query("SELECT src, dst, 'added' AS side FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') a UNION ALL SELECT src, dst, 'removed' FROM (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') b")
def u3_except_both_ways(spark, sf):
    """Both differences from one shuffle: the sides that hold a pair are gathered by the pair."""
    li = T.table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    sides = li.agg(F.bool_or(F.col("l_returnflag") == "A").alias("new"), F.bool_or(F.col("l_returnflag") == "R").alias("old"))
    return sides.where("new <> old").select("src", "dst", F.when(F.col("new"), "added").otherwise("removed").alias("side"))


@query(f"SELECT id FROM {SURVEY} WHERE name LIKE '%idge%' AND analyzer = 'Brand#2' ORDER BY id LIMIT 1000")
def x10_compound_query(spark, sf):
    """A word without syntax is searched for anywhere in the name (X11); a limit of 0 is the default."""
    found = T.survey(spark, sf).where(F.rlike("name", F.lit(S.glob_to_regex(S.wildcard("idge")))) & (F.col("analyzer") == "Brand#2")).select("id").orderBy("id")
    return R.capped(found, 0)
