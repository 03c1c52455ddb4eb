"""What a session starts with: memories by score within one budget, decisions, sessions and the map of the code; skills by their triggers."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import relational as R
from ..sources import tables as T
from .filters import DECISIONS, EVENTS, MEMORIES
from .registry import query
from .stores import SURVEY

SCORE = """round(least(1.0, greatest(0.0, 0.50 * CASE category WHEN 'en' THEN 0.9 WHEN 'de' THEN 0.7 WHEN 'fr' THEN 0.6 WHEN 'es' THEN 0.5 ELSE 0.4 END
 + 0.15 * CASE WHEN size > 2000 THEN 0.5 ELSE 0.2 END + 0.25 * CASE WHEN id % 90 <= 0 THEN 1.0 ELSE pow(0.5, (id % 90) / 30.0) END + 0.10 * least(1.0, greatest(0.0, log10((id % 12) + 1))))), 6)"""
BUDGET, MOST = 6000, 100


def scored(m):
    """Memories with their score; age and accesses, which documents don't have, follow from their ids."""
    category = S.lookup(F.col("category"), S.CATEGORY_WEIGHTS, 0.4)
    provenance = F.when(F.col("size") > 2000, 0.5).otherwise(0.2)
    return m.withColumn("score", F.round(S.memory_score(category, provenance, F.col("id") % 90, F.col("id") % 12, F.lit(0.0)), 6))


@query(f"SELECT id, {SCORE} AS score FROM {MEMORIES} ORDER BY score DESC, id LIMIT 100")
def t1_ranking_by_score(spark, sf):
    return R.top_k(scored(T.memories(spark, sf)).select("id", "score"), 100, F.desc("score"), "id")


def sections(spark, sf):
    """Global memories, then the project's, without forgotten and partial ones."""
    m = scored(T.memories(spark, sf).where(~S.any_tag(F.col("tags"), ["forget", "long"]))).withColumn("cost", S.estimated_tokens(F.col("size"), F.lit(3.0)))
    of = lambda tag: m.where(F.array_contains("tags", tag)).select("id", "score", "cost")
    return [("global", of("src1")), ("project", of("src2"))]


def ranked_sql(name: str, tag: str) -> str:
    return f"""{name} AS (SELECT id, cost, row_number() OVER w AS rn, sum(cost) OVER w AS run, first_value(cost) OVER w AS c1 FROM (SELECT id, {SCORE} AS score, CAST(floor(size / 3.0 + 0.5) AS BIGINT) AS cost FROM {MEMORIES} WHERE list_contains(tags, '{tag}') AND NOT list_has_any(tags, ['forget', 'long']) ORDER BY score DESC, id LIMIT {MOST}) x
 WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


SHARED = f"""{ranked_sql("g", "src1")}, {ranked_sql("p", "src2")}, gt AS (SELECT * FROM g WHERE rn = 1 OR run - c1 <= greatest(0, {BUDGET} - c1)), r AS (SELECT greatest(0, {BUDGET} - coalesce(max(run), 0)) AS remaining, count(*) AS n FROM gt),
 pt AS (SELECT p.* FROM p, r WHERE CASE WHEN n > 0 THEN run <= remaining ELSE rn = 1 OR run - c1 <= greatest(0, remaining - c1) END),
 b AS (SELECT 'global' AS section, rn - 1 AS place, id FROM gt UNION ALL SELECT 'project', rn - 1, id FROM pt)"""


@query(f"WITH {SHARED} SELECT section, place, id FROM b")
def w10_shared_budget(spark, sf):
    """One budget, spent by the global memories first and carried on to the project's."""
    return R.shared_budget(sections(spark, sf), [F.desc("score"), "id"], "cost", BUDGET, MOST).select("section", "place", "id")


@query(f"""WITH {SHARED}, d AS (SELECT topic, precedence FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY created DESC, seq) AS rn FROM {DECISIONS}) t WHERE rn = 1),
 s AS (SELECT session, max(ts_us) AS newest FROM {EVENTS} GROUP BY session ORDER BY newest DESC, session LIMIT 5), m AS (SELECT id, size, name FROM {SURVEY} ORDER BY size DESC, name, id LIMIT 12)
 SELECT section, place, id FROM b UNION ALL SELECT 'decision', row_number() OVER (ORDER BY precedence DESC, topic) - 1, topic FROM d UNION ALL SELECT 'session', row_number() OVER (ORDER BY newest DESC, session) - 1, session FROM s UNION ALL SELECT 'map', row_number() OVER (ORDER BY size DESC, name, id) - 1, id FROM m""")
def f21_session_context(spark, sf):
    """Memories within the budget, the latest decision of each topic by precedence, recent sessions and the largest modules."""
    memories = R.shared_budget(sections(spark, sf), [F.desc("score"), "id"], "cost", BUDGET, MOST).select("section", "place", "id")
    d = R.latest(T.decisions(spark, sf), ["topic"], F.desc("created"), F.col("seq")).select("topic", "precedence")
    decisions = R.ranked(d, F.desc("precedence"), "topic", name="place").select(F.lit("decision").alias("section"), "place", F.col("topic").alias("id"))

    def top(df, section, n, *order):
        few = R.top_k(df, n, *order)  # so few rows are numbered in one place
        return few.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint").alias("place"), "id")

    recent = T.events(spark, sf).groupBy(F.col("session").alias("id")).agg(F.max("ts_us").alias("newest"))
    return memories.unionByName(decisions).unionByName(top(recent, "session", 5, F.desc("newest"), "id")).unionByName(top(T.survey(spark, sf), "map", 12, F.desc("size"), "name", "id"))


#: Skills and their triggers.
TRIGGERS = [("paint", "red"), ("paint", "blue paint"), ("build", "bolt"), ("build", "steel pipe"), ("move", "widget"), ("move", "large widgit")]


def trigger_score(prompt, trigger):
    """Twice the length of a trigger that a prompt holds, its length where words of it are nearly the trigger, else 0."""
    words, n, k = F.split(prompt, r"\s+"), F.length(trigger), F.size(F.split(trigger, r"\s+"))
    most = F.when(k == 1, F.greatest(F.lit(1), F.least(F.lit(2), F.floor(n / 3)))).otherwise(F.greatest(F.lit(1), F.least(F.lit(2), F.ceil(n / 5))))
    windows = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.when(F.contains(prompt, trigger), 2 * n).when(F.exists(windows, lambda x: F.levenshtein(x, trigger) <= most), n).otherwise(0)


def skill_scores(spark, sf):
    # a fixed list of triggers
    triggers = spark.createDataFrame(TRIGGERS, "skill string, trigger string")
    prompts = T.table(spark, sf, "items").select(F.col("item_id").alias("id"), F.lower(F.concat_ws(" ", "name", "kind")).alias("prompt"))
    scored_ = prompts.join(F.broadcast(triggers)).withColumn("s", trigger_score(F.col("prompt"), F.col("trigger")))
    return scored_.groupBy("id", "skill").agg(F.sum("s").cast("bigint").alias("score")).where("score > 0")


_VALUES = ", ".join(f"('{s}', '{t}')" for s, t in TRIGGERS)
_LISTS = "string_split_regex(prompt, '\\s+')"
_WORDS = "len(string_split_regex(trigger, '\\s+'))"
SKILLS = f"""(SELECT id, skill, CAST(sum(CASE WHEN contains(prompt, trigger) THEN 2 * length(trigger) WHEN list_bool_or(list_transform(range(1, greatest(len({_LISTS}) - {_WORDS} + 2, 1)), lambda i: levenshtein(array_to_string({_LISTS}[i:i + {_WORDS} - 1], ' '), trigger)
 <= CASE {_WORDS} WHEN 1 THEN greatest(1, least(2, length(trigger) // 3)) ELSE greatest(1, least(2, CAST(ceil(length(trigger) / 5) AS BIGINT))) END)) THEN length(trigger) ELSE 0 END) AS BIGINT) AS score
 FROM (SELECT item_id AS id, lower(concat_ws(' ', name, kind)) AS prompt FROM items) p, (VALUES {_VALUES}) t(skill, trigger) GROUP BY id, skill HAVING score > 0)"""


@query(f"SELECT id, skill, score FROM {SKILLS}")
def fs10_skill_scores(spark, sf):
    """Items as prompts: exact triggers count twice their length, near ones (F-S9) once, summed by skill."""
    return skill_scores(spark, sf)


@query(f"SELECT id, skill, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, skill) AS rn FROM {SKILLS}) WHERE rn <= 2")
def t6_skills_of_prompts(spark, sf):
    """The two best skills of each prompt."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "skill")
    return skill_scores(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")
