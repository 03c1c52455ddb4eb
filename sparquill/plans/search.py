"""Searches over stored indexes of memories, findings and survey entries."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.search import WORD, SearchIndex, postings_of
from ..sources import tables as T
from .filters import DECISIONS, FINDINGS, MEMORIES
from .registry import query
from .stores import SURVEY, TASKS

MEMORY_WORDS = "disgust réeuxmant Thanedble 3 stupd and"
SURVEY_WORDS = "rad part bolt"


def index_sql(entity: str, column: str, words: str, prefix: str = "") -> str:
    """Common tables tf (id, term, tf), m (term, df, legs) and n (n) of a search, with a prefix to their names."""
    p = prefix
    grams = lambda t: f"list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))"
    rest = lambda t, k: f"substr({t}, i + {k})"
    pairs = " OR ".join(f"{rest('term', a)} = {rest('said', b)}" for a, b in ((1, 1), (2, 2), (1, 2), (2, 1)))
    # an edit of letters, as levenshtein() counts bytes here
    one_edit = f"list_bool_or(list_transform(range(0, least(length(term), length(said)) + 1), lambda i: left(term, i) = left(said, i) AND ({pairs})))"
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words.split()))
    pattern = WORD.replace("'", "''")
    return f"""{p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower({column}), '{pattern}')) AS term FROM {entity}) GROUP BY ALL),
 {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term), {p}n AS (SELECT count(DISTINCT id) AS n FROM {entity}), {p}q(word, said) AS (VALUES {values}),
 {p}m AS (SELECT term, any_value(df) AS df, sum(CASE WHEN term = lower(said) THEN 1 ELSE 0 END + CASE WHEN {one_edit} THEN 1 ELSE 0 END
 + CASE WHEN length(term) >= 2 AND length(said) >= 2 AND left(term, 2) = left(lower(said), 2) THEN 1 ELSE 0 END + CASE WHEN list_has_any({grams("term")}, {grams("lower(said)")}) THEN 1 ELSE 0 END) AS legs FROM {p}df, {p}q GROUP BY term),
 {p}s AS (SELECT id, CAST(sum(tf * legs * CAST(round(ln(1 + n / df) * 1000000) AS BIGINT)) AS DOUBLE) / 1000000 AS score FROM {p}tf JOIN {p}m USING (term), {p}n WHERE legs > 0 GROUP BY id)"""


def memory_index(spark, sf):
    return SearchIndex.kept("memories", T.memories(spark, sf).select("id", "content"), T.table(spark, sf, "documents"))


def survey_index(spark, sf):
    entries = T.survey(spark, sf).select("id", F.concat_ws(" ", "name", "kind").alias("content"))
    return SearchIndex.kept("survey", entries, T.table(spark, sf, "part"))


def finding_index(spark, sf):
    return SearchIndex.kept("findings", T.findings(spark, sf).select("id", F.col("file").alias("content")), T.table(spark, sf, "labels"))


@query(f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{WORD.replace(chr(39), chr(39) * 2)}')) AS term FROM documents) GROUP BY ALL")
def x1_postings_whole(spark, sf):
    return postings_of(T.memories(spark, sf))


@query(f"WITH {index_sql(MEMORIES, 'content', MEMORY_WORDS)} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 50")
def x4_memory_search(spark, sf):
    """Each of up to ten words matches exactly, by one edit, by a prefix and by a part; all of it is OR-ed."""
    return memory_index(spark, sf).search(MEMORY_WORDS, 50)


@query(f"""WITH {index_sql(MEMORIES, 'content', MEMORY_WORDS)}, t AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 200)
 SELECT t.id, score FROM t JOIN {MEMORIES} ON m.id = t.id WHERE score >= 60 AND NOT list_has_any(tags, ['src3', 'lang:de'])""")
def x6_scored_search(spark, sf):
    """The limit applies before the least score and the excluded tags do."""
    top = memory_index(spark, sf).search(MEMORY_WORDS, 200)
    tags = T.memories(spark, sf).select("id", "tags")
    return top.where("score >= 60").join(tags.where(~S.any_tag(F.col("tags"), ["src3", "lang:de"])), "id", "left_semi")


@query(f"""WITH {index_sql(FINDINGS, 'file', 'src7 fr')}, t AS (SELECT s.id, score FROM s JOIN {FINDINGS} ON f.id = s.id WHERE severity <> 'critical' ORDER BY score DESC, id LIMIT 300)
 SELECT t.id, score FROM t JOIN {FINDINGS} ON f.id = t.id WHERE NOT accepted""")
def x8_findings_search_indexed(spark, sf):
    """The exact conditions hold with the words; accepted findings go after the limit."""
    f = T.findings(spark, sf)
    top = finding_index(spark, sf).search("src7 fr", 300, f.where("severity <> 'critical'"))
    return top.join(f.where("not accepted").select("id"), "id", "left_semi")


@query(f"WITH {index_sql(SURVEY, 'concat_ws(chr(32), name, kind)', SURVEY_WORDS)} SELECT s.id, score FROM s JOIN {SURVEY.replace(') s', ') v')} ON v.id = s.id WHERE v.analyzer = 'Brand#2' ORDER BY score DESC, s.id LIMIT 100")
def x9_survey_search(spark, sf):
    return survey_index(spark, sf).search(SURVEY_WORDS, 100, T.survey(spark, sf).where("analyzer = 'Brand#2'"))


@query(f"""WITH {index_sql(MEMORIES, 'content', MEMORY_WORDS, 'm_')}, {index_sql(FINDINGS, 'file', 'src1', 'f_')}, {index_sql(SURVEY, 'concat_ws(chr(32), name, kind)', SURVEY_WORDS, 'v_')}
 SELECT 'memory' AS entity, id FROM (SELECT id FROM m_s ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT 'finding', id FROM (SELECT id FROM f_s ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT 'survey', id FROM (SELECT id FROM v_s ORDER BY score DESC, id LIMIT 5)
 UNION ALL SELECT 'decision', seq FROM {DECISIONS} WHERE contains(lower(value), 'urgent') UNION ALL SELECT 'task', id FROM {TASKS} WHERE contains(lower(title), 'urgent') AND status = 'pending'""")
def x13_cross_entity_search(spark, sf):
    """Words search memories, findings and survey entries; decisions and pending tasks are searched for a part of their text."""

    def top(entity, index, words, n):
        return index.search(words, n).select(F.lit(entity).alias("entity"), "id")

    def part(entity, df, column):
        return df.where(S.contains_fold(F.col(column), "urgent")).select(F.lit(entity).alias("entity"), "id")

    found = top("memory", memory_index(spark, sf), MEMORY_WORDS, 10).unionByName(top("finding", finding_index(spark, sf), "src1", 5)).unionByName(top("survey", survey_index(spark, sf), SURVEY_WORDS, 5))
    found = found.unionByName(part("decision", T.decisions(spark, sf).withColumnRenamed("seq", "id"), "value"))
    return found.unionByName(part("task", T.tasks(spark, sf).where("status = 'pending'"), "title"))
