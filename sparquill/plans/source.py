"""Comments, imports and complexity of pages as source files, one tag a line."""

from pyspark.sql import functions as F

from ..operators import source_lines as L
from ..sources import tables as T
from .registry import query

PAGE_LINES = "(SELECT page_id AS id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no, unnest(string_split(t, chr(10))) AS text FROM (SELECT page_id, replace(html, '>', '>' || chr(10)) AS t FROM pages)) l"
SEVERITIES = {"ad": "info", "related": "warning", "end": "critical"}
COMMENTS = f"(SELECT id, line_no, text, trim(regexp_extract(text, '<!--(.*?)-->', 1)) AS comment, regexp_replace(text, '<!--.*?-->', '', 'g') AS code FROM {PAGE_LINES}) c"


def page_files(spark, sf):
    """id, text: pages with a line for each tag."""
    return T.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.replace(F.col("html"), F.lit(">"), F.lit(">\n")).alias("text"))


@query(f"SELECT id, line_no, comment FROM {COMMENTS} WHERE comment <> ''")
def fs17_comment_text(spark, sf):
    return L.lines_of(page_files(spark, sf), L.MARKUP).where("comment <> ''").select("id", "line_no", "comment")


@query(f"""SELECT id, line_no, regexp_extract(comment, '\\b(ad|related|end)\\b', 1) AS keyword, regexp_extract(comment, '\\b(?:ad|related|end)\\b\\s*:?\\s*(.*)$', 1) AS said,
 CASE regexp_extract(comment, '\\b(ad|related|end)\\b', 1) WHEN 'ad' THEN 'info' WHEN 'related' THEN 'warning' ELSE 'critical' END AS severity FROM {COMMENTS} WHERE regexp_matches(comment, '\\b(ad|related|end)\\b')""")
def f8_marked_comments(spark, sf):
    """Comments with a keyword, what they say and how much it matters."""
    return L.marked_comments(L.lines_of(page_files(spark, sf), L.MARKUP), SEVERITIES).select("id", "line_no", "keyword", "said", "severity")


@query(f"SELECT id, line_no, rule FROM {COMMENTS} JOIN (VALUES ('script', '<script[ >]'), ('handler', 'onclick='), ('ad', 'class=.ad.'), ('outside', 'href=.https?://')) r(rule, pattern) ON regexp_matches(code, pattern)")
def f7_rules_outside_comments(spark, sf):
    return L.rule_hits(L.lines_of(page_files(spark, sf), L.MARKUP), {"script": "<script[ >]", "handler": "onclick=", "ad": "class=.ad.", "outside": "href=.https?://"})


@query(f"""SELECT id, comments, filled, plain FROM (SELECT id, count(*) FILTER (contains(text, '<!--') AND trim(code) = '') AS comments, count(*) FILTER (trim(text) <> '') AS filled,
 count(*) FILTER (contains(text, '<!--') AND trim(code) = '' AND regexp_matches(comment, '^ad ')) AS plain FROM {COMMENTS} GROUP BY id) x WHERE plain >= 1 OR (comments > 5 AND comments > 0.3 * filled)""")
def f23_comment_density(spark, sf):
    return L.excess_comments(L.lines_of(page_files(spark, sf), L.MARKUP), "^ad ", least_obvious=1)


@query(f"""WITH s AS (SELECT *, coalesce(last_value(CASE WHEN trim(text) = '</nav>' THEN false WHEN contains(text, '<nav') THEN true END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM {PAGE_LINES})
 SELECT id, line_no, CASE WHEN inside AND regexp_matches(text, 'href="([^"]+)"') THEN regexp_extract(text, 'href="([^"]+)"', 1) WHEN NOT inside AND regexp_matches(text, 'class="([^"]+)"') THEN regexp_extract(text, 'class="([^"]+)"', 1) ELSE regexp_extract(text, '(charset|lang)=', 1) END AS target
 FROM s WHERE (CASE WHEN inside THEN trim(text) <> '</nav>' ELSE NOT contains(text, '<nav') END) AND ((inside AND regexp_matches(text, 'href="([^"]+)"')) OR (NOT inside AND regexp_matches(text, 'class="([^"]+)"')) OR regexp_matches(text, '(charset|lang)='))""")
def s33_imports_with_blocks(spark, sf):
    """Menus are blocks of imports by address; outside of them a class is one."""
    lines = page_files(spark, sf).select("id", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line_no"), "text")
    return L.imports(lines, "<nav", "</nav>", [("block", 'href="([^"]+)"'), ("single", 'class="([^"]+)"'), ("", "(charset|lang)=")])


@query()
def f5_block_complexity(spark, sf):
    """Menus, articles and notices of pages as functions, their links, items and paragraphs as branches."""
    code = L.lines_of(page_files(spark, sf), L.MARKUP).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line_no", "bare"))).alias("l"))
    bare = code.select("id", F.array_join(F.transform("l", lambda x: x["bare"]), "\n").alias("text"))
    out = L.complexity(bare, r"<(?:ul|ol|table|section|header)[^>]*>", r"</(?:nav|article|div|aside|footer|ul|ol|table|section|header)>", r"<(?:nav|article|div|aside|footer)[^>]*>", r"<(?:a|li|p|td|h[1-6])[ >]")
    return out.withColumn("severity", L.severity(F.col("complexity")))
