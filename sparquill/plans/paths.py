"""Ignore rules over the paths of pages."""

from pyspark.sql import functions as F

from ..functions import ignore
from ..sources import tables as T
from .registry import query

#: Rules by folder, layer and place, as text; what each means in SQL stands beside the query.
RULES = [
    ("", 0, 1, "*.html"),
    ("", 0, 2, "/blog.*/fr/"),
    ("", 0, 3, "**/es/*[0-4]"),
    ("", 1, 1, "!/m.*/**/*.html"),
    ("", 1, 2, "de/"),
    ("", 1, 3, "# a comment"),
    ("spam-farm.example.org/", 1, 1, "/en/**"),
    ("spam-farm.example.org/", 1, 2, "!7?[!05]"),
]
PATHS = "(SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages) p"


@query(f"""SELECT path, CASE WHEN starts_with(path, 'spam-farm.example.org/') AND regexp_matches(path, '/7[^/][^05](/|$)') THEN false WHEN regexp_matches(path, '^spam-farm[.]example[.]org/en/.') THEN true
 WHEN regexp_matches(path, '(^|/)de/') THEN true WHEN regexp_matches(path, '^m[.][^/]*/(.*/)?[^/]*[.]html(/|$)') THEN false WHEN regexp_matches(path, '^(.*/)?es/[^/]*[0-4](/|$)') THEN true
 WHEN regexp_matches(path, '^blog[.][^/]*/fr/') THEN true ELSE regexp_matches(path, '[.]html(/|$)') END AS ignored FROM {PATHS}""")
def p15_ignore_rules(spark, sf):
    """Rules of two layers and of a nested file; the last that matches decides."""
    url = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    paths = T.table(spark, sf, "pages").select(url.alias("path")).distinct()
    return ignore.ignored(paths, spark.createDataFrame(RULES, "folder string, layer int, place int, rule string"))
