"""Ignore rules with the syntax of gitignore, as patterns over paths.

A rule is compiled by expressions alone, so rules may come from as many files as there are folders. Paths are relative and
have forward slashes; a folder's ends with one. The last rule that matches decides, "!" takes a path back in, a rule that
ends with a slash matches folders only, one with another slash is anchored to the folder of its file, "*" and "?" stay within
a name, "**" spans names, and what matches a folder matches all that it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sign that no rule holds stands for what is replaced later.
ANY_FOLDERS, BELOW, ANY = "\u0001", "\u0002", "\u0003"


def clean(rule: Column) -> Column:
    """Without blanks at the end; null for comments and empty lines."""
    r = F.regexp_replace(F.regexp_replace(rule, r"\r$", ""), r"(?<!\\)[ \t]+$", "")
    return F.when((r != "") & ~F.startswith(r, F.lit("#")) & ~r.isin("!", "/"), r)


def negated(rule: Column) -> Column:
    return F.startswith(rule, F.lit("!"))


def literal(text: Column) -> Column:
    """A pattern for exactly this text."""
    return F.regexp_replace(text, r"([\\.+*?()|{}\[\]^$])", r"\\$1")


def rule_pattern(rule: Column, folder: Column) -> Column:
    """The regular expression of a clean rule in a file of a folder ("" for the root, else with a slash at its end)."""
    body = F.regexp_replace(F.regexp_replace(rule, r"^!", ""), r"^\\([!#])", "$1")
    only_folders = F.endswith(body, F.lit("/"))
    body = F.regexp_replace(body, r"/$", "")
    anchored = F.contains(body, F.lit("/"))
    body = F.regexp_replace(body, r"^/", "")
    p = F.regexp_replace(body, r"([.+()|{}^$])", r"\\$1")
    p = F.regexp_replace(p, r"\[!", "[^").cast("string")
    p = F.regexp_replace(p, r"\[\\\^", "[^")
    p = F.regexp_replace(F.regexp_replace(p, r"^\*\*/", ANY_FOLDERS), r"/\*\*/", "/" + ANY_FOLDERS)
    p = F.regexp_replace(F.regexp_replace(p, r"/\*\*$", BELOW), r"\*\*", ANY)
    p = F.regexp_replace(F.regexp_replace(p, r"(?<!\\)\*", "[^/]*"), r"(?<!\\)\?", "[^/]")
    p = F.replace(F.replace(F.replace(p, F.lit(ANY_FOLDERS), F.lit("(?:.*/)?")), F.lit(BELOW), F.lit("/.+")), F.lit(ANY), F.lit("[^/]*"))
    start = F.when(anchored, "").otherwise("(?:.*/)?")
    return F.concat(F.lit("^"), literal(folder), start, p, F.when(only_folders, "/").otherwise("(?:/|$)"))


def compiled(rules: DataFrame) -> DataFrame:
    """folder, layer, place, pattern, back of rules (folder, layer, place, rule); back: takes a path back in."""
    rows = rules.withColumn("rule", clean(F.col("rule"))).where("rule is not null")
    return rows.select("folder", "layer", "place", rule_pattern(F.col("rule"), F.col("folder")).alias("pattern"), negated(F.col("rule")).alias("back"))


def ancestors(path: Column) -> Column:
    """The folders that a path lies in, the root first."""
    names = F.split(F.regexp_replace(path, r"/$", ""), "/")
    return F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n), "/"), F.lit("/"))))


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """path, ignored of distinct paths. Rules meet the paths of their folder by equality; layer, depth and place order them."""
    met = paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(compiled(rules), "folder").where(F.rlike(F.col("path"), F.col("pattern")))
    last = met.groupBy("path").agg(F.max_by("back", F.struct("layer", F.length("folder"), "place")).alias("back"))
    return paths.select("path").join(last, "path", "left").select("path", F.coalesce(~F.col("back"), F.lit(False)).alias("ignored"))
