"""Scalar functions as column expressions."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of memory categories and of the parts of a memory's score.
CATEGORY_WEIGHTS = {"en": 0.9, "de": 0.7, "fr": 0.6, "es": 0.5}
PARTS = {"category": 0.50, "provenance": 0.15, "recency": 0.25, "access": 0.10}
HALF_LIFE_DAYS = 30.0
#: Characters to a token by language.
CHARS_PER_TOKEN = {"en": 3.5, "de": 3.1, "fr": 3.2, "es": 3.3}


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def lookup(key: Column, values: dict, default: float) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()], F.lit(default))


def recency(age_days: Column) -> Column:
    """Exponential decay with a half life; the future counts as now."""
    return F.when(age_days <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / HALF_LIFE_DAYS))


def access_factor(n: Column) -> Column:
    return clamp(F.log10(n + 1) / F.log10(F.lit(10.0)))


def memory_score(category: Column, provenance: Column, age_days: Column, accesses: Column, manual: Column) -> Column:
    """A manual priority, else the weighted parts, between 0 and 1."""
    parts = PARTS["category"] * category + PARTS["provenance"] * clamp(provenance) + PARTS["recency"] * recency(age_days) + PARTS["access"] * access_factor(accesses)
    return F.when(manual > 0, clamp(manual)).otherwise(clamp(parts))


def estimated_tokens(length: Column, ratio: Column) -> Column:
    return F.floor(length / ratio + 0.5).cast("bigint")


def churn_score(commits: Column, lines: Column) -> Column:
    return commits * (1 + lines / 100)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 3).when(severity == "warning", 2).when(severity == "info", 1).otherwise(0)


def glob_to_regex(pattern: str) -> str:
    """An anchored pattern in which only the star is special."""
    return "^" + ".*".join("\\Q" + p + "\\E" if p else "" for p in pattern.split("*")) + "$"


def contains_fold(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def all_tags(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def any_tag(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def command_signature(command: Column) -> Column:
    """Stages between pipes, each without environment prefix, path and redirections, blanks collapsed."""
    def stage(s: Column) -> Column:
        s = F.regexp_replace(F.trim(s), r"^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
        s = F.regexp_replace(s, r"\s*[0-9]*(>>|>|<)&?\s*\S+", "")
        s = F.regexp_replace(s, r"^\S*/", "")
        return F.trim(F.regexp_replace(s, r"\s+", " "))

    return F.array_join(F.transform(F.split(command, r"\|"), stage), " | ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9']+"), F.lit(0))


def topic_path(topic: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(topic), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def polynomial_hash(codes: Column, base: int = 257, modulus: int = 1_000_000_007) -> Column:
    """Rolling polynomial hash of an array of integers."""
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, c: (a * base + c) % modulus)


def map_int(m: Column) -> Column:
    """An integer from text; anything else counts as 0."""
    return F.coalesce(m.try_cast("bigint"), F.lit(0).cast("bigint"))


def tokens(text: Column) -> Column:
    """The parts of a text between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def lined_tokens(text: Column) -> Column:
    """The same tokens (t), each with the number of its line (from 1)."""
    return F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(tokens(x), lambda t: F.struct(t.alias("t"), (i + 1).alias("line")))))


def first_match(tokens: Column, patterns: list[str]) -> Column:
    """The first pattern that matches any token, else null."""

    def matches(pattern: str) -> Column:
        return F.exists(tokens, lambda t: F.rlike(t, F.lit("(?s)" + glob_to_regex(pattern))))

    return F.coalesce(*[F.when(matches(p), F.lit(p)) for p in patterns])


def included(tokens: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a pattern of `include` matches a token, or there is none, and no pattern of `exclude` does."""
    wanted = first_match(tokens, include).isNotNull() if include else F.lit(True)
    return wanted & first_match(tokens, exclude).isNull() if exclude else wanted


def time_range(since: str | None, until: str | None) -> tuple[int, int]:
    """Microseconds of two RFC 3339 times; an open end is unbounded, an end before the start an error."""

    def micros(x: str) -> int:
        return round(datetime.datetime.fromisoformat(x.replace("Z", "+00:00")).timestamp() * 1_000_000)

    a, b = micros(since) if since else -(1 << 62), micros(until) if until else 1 << 62
    if a > b:
        raise ValueError("since lies after until")
    return a, b


def duration_us(text: str) -> int:
    """Microseconds of a duration such as 7d, 36h, 90m, 1.5s or 200ms, or of several of these in a row."""
    units = {"d": 86_400_000_000, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)(ms|us|d|h|m|s)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text}")
    return round(sum(float(n) * units[u] for n, u in parts))


def ignored_command(signature: Column, names: list[str]) -> Column:
    """Whether a command is one of the names, or one of them with arguments."""
    out = F.lit(False)
    for name in names:
        out = out | (signature == name) | F.startswith(signature, F.lit(name + " "))
    return out


def wildcard(q: str) -> str:
    """A query without any syntax of its own matches anywhere."""
    return q if any(c in q for c in '*?:+-"~^()') else f"*{q}*"


def wildcards(q: Column) -> Column:
    """The same for a column of queries."""
    return F.when(F.rlike(q, F.lit(r'[*?:+\-"~^()]')), q).otherwise(F.concat(F.lit("*"), q, F.lit("*")))


def first_filled(*columns: str) -> Column:
    """The first column whose text isn't empty, without blanks around it."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def cost(known: Column, text: Column) -> Column:
    """A known number of tokens, else a third of the text's bytes, rounded up."""
    return F.coalesce(known, F.floor((F.octet_length(text) + 2) / 3).cast("bigint"))


def truthy(text: Column) -> Column:
    """What counts as true."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("1", "true", "yes", "on")
