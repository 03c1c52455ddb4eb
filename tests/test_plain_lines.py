"""Lines without a whole mark take a short way to the same parts; marks of functions and branches are read from a table."""

import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators import source_lines as L

ALPHABETS = {"c": (L.C_LIKE, "ab /*'\"`\\ "), "hashed": (L.HASHED, "ab #'\"\\ "), "markup": (L.MARKUP, "ab <!-> ")}


@pytest.mark.parametrize("name", sorted(ALPHABETS))
def test_short_way_gives_the_same_parts(spark, name, monkeypatch):
    language, signs = ALPHABETS[name]
    rng = random.Random(7)
    pieces = [*signs, "word", "<!--", "-->", "/*", "*/", '"""']
    texts = [(i, "\n".join("".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(12))) for i in range(60)] + [(-1, None), (-2, "")]
    files = spark.createDataFrame(texts, "id int, text string")
    rows = lambda: sorted(map(tuple, L.lines_of(files, language).collect()))
    short = rows()
    monkeypatch.setattr(L.Automaton, "plain", lambda self, line: F.length(line) < 0)
    assert short == rows() and len(short) == 60 * 12 + 1


def test_texts_are_read_once_for_complexity(spark):
    """Functions and branches each went through the whole texts before."""
    files = spark.createDataFrame([(1, "{ if if { if } }"), (2, "if")], "id int, text string")
    found = L.complexity(files, r"\[", r"\}", r"\{", "if")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 6, 3), (1, 3, 5, 2)]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
