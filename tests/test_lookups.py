"""Names of files, markers, includes, read checks and searches on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sparquill.functions import files as N
from sparquill.operators import lookups as K


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_language_by_extension_name_and_first_line(spark):
    of = lambda path, content="": one(spark, N.language_of(F.lit(path), F.lit(content)))
    assert of("a/b.GO") == "go" and of("a.d/Makefile") == "make" and of("x.test.ts") == "typescript"
    assert of("run", "#!/usr/bin/env -S python3 -u\nprint()") == "python" and of("run", "#!/bin/sh\n") == "bash" and of("run", "#! node") == "javascript"
    assert of("run", "echo\n#!/bin/sh") == "" and of("a.unknown") == "" and of(None, None) == ""


def test_subject_of_test(spark):
    of = lambda path: one(spark, N.subject_of_test(F.lit(path)))
    assert of("p/q/a_test.go") == "p/q/a.go" and of("a.spec.tsx") == "a.tsx" and of("t/a.test.ts") == "t/a.ts" and of("t/test_a.py") == "t/a.py"
    assert of("a.go") is None and of("latest.py") is None and of(None) is None


def test_marked_lines(spark):
    of = lambda line: one(spark, N.marked(F.lit(line), {"TODO": "info", "BUG": "critical"}))
    r = of("x = 1  # TODO(kim): see AB-12 and CD-3")
    assert (r["keyword"], r["owner"], r["said"], r["severity"], r["ticket"]) == ("TODO", "kim", "see AB-12 and CD-3", "info", "AB-12")
    assert of("BUG")["said"] == "" and of("BUG()")["owner"] is None and of("bug: todo") is None and of("TODOS") is None and of(None) is None


def test_secrets_are_masked(spark):
    rules = [("password", "critical", "password=([^ ]+)"), ("key", "warning", "(AKIA[A-Z0-9]+)")]
    hits = one(spark, N.secrets(F.lit("password=abcdefgh AKIAXYZ"), rules))
    assert [tuple(h) for h in hits] == [("password", "critical", "abcd****"), ("key", "warning", "AKIA***")]
    assert one(spark, N.secrets(F.lit("nothing here"), rules)) == [] and not one(spark, N.secrets(F.lit(None).cast("string"), rules))


def test_display(spark):
    path = lambda p: one(spark, N.shown_path(F.lit(p).cast("string")))
    assert [path(p) for p in ("a/b/c.go", "c.go", "a/", "", None)] == [".../c.go", "c.go", "a/", "an unknown file", "an unknown file"]
    assert one(spark, N.shortened(F.lit("  ñandú  "), 5)) == "ñandú" and one(spark, N.shortened(F.lit("ñandús"), 5)) == "ñandú…"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_triggers(spark):
    prompts = ["please tset the code", "test", "", "code reviw now", "coed reveiw", "a b", "tests tests"]
    for trigger in ("test", "it", "code review", "deployments"):
        n = len(trigger.split())
        allowed = max(1, min(2, len(trigger) // 3 if n == 1 else -(-len(trigger) // 5)))
        for p in prompts:
            w = p.split() or [""]
            near = any(distance(" ".join(w[i : i + n]), trigger) <= allowed for i in range(len(w) - n + 1))
            assert one(spark, N.fuzzy_trigger(F.lit(p), trigger)) is near, (p, trigger)


def test_usage_of_a_day(spark):
    day, hour = 86_400_000_000, 3_600_000_000
    now = 19_000 * day + 10 * hour
    line = '{"role": "assistant", "usage": %d}'
    rows = [(now, line % 1), (now - hour, line % 2), (now - 6 * hour, line % 4), (now - 11 * hour, line % 8), (now, '{"role": "user", "usage": 16}'), (now, line[:-4] + "9"), (now, '{"role": "assistant"}'), (None, line % 32), (now, None)]
    df = spark.createDataFrame(rows, "at_us bigint, line string")
    got = K.usage_of_day(df, '"usage"', "role string, usage bigint", F.col("m.role") == "assistant", F.col("m.usage"), 5 * hour, now)
    assert [tuple(r) for r in got.collect()] == [(3, 7, 2, 3)]
    assert [tuple(r) for r in K.usage_of_day(df.limit(0), '"usage"', "role string, usage bigint", F.col("m.role") == "assistant", F.col("m.usage"), 5 * hour, now).collect()] == [(0, 0, 0, 0)]


def test_project_markers(spark):
    paths = [("r", p) for p in ("go.mod", "go.work", "sub/go.mod", "sub/deep/go.mod", "vendor/go.mod", "other/go.work", "docs/a.md", "sub/docs/b.md", None)] + [("s", "docs")]
    markers = [
        {"check": "file", "file": "go.mod", "label": "go", "max_depth": 1, "skip": ["vendor"]},
        {"check": "directory", "file": "docs", "label": "docs"},
        {"check": "sibling", "file": "go.work", "label": "workspace", "sibling_of": "go.mod"},
    ]
    got = K.project_markers(spark.createDataFrame(paths, "root string, path string"), markers)
    assert sorted(map(tuple, got.collect())) == [("r", "", "docs", "docs"), ("r", "", "go", "go.mod"), ("r", "", "workspace", "go.work"), ("r", "sub", "go", "go.mod")]


def walked(edges, root):
    """The walk itself: includes first, each once."""
    out = []

    def visit(n):
        if n not in out:
            for _, inc in sorted(edges.get(n, [])):
                visit(inc)
            out.append(n)

    visit(root)
    return out


def test_includes_in_the_order_of_the_walk(spark):
    import random

    for seed in range(4):
        r = random.Random(seed)
        edges = {i: [(k, j) for k, j in enumerate(r.sample(range(i + 1, 12), min(3, 11 - i)))] for i in range(11)}
        df = spark.createDataFrame([(n, k, i) for n, e in edges.items() for k, i in e], "name bigint, nth bigint, inc bigint")
        got = [x["name"] for x in K.include_order(df, 0).orderBy("place").collect()]
        assert got == walked(edges, 0)


def test_includes_of_one_and_of_itself(spark):
    schema = "name string, nth bigint, inc string"
    assert [tuple(r) for r in K.include_order(spark.createDataFrame([("x", 0, None)], schema), "a").collect()] == [("a", 0)]
    with pytest.raises(ValueError, match="itself"):
        K.include_order(spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "b")], schema), "a")
    with pytest.raises(ValueError, match="itself"):
        K.include_order(spark.createDataFrame([("a", 0, "a")], schema), "a")


def test_read_check(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",), ("e",)], "path string")
    index = spark.createDataFrame([("a", 1, 2, 10), ("b", 1, 0, 0), ("c", 1, 1, 5), ("e", 7, 0, 0)], "path string, mtime int, symbols int, tokens int")
    disk = spark.createDataFrame([("a", 1, 30, "go"), ("b", 2, 35, "go"), ("d", 1, 9, "go"), ("e", 7, 0, None)], "path string, mtime int, size int, language string")
    got = {r["path"]: tuple(r)[1:] for r in K.read_check(asked, index, disk, {"go": 3.5}).collect()}
    assert got == {"a": (True, True, 2, True, 10), "b": (True, False, 0, False, 10), "c": (True, False, 1, True, 5), "d": (False, False, 0, False, 0), "e": (True, True, 0, False, 0)}


def test_symbol_search_fetches_twice_and_filters_then(spark):
    rows = [(i, f"getUser{i}", "func x", "", "method" if i % 2 else "function", f"p/{i % 3}.go") for i in range(6)] + [(9, "other", "takes getuser", "of getuser", "method", "p/1.go"), (10, None, None, None, "method", None)]
    df = spark.createDataFrame(rows, "id bigint, name string, signature string, doc string, kind string, path string")
    assert K.symbol_search(df, "getUser", 2).count() == 4
    assert [r["id"] for r in K.symbol_search(df, "getUser", 2, kind="method").orderBy("id").collect()] == [1, 9]
    assert [r["id"] for r in K.symbol_search(df, "getUser", 20, path_part="1.go").orderBy("id").collect()] == [1, 4, 9]
    assert K.symbol_search(df, "nothing", 2).count() == 0 and K.symbol_search(df.limit(0), "x").count() == 0


def test_cross_search_caps_each_instance(spark):
    schema = "instance string, id bigint, title string, detail string"
    memories = spark.createDataFrame([("x", i, "t", f"say Hello {i}") for i in range(5)] + [("y", 7, "hello", None), ("y", 8, None, None)], schema)
    tasks = spark.createDataFrame([("x", i, "hello", "") for i in range(4)], schema)
    got = K.cross_search([("memory", memories, 2), ("task", tasks, None)], "HELLO").select("instance", "type", "id")
    assert sorted(map(tuple, got.collect())) == [("x", "memory", 0), ("x", "memory", 1), ("x", "task", 0), ("x", "task", 1), ("x", "task", 2), ("x", "task", 3), ("y", "memory", 7)]


def test_latest_stamp(spark):
    rows = [("a", "c1", 1, 1), ("a", "c2", 5, 2), ("a", "c3", 5, 3), ("a", "", 9, 4), ("a", None, 10, 5), ("b", None, 1, 6)]
    df = spark.createDataFrame(rows, "run string, commit string, at int, id bigint")
    assert sorted(map(tuple, K.latest_stamp(df, "run", "commit", "at", "id").collect())) == [("a", "c2"), ("b", None)]
