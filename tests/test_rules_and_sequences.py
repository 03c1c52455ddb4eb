"""Ignore rules and sequence detectors on fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sparquill.functions import ignore
from sparquill.operators import sequences

DEFAULTS = ["node_modules/", "build/", "*.pb.go", "*.min.js", "**/testdata/", "*_test.go", ".git/", "**/static/lib/"]
CASES = [
    (DEFAULTS, {"build": False, "build/": True, "packages/foo/node_modules/": True, "packages/foo/node_modules/a/b.js": True, ".git/": True, "main.go": False, "a/b_test.go": True, "x.pb.go": True, "web/static/lib/a.js": True, "web/static/lib": False, "a/testdata/f": True, "README.md": False}),
    (["*.pb.go", "!important.pb.go"], {"foo.pb.go": True, "important.pb.go": False, "a/important.pb.go": False}),
    (["/rootfile.txt"], {"rootfile.txt": True, "sub/rootfile.txt": False}),
    (["*.log", "", "# none", "  "], {"error.log": True, "logs/error.log": True, "error.log.txt": False}),
    (["**/test/"], {"test/": True, "a/b/test/": True, "a/b/test": False, "test/x": True}),
    (["docs/*.md", "a/**/b", "c/**"], {"docs/x.md": True, "docs/s/x.md": False, "x/docs/y.md": False, "a/b": True, "a/x/y/b": True, "ab": False, "c/x": True, "c/": False}),
    (["file?.t[xy]t", "[!a]z", "\\!odd", "\\#hash", "sp ace  "], {"file1.txt": True, "file12.txt": False, "file/.txt": False, "bz": True, "az": False, "!odd": True, "#hash": True, "sp ace": True}),
    (["out/", "!out/keep.txt"], {"out/keep.txt": False, "out/x.txt": True}),
]


@pytest.mark.parametrize(("rules", "want"), CASES)
def test_ignore_rules(spark, rules, want):
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    frame = spark.createDataFrame([("", 0, n, r) for n, r in enumerate(rules)], "folder string, layer int, place int, rule string")
    assert {r["path"]: r["ignored"] for r in ignore.ignored(paths, frame).collect()} == want


def test_ignore_rules_of_nested_files_and_layers(spark):
    rules = [("", 0, 1, "*.txt"), ("a+b/", 0, 1, "!keep.txt"), ("a+b/c/", 0, 1, "/keep.txt"), ("", 1, 1, "!last.txt")]
    want = {"x.txt": True, "keep.txt": True, "a+b/keep.txt": False, "a+b/c/keep.txt": True, "a+b/c/d/keep.txt": False, "a+b/c/last.txt": False, "aab/keep.txt": True}
    frame = spark.createDataFrame(rules, "folder string, layer int, place int, rule string")
    assert {r["path"]: r["ignored"] for r in ignore.ignored(spark.createDataFrame([(p,) for p in want], "path string"), frame).collect()} == want


def plain_convergence(events, rows, minutes):
    out = []
    for session in {e[2] for e in events}:
        own = sorted((e for e in events if e[2] == session), key=lambda e: (e[1], e[0]))
        for i, a in enumerate(own):
            if a[3] != "edit":
                continue
            c = next((k for k in range(i + 1, min(i + 1 + rows, len(own))) if own[k][3] == "no"), None)
            b = next((k for k in range(c + 1, min(c + 1 + rows, len(own))) if own[k][3] == "edit" and (not a[4] or own[k][4] == a[4])), None) if c else None
            if b and own[b][1] - a[1] <= minutes * 60_000_000:
                out.append((session, a[4], a[0], own[c][0], own[b][0], any(x[3] == "yes" for x in own[b + 1 : b + 1 + rows])))
    return sorted(out, key=str)


@pytest.mark.parametrize(("rows", "minutes"), [(6, 30), (2, 5)])
def test_convergence(spark, rows, minutes):
    rng = random.Random(rows)
    events = [(k, rng.randrange(300) * 60_000_000 // 3, k % 7, rng.choice(["edit", "edit", "no", "yes", "read"]), rng.choice(["f", "g", None])) for k in range(700)]
    df = spark.createDataFrame(events, "id bigint, ts_us bigint, session bigint, name string, file string")
    out = sequences.convergence(df, F.col("name") == "edit", F.col("name") == "no", F.col("name") == "yes", rows, minutes)
    ours = sorted(((r["session"], r["file"], r["first"], r["correction"], r["then"], r["positive"]) for r in out.collect()), key=str)
    assert ours == plain_convergence(events, rows, minutes) and ours


def test_repeated_needs_enough_within_the_time(spark):
    minute = 60_000_000
    events = [(k, t * minute, 1, "run") for k, t in enumerate((0, 1, 2, 60, 61, 62, 63, 200))] + [(90 + k, k * 11 * minute, 2, "run") for k in range(9)]
    df = spark.createDataFrame(events, "id bigint, ts_us bigint, session bigint, name string")
    assert [tuple(r) for r in sequences.repeated(df, F.col("name"), 4).collect()] == [(1, "run", 4, 60 * minute, 63 * minute)]
