from pyspark.sql import functions as F

from sparquill.functions import scalars as S
from sparquill.operators import relational as R


def test_command_signature(spark):
    rows = [("FOO=1 /usr/bin/grep  x > out | sort",), ("ls",)]
    out = spark.createDataFrame(rows, "c string").select(S.command_signature(F.col("c")).alias("s")).collect()
    assert [r["s"] for r in out] == ["grep x | sort", "ls"]


def test_capped_limits(spark):
    df = spark.range(2000)
    assert R.capped(df, 0).count() == 1000
    assert R.capped(df, 7).count() == 7
    assert R.capped(df, -1).count() == 2000


def test_last_write_wins_and_ties(spark):
    a = spark.createDataFrame([(1, 5, "a"), (2, 1, "a")], "id int, v int, s string")
    b = spark.createDataFrame([(1, 5, "b"), (2, 2, "b"), (3, 0, "b")], "id int, v int, s string")
    out = {r["id"]: (r["v"], r["s"]) for r in R.last_write_wins(a, b, "id", "v", ["s"]).collect()}
    assert out == {1: (5, "a"), 2: (2, "b"), 3: (0, "b")}


def test_densest_window_counts_peers(spark):
    df = spark.createDataFrame([("k", t) for t in (1, 5, 5, 9, 40)], "k string, t bigint")
    r = R.densest_window(df, ["k"], "t", 8, 2).collect()[0]
    assert (r["n"], r["window_end"]) == (4, 9)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, t bigint")
    assert R.densest_window(df, ["k"], "t", 8, 2).count() == 0
    assert R.islands(df, ["k"], "t", 3).count() == 0


def test_budget_keeps_the_first_row(spark):
    df = spark.createDataFrame([("a", 1, 50), ("a", 2, 1), ("b", 1, 3), ("b", 2, 4), ("b", 3, 9)], "g string, r int, c int")
    out = R.within_budget(df, ["g"], ["r"], "c", 10)
    assert sorted((r["g"], r["r"]) for r in out.collect()) == [("a", 1), ("b", 1), ("b", 2)]


def test_glob():
    import re

    assert re.match(S.glob_to_regex("a*c").replace("\\Q", "").replace("\\E", ""), "abbc")


def test_budget_stops_at_the_first_refusal_in_any_partition(spark):
    rows = [("a", k, c) for k, c in enumerate([5, 100, 1, 1, 0, 2])] + [("b", k, 1) for k in range(40)]
    want = [("a", 0)] + [("b", k) for k in range(10)]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "g string, r int, c int").repartition(parts)
        assert sorted((r["g"], r["r"]) for r in R.within_budget(df, ["g"], ["r"], "c", 10).collect()) == want


def test_regions_break_in_either_dimension(spark):
    df = spark.createDataFrame([("k", a, b) for a, b in ((1, 1), (3, 4), (4, 2), (5, 3), (20, 4))], "k string, a int, b int")
    out = sorted((r["a_from"], r["a_to"], r["b_from"], r["b_to"], r["n"]) for r in R.regions(df, ["k"], "a", "b", 5).collect())
    assert out == [(1, 3, 1, 4, 2), (4, 5, 2, 3, 2), (20, 20, 4, 4, 1)]
