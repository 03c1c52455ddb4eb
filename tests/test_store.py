"""The store's commits: reopening, two writers, stated versions, claims."""

import threading

import pytest
from pyspark.sql import functions as F

from sparquill.sources.store import Conflict, Folder, Store

TASKS = "id bigint, status string, owner string"


def tasks(spark, n=6):
    return spark.createDataFrame([(k, "pending", None) for k in range(n)], TASKS)


def state(store):
    return {r["id"]: (r["status"], r["owner"]) for r in store.current().collect()}


def test_a_store_that_is_opened_again_goes_on(spark, tmp_path):
    base, path = tasks(spark), str(tmp_path / "store")
    first = Store(base, ["id"], path=path)
    assert first.update(F.col("id") == 1, status=F.lit("done")) == 1
    again = Store(base, ["id"], path=path)
    assert again.version == 1 and state(again)[1] == ("done", None)
    assert again.update(F.col("id") == 2, status=F.lit("done")) == 1 and again.version == 2
    assert state(Store(base, ["id"], path=path)) == state(first) == {k: ("done" if k in (1, 2) else "pending", None) for k in range(6)}
    assert state(first) == {r["id"]: (r["status"], r["owner"]) for r in first.current(2).collect()}
    assert first.current(0).where("status = 'done'").count() == 0


def test_a_file_is_put_once(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/commits")
    assert folder.put_if_absent("1", "a") and not folder.put_if_absent("1", "b")
    assert folder.read("1") == "a" and folder.names() == ["1"]


def test_of_two_claims_one_wins(spark, tmp_path):
    base, path = tasks(spark), str(tmp_path / "store")
    got = {}

    def claim(agent):
        wanted = spark.createDataFrame([(k, agent) for k in range(6)], "id bigint, agent string")
        got[agent] = Store(base, ["id"], path=path).claim(wanted, F.col("status") == "pending", ["agent"], status=F.lit("claimed"), owner=F.col("agent"))

    threads = [threading.Thread(target=claim, args=(a,)) for a in ("x", "y", "z")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    owners = {o for _, o in state(Store(base, ["id"], path=path)).values()}
    assert sorted(got.values()) == [0, 0, 6] and owners == {a for a, n in got.items() if n}
    assert Store(base, ["id"], path=path).version == 3


def test_two_writers_lose_no_change(spark, tmp_path):
    base, path = spark.createDataFrame([(1, 0)], "id bigint, n bigint"), str(tmp_path / "store")

    def add():
        Store(base, ["id"], path=path).update(F.col("id") == 1, n=F.col("n") + 1)

    threads = [threading.Thread(target=add) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert Store(base, ["id"], path=path).current().first()["n"] == 4


def test_a_stale_version_is_refused(spark, tmp_path):
    base, path = tasks(spark), str(tmp_path / "store")
    one, two = Store(base, ["id"], path=path), Store(base, ["id"], path=path)
    seen = two.version
    one.update(F.col("id") == 0, status=F.lit("done"))
    with pytest.raises(Conflict):
        two.update(F.col("id") == 0, at=seen, status=F.lit("claimed"))
    assert two.update(F.col("id") == 1, at=two.version, status=F.lit("claimed")) == 1
    assert state(one)[0] == ("done", None) and state(one)[1] == ("claimed", None)


def test_claims_of_the_first_who_asks(spark, tmp_path):
    store = Store(tasks(spark), ["id"], path=str(tmp_path / "store"))
    wanted = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (3, 1, "only"), (77, 1, "nobody's")], "id bigint, asked int, agent string")
    free, values = F.col("status") == "pending", {"status": F.lit("claimed"), "owner": F.col("agent")}
    assert store.claim(wanted, free, ["asked"], **values) == 2
    assert store.claim(wanted, free, ["asked"], **values) == 0
    assert state(store)[1] == ("claimed", "early") and state(store)[3] == ("claimed", "only")


def test_deletions_replacements_and_null_keys(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (None, "n")]
    store = Store(spark.createDataFrame(rows, "id bigint, s string"), ["id"], "thing", path=str(tmp_path / "store"))
    assert store.delete(F.col("s") == "a", tombstone=True) == 1
    store.replace(F.col("s") == "b", spark.createDataFrame([(2, "c"), (3, "d")], "id bigint, s string"))
    assert store.update(F.col("s") == "n", s=F.lit("m")) == 1
    assert sorted(((r["id"], r["s"]) for r in store.current().collect()), key=str) == [(2, "c"), (3, "d"), (None, "m")]
    assert [(r["id"], r["kind"], r["version"]) for r in store.tombstones().collect()] == [(1, "thing", 1)]
    compacted = store.compact(str(tmp_path / "base"))
    assert compacted.version == 0 and compacted.current().count() == 3


def test_a_condition_reaches_the_scan_of_the_base(spark, tmp_path):
    spark.range(100).selectExpr("id", "'x' as s").write.parquet(str(tmp_path / "t"))
    store = Store(spark.read.parquet(str(tmp_path / "t")), ["id"], path=str(tmp_path / "store"))
    store.update(F.col("id") == 7, s=F.lit("y"))
    plan = store.current(where=F.col("id") == 9)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,9)" in plan
