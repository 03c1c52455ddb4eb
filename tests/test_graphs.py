from sparquill.operators import graphs


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (9, 10), (10, 11), (11, 9), (5, 9)]
    out = graphs.strong_components(spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {(r["node"], r["component"]) for r in out.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9), (10, 9), (11, 9)}
