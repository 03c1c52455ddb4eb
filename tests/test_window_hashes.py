"""Hashes of windows that are put together from those of shorter ones."""

import pytest
from pyspark.sql import functions as F

from sparquill.operators import relational as R


@pytest.mark.parametrize("k", [1, 2, 3, 7, 50])
def test_hashes_are_equal_where_windows_are(spark, k):
    texts = [(1, " ".join(str(i * i % 7) for i in range(120))), (2, " ".join(str(i % 3) for i in range(60)) + "\n\n x y"), (3, " ".join("a" * 50)), (4, "a b"), (5, ""), (6, None)]
    rows = R.line_windows(spark.createDataFrame(texts, "id int, content string").withColumn("lang", F.lit("en")), k).collect()
    by_text, by_hash = {}, {}
    for r in rows:
        tokens = dict(texts)[r["id"]].split()
        assert len(r["h"]) == len(r["g"]) == len(tokens) - k + 1 and len(r["line"]) == len(tokens)
        for i, pair in enumerate(zip(r["h"], r["g"], strict=True)):
            window = tuple(tokens[i : i + k])
            assert by_text.setdefault(window, pair) == pair and by_hash.setdefault(pair, window) == window
            assert pair[0] != pair[1]
    assert sorted(r["id"] for r in rows) == [i for i, t in texts if len((t or "").split()) >= k]
