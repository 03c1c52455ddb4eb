"""Windows that repeat lie in the stretches that are left; the others mostly go before any window is hashed."""

import random
from collections import Counter

import pytest

from sparquill.operators import relational as R


def left(spark, docs, k):
    """Places of the windows that are left, after a look at the tokens and lines of each stretch."""
    places = []
    lined = {i: [(t, n) for n, line in enumerate(c.split("\n"), 1) for t in line.split()] for i, _, c in docs}
    for r in R.repeated_stretches(spark.createDataFrame(docs, "id bigint, lang string, content string"), k).collect():
        assert [(x["t"], x["line"]) for x in r["s"]] == lined[r["id"]][r["skip"] : r["skip"] + len(r["s"])] and len(r["s"]) >= k
        places += [(r["id"], r["skip"] + j) for j in range(len(r["s"]) - k + 1)]
    assert len(places) == len(set(places))
    windows = {(i, j): tuple(t for t, _ in x[j : j + k]) for i, x in lined.items() for j in range(len(x) - k + 1)}
    n = Counter(windows.values())
    return set(places), {p for p, w in windows.items() if n[w] > 1}


@pytest.mark.parametrize("k", [1, 2, 3, 8, 13])
def test_all_windows_that_repeat_are_left(spark, k):
    rng = random.Random(k)
    docs = [(i, "en", "".join(f"{rng.choice('abcdef')}{rng.choice([' ', '  ', chr(10)])}" for _ in range(rng.randrange(60)))) for i in range(30)]
    docs += [(40, "en", "a " * 50), (41, "de", "a b c " * 20), (42, "de", "x y\nz " * k), (43, "en", ""), (44, "en", " ".join(map(str, range(90))))]
    docs += [(45, "en", docs[3][2] + "\nq\n" + docs[4][2])]
    kept, repeated = left(spark, docs, k)
    assert repeated and repeated <= kept


def test_windows_of_texts_that_share_little_go(spark):
    """Before, each of the 18,000 windows was hashed and shuffled."""
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    block = text(120)
    docs = [(i, "en", text(600) + ("\n" + block + "\n" + text(40) if i % 10 == 0 else "")) for i in range(30)]
    kept, repeated = left(spark, docs, 50)
    assert len(repeated) == 3 * 71 and repeated <= kept and len(kept) <= 3 * (71 + 2 * 25)
