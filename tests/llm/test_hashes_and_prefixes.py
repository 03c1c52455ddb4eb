"""Anchors of windows and common prefixes against plain versions."""

import time

import numpy as np

from sparquill.llm import common
from sparquill.llm.suffix_array import common_prefixes, suffix_array
from sparquill.llm.suffix_dedup import K, ONE, BASE, Powers, Text


def test_anchor_is_the_least_gram_of_its_windows():
    data = bytes(np.random.default_rng(3).integers(97, 100, 400, np.uint8))
    t = Text(data, 50, Powers())
    grams = []
    for i in range(len(data) - K + 1):
        grams.append(sum(int(ONE[c]) * pow(BASE, j, 1 << 64) for j, c in enumerate(data[i : i + K])) % (1 << 64))
    grams = common.mix(np.array(grams, np.uint64))
    low = [min(grams[i : i + 50 - K + 1] >> np.uint64(31)) for i in range(len(data) - 49)]
    for anchor, s, e in zip(t.anchor, t.start, t.end, strict=True):
        assert {anchor >> np.uint64(31)} == set(low[s : e + 1])


def test_common_prefixes_take_few_rounds():
    """With few positions to a round, the calls and not the bytes took the time before."""
    rng = np.random.default_rng(5)
    t = np.append(np.concatenate([rng.permutation(np.tile(rng.integers(1, 5, 40), 3)) for _ in range(300)]), 0)
    sa = suffix_array(t, 5)
    want = np.zeros(len(t), np.int64)
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        while want[b] < 50 and t[a + want[b]] == t[b + want[b]]:
            want[b] += 1
    took = {}
    for stride in (1, 16, 64):
        assert (common_prefixes(t, sa, 50, stride) == want).all()
        took[stride] = min(_timed(common_prefixes, t, sa, 50, stride) for _ in range(5))
    assert (common_prefixes(t, sa, 50) == want).all()
    assert took[16] < took[64]


def _timed(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began
