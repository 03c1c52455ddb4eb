"""Quality scores of a factorisation machine.

A document's features are its hashed words, statistics of its structure and its size. Pairs of features interact through
low-rank vectors; by the sum-of-squares identity a text is scored in time linear in its features. The machine is fitted
with AdaGrad on the driver, on a bounded sample of labelled rows.

Null texts count as empty and are scored by their statistics alone; rows without doc_id are left out, repeated rows each
get their row, further columns are ignored, an empty table gives an empty result. Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .toxicity import train_sample

#: Labelled rows of the fit, at most; hashed word features; statistics; rank; passes over the sample.
TRAIN_ROWS, WORDS, STATS, RANK, PASSES = 12_000, 1 << 13, 24, 6, 4


def statistics(text: str, words: list[bytes], h: np.ndarray) -> np.ndarray:
    """Structure and size of a text, each about 0 to 1."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = max(1, len(b)), max(1, len(words))
    c = np.bincount(b, minlength=256) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = text.split("\n")
    distinct = len(np.unique(h)) / m
    runs = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    ends = sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines)
    signs = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    upper, lower, digits = c[65:91].sum(), c[97:123].sum(), c[48:58].sum()
    pairs = len(np.unique(h[:-1] ^ (h[1:] * np.uint64(3)))) / max(1, len(h) - 1) if len(h) > 1 else 1.0
    return np.array(
        [
            1.0, np.log1p(n) / 12, np.log1p(m) / 10, lengths.mean() / 12, min(4.0, lengths.std() / 6), min(4.0, lengths.max() / 40),
            distinct, pairs, runs, len(set(lines)) / len(lines), np.log1p(len(lines)) / 6, ends,
            min(4.0, 10 * signs), min(4.0, upper / max(1e-9, upper + lower)), min(4.0, 10 * digits), c[128:].sum(),
            min(4.0, 20 * c[33]), min(4.0, 20 * (c[35] + c[36] + c[37] + c[38] + c[42])), min(4.0, 20 * c[124]), min(4.0, 20 * (c[60] + c[62] + c[123] + c[125])),
            min(4.0, 50 * c[47]), min(4.0, 50 * c[64]), float(n < 100), float(m < 5),
        ]
    )


def featurise(text: str, hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: the statistics first, then the distinct hashed words, scaled to unit length."""
    words = common.lower_words(text)
    h = hashes.of(words)
    at = np.unique(h % np.uint64(WORDS)).astype(np.int64) + STATS
    return np.concatenate([np.arange(STATS), at]), np.concatenate([statistics(text, words, h), np.full(len(at), 1 / np.sqrt(max(1, len(at))))])


def raw(w: np.ndarray, v: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The machine's value and the sums its gradient needs."""
    vx = v[i] * x[:, None]
    s = vx.sum(axis=0)
    return float(w[i] @ x + 0.5 * (s @ s - (vx * vx).sum())), s


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES, rank: int = RANK, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    w, v = np.zeros(STATS + WORDS), rng.normal(0, 0.02, (STATS + WORDS, rank))
    gw, gv = np.full(len(w), 1e-2), np.full(v.shape, 1e-2)
    for _ in range(passes):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            z, s = raw(w, v, i, x)
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            dw = g * x + decay * w[i]
            dv = g * (x[:, None] * s - v[i] * (x * x)[:, None]) + decay * v[i]
            gw[i] += dw * dw
            gv[i] += dv * dv
            w[i] -= rate * dw / np.sqrt(gw[i])
            v[i] -= rate * dv / np.sqrt(gv[i])
    return {"w": w, "v": v}


def featurise_labelled(it):
    """mapInArrow function: labelled texts to sparse features."""
    hashes = common.WordHashes()
    for b in it:
        rows = [featurise(x, hashes) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([i.astype("<u2").tobytes() for i, _ in rows], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in rows], pa.binary()), b.column(1)], ["i", "x", "label"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    sample = train_sample(docs, labels, "quality", rows).mapInArrow(featurise_labelled, "i binary, x binary, label int").collect()
    sample = sorted((bytes(r["i"]), bytes(r["x"]), r["label"]) for r in sample)
    return fit_machine([(np.frombuffer(i, "<u2").astype(np.int64), np.frombuffer(x, "<f4").astype(float), y) for i, x, y in sample])


def score_texts(model: dict):
    """mapInArrow function: text to score."""

    def run(it):
        hashes = common.WordHashes()
        for b in common.slices(it):
            z = np.array([raw(model["w"], model["v"], *featurise(x, hashes))[0] for x in b.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every document."""
    return common.texts(docs).mapInArrow(score_texts(model), "doc_id bigint, score double")
