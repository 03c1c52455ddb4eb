"""Toxicity scores after noisy-channel deobfuscation.

A character language model (trigrams over 28 symbols) is counted over all documents. A word that looks disguised (digits or
signs among letters, a letter three times in a row, letters set apart by blanks or dots) becomes a lattice: each character
may stand for itself or for the letters it is used to imitate, may repeat the one before it, or may be filler. The Viterbi
path under the channel's costs and the language model is the restored word. The score is a logistic regression over the
text's distinct words, restored ones among them, and their first 3 to 8 letters; it is fitted to labelled rows.

Null texts count as empty and get the score of texts without evidence; rows without doc_id are left out, repeated rows
each get their row, further columns are ignored, an empty table gives an empty result. Without labels there are no weights
and every score is the prior.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows the weights are fitted to, at most; chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Toxic rows that have to hold a feature, and their least share of all that hold it.
LEAST_ROWS, LEAST_SHARE = 3, 0.3
#: Ridge penalty, steps of the fit, weight of a toxic row.
RIDGE, STEPS, TOXIC_WEIGHT = 0.3, 300, 2.0
SYMBOLS = 28
OTHER = 27
#: The letters a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
FILLER = ".-_*'~^"
#: Log-probabilities of the channel.
SELF, SUBSTITUTE, REPEAT, DROP, KEEP_SIGN = -0.02, -1.0, -0.7, -1.2, -6.0

SPACED = re.compile(r"(?<![^\s])(?:[^\W\d_]|[013457@$!|+])([ .\-_*])(?:[^\W\d_]|[013457@$!|+])(?:\1(?:[^\W\d_]|[013457@$!|+]))+(?![^\s.,!?;:])")
RUN = re.compile(r"(.)\1\1")
EDGE = ".,!?;:\"()[]{}<>*#%&|~"


def symbol(c: str) -> int:
    """1 to 26 for a letter or its base letter, 27 for other letters and signs, 0 for blanks."""
    if c.isspace():
        return 0
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


TABLE = np.array([symbol(chr(i)) for i in range(0x250)], np.uint8)


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 0x250, TABLE[np.minimum(code, 0x24F)], OTHER).astype(np.int64)


def count_trigrams(it):
    """mapInArrow function: trigrams of symbols, counted over the task's texts."""
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in common.slices(it):
        for text in b.column(0).to_pylist():
            s = np.concatenate([[0, 0], symbols(text), [0]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])


class Restorer:
    """Viterbi decoder of single words, remembered up to a bound."""

    BOUND = 300_000

    def __init__(self, trigrams: np.ndarray):
        n = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        bi, uni = n.sum(axis=0), n.sum(axis=(0, 1))
        p1 = (uni + 1) / (uni.sum() + SYMBOLS)
        p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((n + 5 * p2[None]) / (n.sum(axis=2, keepdims=True) + 5)).tolist()
        self.kept: dict[str, str] = {}

    @staticmethod
    def suspicious(word: str) -> bool:
        if word.isalpha():
            return RUN.search(word) is not None
        return any(c.isalpha() for c in word) and any(c in LEET or c in FILLER for c in word.strip(EDGE)) or RUN.search(word) is not None and any(c.isalpha() for c in word)

    def options(self, word: str, i: int) -> list[tuple[str, float]]:
        c = word[i]
        out = [(c, SELF)] if c.isalpha() else [(c, KEEP_SIGN)]
        out += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if i and word[i - 1] == c:
            out.append(("", REPEAT))
        if c in FILLER:
            out.append(("", DROP))
        return out

    def decode(self, word: str) -> str:
        """The likeliest word behind the characters."""
        if (known := self.kept.get(word)) is not None:
            return known
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        log = self.log
        for i in range(len(word)):
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for out, cost in self.options(word, i):
                for (a, b), (p, path) in beam.items():
                    if out:
                        k = symbol(out)
                        state, q, way = (b, k), p + cost + log[a][b][k], (path, out)
                    else:
                        state, q, way = (a, b), p + cost, path
                    if state not in step or q > step[state][0]:
                        step[state] = (q, way)
            beam = step
        _, way = max(((p + log[a][b][0], path) for (a, b), (p, path) in beam.items()), key=lambda x: x[0])
        out = []
        while way:
            way, c = way
            out.append(c)
        word_out = "".join(reversed(out))
        if len(self.kept) < self.BOUND and len(word) <= 64:
            self.kept[word] = word_out
        return word_out

    def words(self, text: str) -> set[str]:
        """The text's distinct words, in lower case, disguised ones both as they are and restored."""
        text = text.lower()
        found = {w.strip(EDGE) for w in set(text.split())}
        more = set()
        for w in found:
            if self.suspicious(w):
                more.add(self.decode(w))
        for m in SPACED.finditer(text):
            more.add(self.decode("".join(c for c in m[0] if c not in " .-_*")))
        return (found | more) - {""}


def features(words: set[str]) -> set[str]:
    """Whole words, and their first 3 to 8 letters."""
    return {"=" + w for w in words} | {w[:k] for w in words for k in range(3, 9) if len(w) > k}


def count_evidence(trigrams: np.ndarray):
    """mapInArrow function: labelled texts to how many toxic and other ones hold each feature."""

    def run(it):
        restorer, counts = Restorer(trigrams), {}
        for b in common.slices(it):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in features(restorer.words(text)):
                    c = counts.setdefault(f, [0, 0])
                    c[1 - toxic] += 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64())], ["feature", "toxic", "other"])

    return run


def hold_evidence(trigrams: np.ndarray, names: dict[str, int]):
    """mapInArrow function: labelled texts to the numbers of the features they hold."""

    def run(it):
        restorer = Restorer(trigrams)
        for b in common.slices(it):
            held = [sorted(names[f] for f in features(restorer.words(x)) if f in names) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(held, pa.list_(pa.int32()))], ["label", "held"])

    return run


def logistic(rows: list[tuple[int, list[int]]], n: int) -> tuple[np.ndarray, float]:
    """Weights of n features and an intercept by accelerated gradient steps on the penalised likelihood.

    Plain array sums on purpose: threaded linear algebra can stall in a driver that has started Spark.
    """
    rows = sorted((y, tuple(h)) for y, h in rows)
    y = np.array([y for y, _ in rows], float)
    sizes = np.array([len(h) for _, h in rows])
    if not len(rows) or not n:
        return np.zeros(n), PRIOR
    # the intercept is a feature that every row holds and that isn't penalised
    feature = np.fromiter((f for _, h in rows for f in (*h, n)), np.int64, int(sizes.sum()) + len(rows))
    row = np.repeat(np.arange(len(rows)), sizes + 1)
    weight, ridge = np.where(y > 0, TOXIC_WEIGHT, 1.0), np.append(np.full(n, RIDGE), 0.0)
    times = lambda v: np.bincount(row, weights=v[feature], minlength=len(rows))
    back = lambda z: np.bincount(feature, weights=z[row], minlength=n + 1)
    # the largest curvature, by power iteration on a matrix without negative entries
    u, most = np.ones(n + 1), 1.0
    for _ in range(30):
        u = back(0.25 * weight * times(u))
        most = float(np.sqrt((u * u).sum()))
        u /= most
    rate = 1 / (1.1 * most + RIDGE)
    w = v = np.append(np.zeros(n), PRIOR)
    t, last = 1.0, np.inf
    for _ in range(STEPS):
        z = times(v)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + (ridge * v * v).sum() / 2)
        after = v - rate * (back(weight * (p - y)) + ridge * v)
        t, before = (1.0, 1.0) if loss > last else ((1 + math.sqrt(1 + 4 * t * t)) / 2, t)  # too far: start again from here
        v, w, last = after + (before - 1) / t * (after - w), after, loss
    return w[:n], float(w[n])


def train_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, *columns: str) -> DataFrame:
    """text, label of at most `rows` labelled documents outside the held-out fold, the same ones at every run."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out())
    picked = known.orderBy(F.xxhash64("doc_id"), "label").limit(rows)
    # at most `rows` pairs of numbers, so the broadcast is bounded
    return common.texts(docs).join(F.broadcast(picked), "doc_id").select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """Trigrams of all texts, and weights of features fitted to labelled ones.

    What comes to the driver is counts of trigrams, the features that enough toxic rows of the sample hold, and for each row
    of the sample which of these it holds.
    """
    counted = common.texts(docs).select("text").mapInArrow(count_trigrams, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    trigrams = np.zeros(SYMBOLS**3, np.int64)
    for r in counted:
        trigrams[r["code"]] = r["n"]
    sample = train_sample(docs, labels, "toxic", rows)
    seen = sample.mapInArrow(count_evidence(trigrams), "feature string, toxic bigint, other bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    kept = seen.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("other")))).orderBy("feature").select("feature").collect()
    names = {r["feature"]: k for k, r in enumerate(kept)}
    held = sample.mapInArrow(hold_evidence(trigrams, names), "label int, held array<int>").collect() if names else []
    w, b = logistic([(r["label"], r["held"]) for r in held], len(names))
    return {"trigrams": trigrams, "weights": {f: float(w[k]) for f, k in names.items() if w[k]}, "intercept": b}


#: Log-odds of a text where nothing was learnt.
PRIOR = -2.5


class Scorer:
    """Scores texts; what the model knows of a word is remembered, up to a bound."""

    def __init__(self, model: dict):
        self.restorer, self.weights, self.intercept, self.known = Restorer(model["trigrams"]), model["weights"], model["intercept"], {}

    def of(self, word: str) -> tuple:
        if (known := self.known.get(word)) is None:
            known = tuple(f for f in features({word}) if f in self.weights)
            if len(self.known) < Restorer.BOUND and len(word) <= 64:
                self.known[word] = known
        return known

    def score(self, text: str) -> float:
        held = {f for w in self.restorer.words(text) for f in self.of(w)}
        z = self.intercept + sum(self.weights[f] for f in sorted(held))
        return 1 / (1 + math.exp(-max(-500.0, min(z, 500.0))))


def score_texts(model: dict):
    """mapInArrow function: text to score."""

    def run(it):
        scorer = Scorer(model)
        for b in common.slices(it):
            s = [scorer.score(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return run


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every document."""
    return common.texts(docs).mapInArrow(score_texts(model), "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold."""

    def run(it):
        scorer = Scorer(model)
        for b in common.slices(it):
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([scorer.score(x or "") < threshold for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
