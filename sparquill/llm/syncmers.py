"""Document fingerprints from closed syncmers.

A k-mer of the text's UTF-8 bytes is an anchor if its smallest s-mer is its first or its last one. Whether it is depends on
the k-mer alone, so equal passages have equal anchors wherever they stand. The anchors' hashes are spread over bins and
each bin keeps its smallest; the fingerprint is the bins' low bytes in hexadecimal, 00 for a bin without anchor. The
likeness of two fingerprints is the share of common anchors (Dice), estimated from the bins.

Texts shorter than a k-mer have all their 3-byte strings (a shorter one itself) as anchors; the empty text has none and is like empty texts only. Null
texts count as empty, rows without doc_id are left out, repeated rows each get their row in the order of their text,
further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, S, BINS = 14, 5, 128


def anchors(data: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers, in order; texts shorter than k have all their 3-byte strings instead."""
    if len(data) < k:
        m = min(3, len(data))
        at = np.arange(len(data) - m + 1 if data else 0)
        return at, np.array([xxhash.xxh3_64_intdigest(data[i : i + m]) for i in at], np.uint64)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = len(b) - s + 1
    small = np.zeros(n, np.uint64)
    for j in range(s):
        small = (small << np.uint64(8)) | b[j : n + j]
    small = common.mix(small)
    width = k - s + 1
    low, have = small, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    at = np.flatnonzero((small[: len(low)] == low) | (small[width - 1 :] == low))
    h = np.zeros(len(at), np.uint64)
    for j in range(0, k - s, s):
        h = common.mix(h ^ small[at + j])
    return at, common.mix(h ^ small[at + k - s])


def fingerprint(data: bytes, bins: int = BINS) -> str:
    """Hexadecimal fingerprint, two digits a bin."""
    _, h = anchors(data)
    h = np.sort(h)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    bucket = (h >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    out = np.zeros(bins, np.uint8)
    out[bucket[first]] = (common.mix(h[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    filled = int(((x > 0) | (y > 0)).sum())
    same = int(((x == y) & (x > 0)).sum())
    j = max(0.0, (same / filled - 1 / 255) / (1 - 1 / 255)) if filled else 1.0
    return 2 * j / (1 + j)


def matches(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Positions in a and b of anchors that both hold once."""
    (p, g), (q, h) = anchors(a), anchors(b)
    own = [dict(zip(*np.unique(x, return_counts=True), strict=True)) for x in (g, h)]
    where = {int(v): int(i) for i, v in zip(q, h, strict=True) if own[1][v] == 1}
    return [(int(i), where[int(v)]) for i, v in zip(p, g, strict=True) if own[0][v] == 1 and int(v) in where]


SCHEMA = "kind int, part int, doc_id bigint, text string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(doc_id: int, text: str, own: str, after: str, after_print: str) -> tuple:
    """The result row of a document, given its follower."""
    half = len(text) // 2
    edited = (text[: len(text) - half] + after[:half]).encode("utf-8", "surrogatepass")
    changed = fingerprint(edited)
    return (0, 0, doc_id, None, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, after_print))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def sweep(it):
    """mapInArrow function over a range of documents in order: a row for each but the last, and the first and last texts."""
    part, last, rows, first = TaskContext.get().partitionId(), None, [], True
    for b in it:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = fingerprint(text.encode("utf-8", "surrogatepass"))
            if first:
                rows.append((1, part, doc_id, text, None, None, own, None, None, None))
                first = False
            else:
                rows.append(compared(*last, text, own))
            last = (doc_id, text, own)
            if len(rows) >= 2000:
                yield to_batch(rows)
                rows = []
    if last:
        rows.append((2, part, last[0], last[1], None, None, last[2], None, None, None))
    if rows:
        yield to_batch(rows)


def borders(it):
    """mapInArrow function: the last document of a range and the first of the next."""
    for b in it:
        rows = [compared(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            yield to_batch(rows)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, beside that of its edited text and that of the next document by doc_id."""
    spark = docs.sparkSession
    work = common.Workspace(spark, "fingerprints")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = common.texts(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    found = work.table(ordered.mapInArrow(sweep, SCHEMA), "rows")
    held = [r["part"] for r in found.where("kind = 1").select("part").orderBy("part").collect()]
    after = spark.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "part int, next int")
    tails = found.where("kind = 2").select("part", "doc_id", "text", F.col("fingerprint").alias("own")).join(after, "part")
    heads = found.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    ends = tails.join(heads, "next").select("doc_id", "text", "own", "after", "after_print").mapInArrow(borders, SCHEMA)
    return found.where("kind = 0").unionByName(ends).drop("kind", "part", "text")
