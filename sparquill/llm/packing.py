"""Packing of tokenised documents into sequences of bounded length by cutting-stock column generation.

Every document is cut into full pieces of `length` tokens and one rest. Full pieces are sequences of their own. The rests
are counted in classes of `grain` tokens; a linear program over patterns (how many rests of which class share a sequence)
is solved by column generation, a knapsack recurrence pricing new patterns; the counts of patterns are rounded down and the
few rests left over are packed one sequence at a time, each as full as can be. Documents are ranked within their class and take the slots that
the plan has for their rank. The histogram, and so all that the driver sees, has `length / grain` entries at any size.

Null texts count as empty (one token, the end mark), rows without doc_id are left out, repeated rows are packed once each,
further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokenizing

#: The linear program counts as solved once no plan can need fewer sequences by more than this share (Farley's bound).
GAP = 1e-3


def encode_ids(name: str, where: str | None, end_id: int):
    """mapInArrow function: text to its ids and the end mark, 2 bytes an id where all fit, else 4."""
    def run(it):
        enc = tokenizing.encoder(name, where)
        # a last byte tells the two widths apart
        last = np.array([end_id], f"<u{enc.width}").tobytes() + str(enc.width).encode()
        for b in common.slices(it, keep=True):
            ids = [enc.packed(x) + last for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "ids"])

    return run


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of largest value within the room, any number of copies of a size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = sizes <= c
        if fit.any():
            gain = np.where(fit, values + best[np.maximum(c - sizes, 0)], -1.0)
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], took[c] = gain[k], k
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[room]), pattern


def fill(left: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The fullest sequence around the largest item left, with no more items of a size than are left."""
    top = int(np.flatnonzero(left)[-1])
    pattern = np.zeros(len(sizes), np.int64)
    pattern[top] = 1
    space = room - int(sizes[top])
    by = np.full(space + 1, -1)
    by[0] = -2
    for i in np.flatnonzero(left)[::-1]:
        s = int(sizes[i])
        for _ in range(min(int(left[i] - pattern[i]), space // s)):
            reached = by > -1
            reached[0] = True
            new = np.flatnonzero(reached[: space + 1 - s]) + s
            new = new[by[new] == -1]
            if not len(new):
                break
            by[new] = i
        if by[space] != -1:
            break
    c = int(np.flatnonzero(by != -1)[-1])
    while c:
        pattern[by[c]] += 1
        c -= int(sizes[by[c]])
    return pattern


def greedy(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A first basis: fill a sequence around the largest size left, repeat it until a size is used up, and so on.

    Each pattern uses up a size that no later pattern has, so the basis is triangular.
    """
    m = len(sizes)
    left, patterns, times, order = demand.astype(float), [], [], []
    alive = np.ones(m, bool)
    while alive.any():
        top = int(np.flatnonzero(alive)[-1])
        own = np.flatnonzero(alive)
        _, fill = knapsack(sizes[own] * (1 + 1e-3 * sizes[own]), sizes[own], room - int(sizes[top]))
        pattern = np.zeros(m, np.int64)
        pattern[own] = fill
        pattern[top] += 1
        used = np.flatnonzero(pattern)
        out = int(used[np.argmin(left[used] / pattern[used])])
        x = left[out] / pattern[out]
        left -= x * pattern
        left[out], alive[out] = 0, False
        patterns.append(pattern)
        times.append(x)
        order.append(out)
    return patterns, np.array(times), inverse_of(np.array(patterns, float)[:, order].T, order)


def inverse_of(lower: np.ndarray, order: list[int]) -> np.ndarray:
    """Inverse of a lower triangular matrix by substitution, its columns then put back in the order of the sizes.

    Plain array sums on purpose: threaded linear algebra can stall in a driver that has started Spark.
    """
    m = len(lower)
    inverse = np.zeros((m, m))
    for i in range(m):
        row = -(lower[i, :i, None] * inverse[:i]).sum(axis=0)
        row[i] += 1
        inverse[i] = row / lower[i, i]
    out = np.empty((m, m))
    out[:, order] = inverse
    return out


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold every item exactly once."""
    m = len(sizes)
    if not m:
        return []
    patterns, x, inverse = greedy(sizes, demand, room)
    while True:
        # the dual bound is the present number of sequences divided by the value of the best pattern
        value, pattern = knapsack(inverse.sum(axis=0), sizes, room)
        if value <= 1 + gap:
            break
        used = np.flatnonzero(pattern)
        u = (inverse[:, used] * pattern[used]).sum(axis=1)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = x - theta * u
        x[out] = theta
        row = inverse[out] / u[out]
        inverse = inverse - np.outer(u, row)
        inverse[out] = row
        patterns[out] = pattern
    plan, left = [], demand.astype(np.int64).copy()
    for pattern, times in zip(patterns, np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64), strict=True):
        if times:
            times = min(int(times), *[int(left[i] // pattern[i]) for i in np.flatnonzero(pattern)])
        if times > 0:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern = fill(left, sizes, room)
        times = min(int(left[i] // pattern[i]) for i in np.flatnonzero(pattern))
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def slots(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> dict[int, np.ndarray]:
    """For each class: rows of first rank, first sequence, copies in a sequence, first slot there."""
    table: dict[int, list] = {int(s): [] for s in sizes}
    ranks = dict.fromkeys(table, 0)
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            s, copies = int(sizes[i]), int(pattern[i])
            table[s].append((ranks[s], sequence, copies, slot))
            ranks[s] += copies * times
            slot += copies
        sequence += times
    return {s: np.array(rows, np.int64).reshape(-1, 4) for s, rows in table.items()}


def assign(table: dict[int, np.ndarray]):
    """mapInArrow function: class and rank to sequence and slot."""

    def run(it):
        for b in it:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            seq, slot = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at, rows = np.flatnonzero(size == s), table[int(s)]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                inside = rank[at] - rows[k, 0]
                seq[at] = rows[k, 1] + inside // rows[k, 2]
                slot[at] = rows[k, 3] + inside % rows[k, 2]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seq), pa.array(slot)], ["uid", "rest", "sequence_id", "slot"])

    return run


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut(length: int):
    """mapInArrow function: a document's ids and places to its pieces."""

    def run(it):
        names = [x.split()[0] for x in PIECES.split(", ")]
        for b in common.slices(it):
            doc_id, n, packed, n_full, rest, full_sequence, sequence, offset = b.columns
            full, rest = n_full.to_numpy(), rest.to_numpy()
            count = full + (rest > 0)
            of = np.repeat(np.arange(len(count)), count)
            k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            last = k == full[of]
            start = k * length
            size = np.where(last, rest[of], length)
            there = np.where(last, sequence.fill_null(0).to_numpy()[of], full_sequence.to_numpy()[of] + k)
            at = np.where(last, offset.fill_null(0).to_numpy()[of], 0)
            whole = [np.frombuffer(x, "<u2", len(x) // 2).astype("<u4").tobytes() if x[-1:] == b"2" else x for x in packed.to_pylist()]
            ids = [whole[i][s * 4 : (s + m) * 4] for i, s, m in zip(of.tolist(), start.tolist(), size.tolist(), strict=True)]
            columns = [doc_id.to_numpy()[of], start, size, pa.array(ids, pa.binary()), n.to_numpy()[of], there, at]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in columns], names)

    return run


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", where: str | None = None, length: int = 1024, grain: int = 4, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    work = common.Workspace(spark, "packing")
    encoded = common.texts(docs).mapInArrow(encode_ids(tokenizer, where, end_id), "doc_id bigint, doc_tokens bigint, ids binary")
    encoded = work.table(encoded.withColumn("uid", F.monotonically_increasing_id()), "ids")

    rows = encoded.count()
    # one row for each salt comes to the driver: one for a million documents
    salts = max(16, -(-rows // 1_000_000))
    light = encoded.select(
        "uid",
        F.expr(f"doc_tokens div {length}").alias("n_full"),
        (F.col("doc_tokens") % length).alias("rest"),
        F.pmod(F.xxhash64("uid"), F.lit(salts)).alias("salt"),
    ).withColumn("size", F.ceil(F.col("rest") / grain).cast("bigint"))
    # ranks within a class: base of the salt, then row number inside; a class that holds most rows is split by salt
    within = Window.partitionBy("salt", "size").orderBy("uid")
    before = Window.partitionBy("salt").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = light.withColumn("full_before", F.coalesce(F.sum("n_full").over(before), F.lit(0))).withColumn("rank", F.row_number().over(within).cast("bigint") - 1)
    counts = light.groupBy("salt", "size").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full"))
    bases = counts.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).select("salt", "size", "base")
    full_bases = counts.groupBy("salt").agg(F.sum("n_full").alias("s"))
    full_of = {r["salt"]: r["s"] for r in full_bases.collect()}
    histogram = {r["size"]: r["n"] for r in counts.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}

    sizes = np.array(sorted(histogram), np.int64)
    plan = solve(sizes, np.array([histogram[int(s)] for s in sizes], np.int64), length // grain)
    table = slots(plan, sizes)
    first_full = sum(t for _, t in plan)

    total, starts = first_full, []
    for salt in sorted(full_of):
        starts.append((salt, total))
        total += full_of[salt]
    full_start = spark.createDataFrame(starts or [(0, 0)], "salt bigint, full_start bigint")
    placed = ranked.join(bases, ["salt", "size"]).join(full_start, "salt").withColumn("rank", F.col("rank") + F.col("base")).withColumn("full_sequence", F.col("full_start") + F.col("full_before"))
    placed = work.table(placed.select("uid", "n_full", "rest", "size", "rank", "full_sequence"), "ranks")
    rests = placed.where("rest > 0").select("uid", "rest", "size", "rank").mapInArrow(assign(table), "uid bigint, rest bigint, sequence_id bigint, slot bigint")
    there = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("rest").over(there), F.lit(0))).select("uid", "sequence_id", "offset")

    pieces = encoded.join(placed.select("uid", "n_full", "rest", "full_sequence").join(rests, "uid", "left"), "uid")
    return pieces.select("doc_id", "doc_tokens", "ids", "n_full", "rest", "full_sequence", "sequence_id", "offset").mapInArrow(cut(length), PIECES)
