"""Clustering around centroids, exact, with Yinyang bounds.

Centroids are put into groups once, by a few rounds of clustering among themselves. Every vector keeps an upper bound of the
distance to its centroid and one lower bound for each group: no other centroid of the group is nearer. When centroids move
the bounds move by as much. A vector whose upper bound lies below all its lower bounds stays (global filter); else the
distance to its own centroid is taken exactly, groups that still lie further away are passed over (group filter), and only
the centroids of the others are scanned, exactly. Bounds are floating-point numbers with a margin, distances are integers,
so the result is that of a full scan, ties included: the smaller number wins.

The vectors, their centroid and bounds are one table, rewritten in each round without a shuffle; sums by centroid meet
within tasks first, so a common vector or a large cluster is no hot key. The driver holds centroids and their sums alone.

Vectors of another length, null vectors, and those with a null or non-finite component are left out. Repeated rows each
count and get their row; a null id is kept. Where there are fewer vectors than centroids asked for, each starts one; equal
vectors may then leave centroids without rows, which stay where they are. An empty table gives an empty result. Components
too large for a squared distance within a long are computed with exact numbers of any size, and distances beyond a long
are given as its largest value. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONGEST = (1 << 63) - 1
#: Share and amount by which a bound has to be passed, far above the rounding of 64-bit floating-point numbers.
MARGIN = 1e-6
STATE = "vec_id bigint, v array<bigint>, cluster int, above double, below array<double>"


def scaled(components: str, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(components, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def kept(vectors: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """vec_id, v: whole vectors as integers."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    whole = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").where((F.size("embedding") == dimensions) & finite)
    return whole.select("vec_id", scaled("embedding", scale).alias("v"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exact: in longs where no sum can overflow, else in numbers of any size."""
    largest = max(int(abs(a).max(initial=0)) for a in (x, c))
    if largest >= 1 << 26:
        x, c = x.astype(object), c.astype(object)
    out = np.empty((len(x), len(c)), object if largest >= 1 << 26 else np.int64)
    for k in range(len(c)):
        d = x - c[k]
        out[:, k] = (d * d).sum(axis=1)
    return out


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


def group(centroids: np.ndarray, size: int = 10, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: about one group for `size` centroids, by clustering them; a bounded table."""
    t = max(1, -(-len(centroids) // size))
    at = centroids.astype(float)
    heads = at[np.linspace(0, len(at) - 1, t).astype(int)].copy()
    home = np.zeros(len(at), int)
    for _ in range(rounds):
        home = ((at[:, None] - heads[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(t):
            if (home == g).any():
                heads[g] = at[home == g].mean(axis=0)
    return np.unique(home, return_inverse=True)[1]


def first_assignment(x: np.ndarray, c: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, upper bound and lower bounds by a full scan."""
    d = squares(x, c)
    own = d.argmin(axis=1)  # the first of equal ones
    away = root(d)
    above = away[np.arange(len(x)), own]
    away[np.arange(len(x)), own] = np.inf
    below = np.stack([away[:, groups == g].min(axis=1) for g in range(groups.max() + 1)], axis=1)
    return own, above, below


def next_assignment(x, own, above, below, old: np.ndarray, c: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds after the centroids moved, and how many distances each vector needed."""
    moved = root(((c.astype(object) - old.astype(object)) ** 2).sum(axis=1)) * (1 + MARGIN)
    drift = np.array([moved[groups == g].max() for g in range(groups.max() + 1)])
    own, above, below = own.copy(), above + moved[own], np.maximum(0, below - drift)
    scans = np.zeros(len(x), np.int64)
    sure = lambda low, high: low > high * (1 + MARGIN) + MARGIN
    rows = np.flatnonzero(~sure(below.min(axis=1), above))  # global filter
    if not len(rows):
        return own, above, below, scans
    # distances by rows and centroids, -1 where none was taken
    took = np.full((len(rows), len(c)), -1, object if x.dtype == object else np.int64)
    for k in np.unique(own[rows]):
        at = own[rows] == k
        d = squares(x[rows[at]], c[k : k + 1])[:, 0]
        took = took if d.dtype == took.dtype else took.astype(object)
        took[at, k] = d
    scans[rows] += 1
    above[rows] = root(took[np.arange(len(rows)), own[rows]])
    for g in range(below.shape[1]):
        at = np.flatnonzero(~sure(below[rows, g], above[rows]))  # group filter
        if not len(at):
            continue
        members = np.flatnonzero(groups == g)
        d = squares(x[rows[at]], c[members])
        took = took if d.dtype == took.dtype else took.astype(object)
        took[np.ix_(at, members)] = d
        scans[rows[at]] += len(members)
    known = took >= 0
    best = np.where(known, took, LONGEST if took.dtype != object else took.max() + 1).argmin(axis=1)
    far = np.where(known, root(np.where(known, took, 0)), np.inf)
    above[rows] = far[np.arange(len(rows)), best]
    far[np.arange(len(rows)), best] = np.inf
    for g in range(below.shape[1]):
        nearest, whole = far[:, groups == g].min(axis=1), known[:, groups == g].all(axis=1)
        # a group that was passed over keeps its bound, unless the vector left a centroid of it
        below[rows, g] = np.where(whole, nearest, np.minimum(below[rows, g], nearest))
    own[rows] = best
    return own, above, below, scans


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel(), kind))


def assign(c: np.ndarray, groups: np.ndarray, old: np.ndarray | None):
    """mapInArrow function: vectors, with bounds from the second round on, to the next state."""

    def run(it):
        for b in common.slices(it, 4000):
            if not b.num_rows:
                continue
            x = matrix(b.column(1), c.shape[1])
            if old is None:
                own, above, below = first_assignment(x, c, groups)
            else:
                own, above, below, _ = next_assignment(x, b.column(2).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4), groups.max() + 1), old, c, groups)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(above), lists(below, pa.float64())], ["vec_id", "v", "cluster", "above", "below"])

    return run


def add_up(k: int, dimensions: int):
    """mapInArrow function: one row for each cluster a task has met: count and sums."""

    def run(it):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), object)
        for b in common.slices(it, 4000):
            own, x = b.column(1).to_numpy(), matrix(b.column(0), dimensions)
            if len(own) and abs(x).max(initial=0) >= 1 << 48:
                x = x.astype(object)
            for g in np.unique(own):
                n[g] += (own == g).sum()
                sums[g] += x[own == g].sum(axis=0).astype(object)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n[met]), pa.array([[str(s) for s in sums[g]] for g in met], pa.list_(pa.string()))], ["cluster", "n", "sums"])

    return run


def means(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The floor of the mean of each centroid's vectors; a centroid without any stays."""
    parts = state.select("v", "cluster").mapInArrow(add_up(*c.shape), "cluster int, n bigint, sums array<string>")
    summed = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = c.copy()
    for r in summed.collect():  # a row for each centroid and component
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def exact(c: np.ndarray):
    """mapInArrow function: the squared distance of each vector to its centroid."""

    def run(it):
        for b in common.slices(it, 4000):
            x, own = matrix(b.column(1), c.shape[1]), b.column(2).to_numpy()
            d = np.zeros(len(x), object)
            for k in np.unique(own):
                d[own == k] = squares(x[own == k], c[k : k + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([min(int(y), LONGEST) for y in d], pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int, rounds: int, dimensions: int, scale: int, seed: str) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance (squared) of every kept vector, and the centroids.

    Centroids start as the vectors whose `seed` and id have the smallest SHA-256, in that order.
    """
    spark = vectors.sparkSession
    work = common.Workspace(spark, "centroids")
    rows = kept(vectors, dimensions, scale)
    digest = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    start = rows.withColumn("digest", digest).orderBy(F.asc_nulls_last("digest"), "v").limit(k).select("v").collect()
    if not start:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), np.zeros((0, dimensions), np.int64)
    c = np.array([r["v"] for r in start], np.int64)
    groups = group(c)
    state = work.table(rows.mapInArrow(assign(c, groups, None), STATE), "state")
    for _ in range(rounds):
        old, c = c, means(state, c)
        before, state = state, work.table(state.mapInArrow(assign(c, groups, old), STATE), "state")
        work.drop(before)
    return work.table(state.select("vec_id", "v", "cluster").mapInArrow(exact(c), "vec_id bigint, cluster int, distance bigint"), "distances"), c


def digests(c: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c]


def with_inertia(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """The rows with the sums of distances of their cluster and of all, and the digest of their centroid."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    long = lambda n: min(n, LONGEST)
    known = spark.createDataFrame([(g, long(sums[g]), long(total), d) for g, d in enumerate(digests(c)) if g in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster")  # a row for each centroid
