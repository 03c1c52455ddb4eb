"""Removal of repeated byte strings by suffix arrays over shards.

A byte goes if it lies in a string of `length` bytes that also starts in a document with a smaller doc_id. Strings are
judged on the input, within documents, whole texts as UTF-8.

1. Anchors. Every window of `length` bytes has an anchor, its leftmost least k-mer by hash, so equal windows have equal
   anchors, and the windows of one anchor form a segment. An anchor that one document holds ends here: this is the filter
   that keeps most of the text out of the sort. A segment that several documents hold is sorted once, for the least of them;
   it covers the others, told by two 64-bit hashes (anchor and segment, at most 72 bytes; the chance of any error over 100 TB
   is below 1e-5).
2. Suffix arrays. Different segments around a shared anchor are the strings of a shard. All segments of an anchor lie in one
   shard, so shards need nothing of each other: induced sorting and permuted common prefixes put equal windows side by side,
   compared by their bytes, and the least document of a class covers the others.
3. An anchor with more segments than SPLIT (the end of a line that a third of all documents hold) is split over shards. The
   windows that no document of its own shard covers meet once more by their bytes, as an aggregate.

Exact copies of a text are found first, by digest, and covered whole by the copy with the least doc_id.

Null texts count as empty; rows without doc_id are left out; repeated rows get the same result (a doc_id covers nothing of
its own); texts shorter than `length` are kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix_array import common_prefixes, suffix_array

K = 28
POSITION = np.uint64((1 << 31) - 1)
BASE = 0x9E3779B97F4A7C15 | 1
ONE = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Bytes of text to a bucket, entries gathered before they are packed, packed rows in an Arrow batch.
BUCKET_BYTES, ENTRIES, PACKED_ROWS = 4_000_000, 300_000, 128
#: Bytes of segments to a suffix array, and open segments of an anchor above which they are split into several.
SHARD_BYTES, SPLIT = 250_000, 4_000


class Powers:
    """Powers of the hash base and of its inverse, as far as the longest text so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up), 1 << 16)
            inverse = pow(BASE, -1, 1 << 64)
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE, np.uint64)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]))


class Text:
    """Hashes of a text's substrings, and its segments: windows start..end (last start) share the anchor."""

    def __init__(self, data: bytes, length: int, powers: Powers):
        n = len(data)
        powers.reach(n + 1)
        self.length, self.down = length, powers.down
        b = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ONE[b] * powers.up[:n], out=self.sums[1:])
        grams = common.mix((self.sums[K:] - self.sums[: n - K + 1]) * powers.down[: n - K + 1])
        low = (grams & ~POSITION) | np.arange(n - K + 1, dtype=np.uint64)
        width, have = length - K + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        at = (low & POSITION).astype(np.int64)
        self.start = np.flatnonzero(np.diff(at, prepend=-1))
        self.end = np.concatenate([self.start[1:], [len(at)]]) - 1
        self.anchor = grams[at[self.start]]
        stop = self.end + length
        self.segment = common.mix((self.sums[stop] - self.sums[self.start]) * self.down[self.start] + (stop - self.start).astype(np.uint64))
        self.key = key_of(self.anchor, self.segment)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel()


PACK = "bucket int, keys binary, more binary, docs binary"
FIELDS = ["bucket", "keys", "more", "docs"]


def pack(bits: int, key: np.ndarray, more: np.ndarray, docs: np.ndarray, settled: bool = False) -> pa.RecordBatch:
    """Entries, one row for each bucket of the key's leading bits; settled ones have no second hash."""
    order = np.argsort(key, kind="stable")
    key, docs = key[order], docs[order]
    more = None if settled else more[order]
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(key)]])
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[i]) for i, _ in spans], pa.int32()),
            pa.array([key[i:j].tobytes() for i, j in spans], pa.binary()),
            pa.array([None if settled else more[i:j].tobytes() for i, j in spans], pa.binary()),
            pa.array([planes(docs[i:j]) for i, j in spans], pa.binary()),
        ],
        FIELDS,
    )


def key_of(anchor: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """One key for a segment within its document; the lowest bit is free."""
    return common.mix(anchor ^ (segment * np.uint64(3))) & ~np.uint64(1)


def mark(length: int, bits: int):
    """mapInArrow function: texts to packed (anchor, segment, document), the least document for each segment.

    Within what is gathered at a time the other documents of a segment are covered already and go by as settled, so an
    anchor that any number of documents hold adds a row for each gathering and not for each document.
    """

    def run(it):
        powers, held, size, seen = Powers(), [], 0, {}

        def emit():
            a, g, d = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((d, g, a))
            a, g, d = a[order], g[order], d[order]
            first = np.concatenate([[True], (a[1:] != a[:-1]) | (g[1:] != g[:-1])])
            yield pack(bits, a[first], g[first], d[first])
            if not first.all():
                yield pack(bits, key_of(a[~first], g[~first]), g, d[~first], settled=True)

        for b in common.slices(it):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                # of equal texts gathered at a time only ones with ever smaller ids count
                if len(data) < length or seen.get(same := hashlib.blake2b(data, digest_size=16).digest(), doc_id + 1) <= doc_id:
                    continue
                seen[same] = doc_id
                t = Text(data, length, powers)
                _, first = np.unique(t.key, return_index=True)
                held.append((t.anchor[first], t.segment[first], np.full(len(first), doc_id, np.int64)))
                size += len(first)
                if size >= ENTRIES:
                    yield from emit()
                    held, size, seen = [], 0, {}
        if held:
            yield from emit()

    return run


KEYS = "doc_id bigint, key bigint"


def keys_batch(docs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys.view(np.int64))], ["doc_id", "key"])


def settle(parts: list[tuple]):
    """A bucket's entries to the keys of covered and open segments."""
    a, g, d = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((d, g, a))
    a, g, d = a[order], g[order], d[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_g = new_a | np.concatenate([[True], g[1:] != g[:-1]])
    ga, low = least(new_a, d)
    high = np.maximum.reduceat(d, np.flatnonzero(new_a))
    gg, low_g = least(new_g, d)
    classes = np.bincount(ga[new_g])
    shared = (low != high)[ga]
    covered = shared & (d > low_g[gg])
    # the least document of a segment speaks for it; where an anchor has one segment nothing is open
    opened = shared & (classes[ga] > 1) & (d == low_g[gg])
    at = np.flatnonzero(covered | opened)
    if len(at):
        yield keys_batch(d[at], key_of(a[at], g[at]) | opened[at].astype(np.uint64))


def settle_segments(it):
    """mapInArrow function: (doc_id, key); the key's lowest bit is set where the segment is open, clear where covered."""
    now, parts = None, []
    for b in it:
        for bucket, keys, more, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if more is None:
                yield keys_batch(from_planes(docs), np.frombuffer(keys, np.uint64))
                continue
            if parts and bucket != now:
                yield from settle(parts)
                parts = []
            now = bucket
            parts.append((np.frombuffer(keys, np.uint64), np.frombuffer(more, np.uint64), from_planes(docs)))
    if parts:
        yield from settle(parts)


def least(new: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted groups that begin where new is True: each entry's group, and each group's least document."""
    group = np.cumsum(new) - 1
    return group, np.minimum.reduceat(docs, np.flatnonzero(new))


RESOLVED = "doc_id bigint, tag bigint, spans binary, anchor bigint, start bigint, segment binary"


def resolve(length: int):
    """mapInArrow function: documents and their keys to covered spans (one row each), and to open segments (anchor set)."""
    names = [x.split()[0] for x in RESOLVED.split(", ")]

    def run(it):
        powers = Powers()
        for b in common.slices(it):
            docs, opened = [], []
            for doc_id, tag, text, keys in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                t = Text(data, length, powers)
                known = np.sort(np.array(keys, np.int64).view(np.uint64))
                at = np.minimum(np.searchsorted(known, t.key), len(known) - 1)
                covered = known[at] == t.key
                at = np.minimum(np.searchsorted(known, t.key | np.uint64(1)), len(known) - 1)
                still = (known[at] == (t.key | np.uint64(1))) & ~covered
                if covered.any():
                    docs.append((doc_id, tag, np.array(merged(np.stack([t.start[covered], t.end[covered] + length], axis=1)), "<i8").tobytes()))
                for a, s, e in zip(t.anchor[still].view(np.int64).tolist(), t.start[still].tolist(), t.end[still].tolist(), strict=True):
                    opened.append((doc_id, tag, a, s, data[s : e + length]))
            d, o = list(zip(*docs, strict=True)) or [[]] * 3, list(zip(*opened, strict=True)) or [[]] * 5
            none = [pa.nulls(len(d[0]), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(d[0], pa.int64()), pa.array(d[1], pa.int64()), pa.array(d[2], pa.binary()), *none], names)
            yield pa.RecordBatch.from_arrays([pa.array(o[0], pa.int64()), pa.array(o[1], pa.int64()), pa.nulls(len(o[0]), pa.binary()), pa.array(o[2], pa.int64()), pa.array(o[3], pa.int64()), pa.array(o[4], pa.binary())], names)

    return run


SORTED = "doc_id bigint, tag bigint, spans binary, start bigint, window binary"


def sort_shard(rows: list[tuple], length: int):
    """Open segments (anchor, salt, doc_id, tag, start, segment, split) to the spans that smaller documents cover; windows of
    split anchors that no document of this shard covers go on whole."""
    # segments, each ended by a 1, bytes moved up by 2, and a last 0
    starts = np.cumsum([0] + [len(r[5]) + 1 for r in rows])
    t = np.frombuffer(b"\xff".join(r[5] for r in rows) + b"\xff\xff", np.uint8).astype(np.int64) + 2
    t[starts[1:] - 1] = 1
    t[-1] = 0
    owner = np.repeat(np.arange(len(rows)), np.diff(starts))
    window = np.zeros(len(t), bool)
    edges = np.zeros(len(t), np.int64)
    np.add.at(edges, starts[:-1], 1)
    np.add.at(edges, starts[1:] - length, -1)
    window = np.cumsum(edges) > 0
    sa = suffix_array(t, 258, apart=1)
    t[starts[1:] - 1] = 258 + np.arange(len(rows))
    shared = common_prefixes(t, sa, length)
    group = np.cumsum(shared[sa] < length)
    place, group = sa[window[sa]], group[window[sa]]
    doc = np.array([r[2] for r in rows], np.int64)[owner[place]]
    index, low = least(np.concatenate([[True], group[1:] != group[:-1]]), doc)
    covered = np.zeros(len(t), bool)
    covered[place[doc > low[index]]] = True
    out = []
    at = np.flatnonzero(covered)
    if len(at):
        # runs of covered windows within a segment
        new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
        first, last = at[new], at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        of = owner[first]
        base = np.array([r[4] for r in rows], np.int64)[of] - starts[of]
        pairs = np.stack([first + base, last + base + length], axis=1).astype("<i8")
        cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
        for i, j in zip(cuts, [*cuts[1:], len(of)], strict=True):
            r = rows[of[i]]
            out.append((r[2], r[3], pairs[i:j].tobytes(), None, None))
    for k, r in enumerate(rows):
        if r[6]:
            for p in range(len(r[5]) - length + 1):
                if not covered[starts[k] + p]:
                    out.append((r[2], r[3], None, r[4] + p, r[5][p : p + length]))
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 5, types, strict=True)], [x.split()[0] for x in SORTED.split(", ")])


def sort_shards(length: int):
    """mapInArrow function: open segments in the order of anchor and salt to covered spans and windows, in shards of whole groups."""

    def run(it):
        shard, size, now = [], 0, None
        for b in common.slices(it):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= SHARD_BYTES and row[:2] != now:
                    yield sort_shard(shard, length)
                    shard, size = [], 0
                now = row[:2]
                shard.append(row)
                size += len(row[5]) + 1
        if shard:
            yield sort_shard(shard, length)

    return run


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and adjacent spans as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in spans[np.argsort(spans[:, 0], kind="stable")].tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


REMOVED = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends."""
    out = []
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def remove(length: int, characters: bool = False):
    """mapInArrow function: texts, covered spans and places to what is removed and what is kept; the last column passes."""

    def run(it):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in common.slices(it):
            ids, sizes, spans, kept = [], [], [], []
            for doc_id, text, least_id, packed, places in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if len(data) >= length and least_id < doc_id:
                    cut = [(0, len(data))]
                else:
                    known = np.frombuffer(b"".join(packed or ()), "<i8").reshape(-1, 2)
                    more = np.array(places or [], np.int64)
                    cut = merged(np.concatenate([known, np.stack([more, more + length], axis=1)]))
                if characters:
                    cut = whole_characters(data, cut)
                ids.append(doc_id)
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in cut])
                at, left = 0, []
                for s, e in cut:
                    left.append(data[at:s])
                    at = e
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), b.column(5)], ["doc_id", "n_bytes", "spans", "kept", "row"])

    return run


def dedupe(docs: DataFrame, length: int = 50, characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes, start to end), kept (the remaining bytes) of every document.

    characters: leave characters that are covered only in part. carry: columns that come along in a struct `row`.
    """
    if length < K:
        raise ValueError(f"length has to be at least {K}")
    spark = docs.sparkSession
    work = common.Workspace(spark, "suffix-dedup")
    rows = common.texts(docs)
    tag = F.xxhash64("text")
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    known = rows.select("doc_id", digest.alias("digest"), tag.alias("tag"), F.octet_length("text").cast("bigint").alias("b"))
    copies = known.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.first("b").alias("b"))
    copies = work.table(copies, "copies")
    total = copies.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    bits = max(8, int(total // BUCKET_BYTES).bit_length())

    dealt = rows.mapInArrow(mark(length, bits), PACK).repartition("bucket").sortWithinPartitions("bucket")
    with common.batches_of(spark, PACKED_ROWS):
        keys = work.table(dealt.mapInArrow(settle_segments, KEYS), "keys")
    work.release()

    # only the first of equal texts is looked into; a document's keys are bounded by its own length
    firsts = copies.select(F.col("least_id").alias("doc_id")).distinct()
    asked = keys.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).join(firsts, "doc_id", "left_semi")
    looked = rows.select("doc_id", "text").join(asked, "doc_id").select("doc_id", tag.alias("tag"), "text", "keys")
    resolved = work.table(looked.mapInArrow(resolve(length), RESOLVED), "resolved")
    work.drop(keys)
    work.release()

    opened = resolved.where("anchor is not null").select("anchor", "doc_id", "tag", "start", "segment")
    many = work.table(opened.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT), "many")
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", "start"), F.expr(f"n div {SPLIT} + 1"))).cast("int")
    shards = opened.join(many, "anchor", "left").select("anchor", salt.alias("salt"), "doc_id", "tag", "start", "segment", F.col("n").isNotNull().alias("split"))
    shards = shards.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    sorted_ = work.table(shards.mapInArrow(sort_shards(length), SORTED), "sorted")
    work.release()

    # windows of split anchors meet by their bytes; a shard has sent one row for each window and least document
    windows = sorted_.where("window is not null").select("window", "doc_id", "tag", "start")
    firsts = windows.groupBy("window").agg(F.min("doc_id").alias("m"), F.max("doc_id").alias("most")).where("m < most")
    places = windows.join(firsts, "window").where("doc_id > m").groupBy("doc_id", "tag").agg(F.collect_set("start").alias("places"))
    found = resolved.where("anchor is null").select("doc_id", "tag", "spans").unionByName(sorted_.where("window is null").select("doc_id", "tag", "spans"))
    spans = found.groupBy("doc_id", "tag").agg(F.collect_list("spans").alias("packed")).join(places, ["doc_id", "tag"], "full")
    spans = work.table(spans, "spans")
    work.drop(resolved, sorted_, many)
    work.release()

    # the table of first copies is keyed by digest: documents meet it without their texts
    led = known.select("doc_id", "tag", "digest").distinct().join(copies.select("digest", "least_id"), "digest").select("doc_id", "tag", "least_id")
    facts = led.join(spans, ["doc_id", "tag"], "left")
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.lit(None).cast("int")
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), carried.alias("row")).where(F.col("doc_id").isNotNull())
    joined = whole.withColumn("tag", tag).join(facts, ["doc_id", "tag"]).select("doc_id", "text", "least_id", "packed", "places", "row")
    out = joined.mapInArrow(remove(length, characters), f"{REMOVED}, row {joined.schema['row'].dataType.simpleString()}")
    return out if carry else out.drop("row")
