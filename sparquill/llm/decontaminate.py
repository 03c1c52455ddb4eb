"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents may be long, so the likeness of whole sets says nothing. Items are partitioned by the size
of their shingle set, in powers of two; for each partition a document is cut into windows of twice that many shingles that
overlap by half, and items and windows get MinHash signatures. A window that agrees with an item in any slot is a
candidate; a candidate is kept if the document's shingles hold at least 8 in 10 of the item's, counted on the words
themselves. With 128 slots a window that holds 8 in 10 of an item is missed with a chance below 1e-11.

An item with fewer than `n` words is one shingle of all its words, and a document holds it where these words stand in a row;
its signature is that one hash, looked up among the document's shingles of the same number of words.

Items are taken in blocks of bounded size, each compared with all documents; items with equal texts are searched for once.
Null or blank texts match nothing. Rows without an id are left out, repeated rows each get their rows, further
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 128
SEEDS = common.mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Items and bytes of one block of test items.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
BITS = 22


def word_shingles(words: list[bytes], n: int) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def signature(h: np.ndarray) -> np.ndarray:
    """Slot-tagged minima of the hashes under SLOTS orders."""
    return common.mix(np.array([common.mix(h ^ s).min() for s in SEEDS], np.uint64) ^ (SEEDS * np.uint64(3)))


class Index:
    """Signatures of one block of items by size class."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.items, hashes = [], common.WordHashes()
        slots: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        member = []
        for item_id, text in items:
            words = common.lower_words(text)
            if not words:
                continue
            h = np.unique(common.shingle_hashes(hashes.of(words), n))
            self.items.append((item_id, word_shingles(words, n), h))
            if len(words) < n:
                self.short[len(words)][int(h[0])].append(len(self.items) - 1)
                continue
            member.append(h)
            size = 1 << max(0, int(len(h) - 1).bit_length())
            for v in signature(h).tolist():
                slots[size][v].append(len(self.items) - 1)
        self.slots = {k: dict(v) for k, v in slots.items()}
        self.short_hashes = {m: np.array(sorted(t), np.uint64) for m, t in self.short.items()}
        self.member = np.unique(np.concatenate(member)) if member else np.zeros(0, np.uint64)
        self.bits = np.zeros(1 << BITS, bool)
        self.bits[(self.member >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> set[int]:
        hit = np.flatnonzero(self.bits[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(hit):
            return set()
        near = np.minimum(np.searchsorted(self.member, h[hit]), len(self.member) - 1)
        hit = hit[self.member[near] == h[hit]]  # a window without a shingle of an item agrees with none
        found: set[int] = set()
        for size, table in self.slots.items():
            for w in np.unique(np.concatenate([hit // size, np.maximum(hit // size - 1, 0)])) if len(hit) else ():
                for v in signature(h[w * size : (w + 2) * size]).tolist():
                    found.update(table.get(v, ()))
        return found


    def held(self, text: str, hashes: common.WordHashes, n: int, num: int, den: int) -> list[tuple[int, int, int]]:
        """item, shared and wanted shingles of the items that the text holds."""
        words = common.lower_words(text)
        if not words or not self.items:
            return []
        h = hashes.of(words)
        found = self.candidates(common.shingle_hashes(h, n)) if len(words) >= n and len(self.member) else set()
        for size, table in self.short.items():
            if len(words) >= size:
                at = common.shingle_hashes(h, size)
                found.update(k for v in np.unique(at[np.isin(at, self.short_hashes[size])]).tolist() for k in table[v])
        own: dict[int, set] = {}
        out = []
        for k in sorted(found):
            item_id, wanted, _ = self.items[k]
            size = len(next(iter(wanted)))
            if size not in own:
                own[size] = word_shingles(words, size)
            shared = len(wanted & own[size])
            if shared * den >= num * len(wanted):
                out.append((item_id, shared, len(wanted)))
        return out


def search(items: list[tuple[int, str]], n: int, num: int, den: int):
    """mapInArrow function: documents to the items they hold."""

    def run(it):
        index, hashes = Index(items, n), common.WordHashes()
        for b in common.slices(it):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *x) for x in index.held(text, hashes, n, num, den)]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_item"])

    return run


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of bounded size, dealt by a hash of both columns."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("item_id").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    blocks = max(1, -(-size["n"] * 2 // BLOCK_ITEMS), -(-size["b"] * 2 // BLOCK_BYTES)) if size["n"] > BLOCK_ITEMS or size["b"] > BLOCK_BYTES else 1
    for k in range(blocks):
        yield [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every document that holds an item."""
    rows = common.texts(docs)
    found = [rows.mapInArrow(search(block, n, num, den), "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint") for block in blocks_of(benchmark)]
    return functools.reduce(DataFrame.unionByName, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""

    def clean(block):
        def run(it):
            index, hashes = Index(block, n), common.WordHashes()
            for b in common.slices(it):
                keep = [not index.held(x or "", hashes, n, num, den) for x in b.column(b.schema.get_field_index("text")).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        return run

    for block in blocks_of(benchmark):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs
