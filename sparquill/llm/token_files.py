"""Token ids in binary files with Elias-Fano document boundaries.

A data set is a folder of segments. A segment holds the ids of consecutive documents, concatenated as little-endian unsigned
numbers of 2 bytes where the vocabulary allows it, else of 4, and two Elias-Fano sequences: where each document ends, and
the doc_ids. An increasing sequence of n numbers below u takes about 2 + log2(u / n) bits a number: the low bits of each
stand side by side, the high ones as a bit vector in which the one of number i lies at (high part of it) + i. Select, the
place of the i-th one, starts from a sample kept for every 256th one and counts bits from there, so a document is found
without a table of offsets. Bytes of a segment:

    0   8 bytes b"SQTOKEF1"
    8   8 unsigned 64-bit numbers: bytes of an id, documents, ids, ids before it in its shard, ids' bytes, ends' bytes,
        doc_ids' bytes, first doc_id
    72  the ids, padded to 8 bytes; the ends; the doc_ids less the first

Texts are dealt by ranges of doc_id, so segments are in ascending order of shard and number; equal doc_ids are told apart by
a hash of the text and by the text. A task writes its shard in segments of bounded size as it encodes; each is written
under a name of the attempt and then renamed, so a repeated task leaves the same files. What precedes a shard is the sum of
the shards before it, a row for each shard.

Null texts count as empty (the end mark alone), rows without doc_id are left out, repeated rows are written each, further
columns are ignored. An empty table gives a folder without segments, which reads back empty.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokenizing

MAGIC = b"SQTOKEF1"
HEAD = "<8s7Qq"
SAMPLE = 256
#: Ids in a segment before it is closed, and documents.
SEGMENT_IDS, SEGMENT_DOCS = 2_000_000, 200_000
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of unsigned numbers, as bytes; `select` reads one number, `all` every one."""

    HEAD = "<QQQQ"

    def __init__(self, data: bytes | memoryview):
        self.n, self.low_bits, high, samples = struct.unpack_from(self.HEAD, data)
        at = struct.calcsize(self.HEAD)
        size = (self.n * self.low_bits + 7) // 8
        self.low = np.frombuffer(data, np.uint8, size, at)
        self.high = np.frombuffer(data, np.uint8, high, at + size)
        self.samples = np.frombuffer(data, "<u4", samples, at + size + high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return struct.pack(cls.HEAD, 0, 0, 0, 0)
        low_bits = max(0, (int(values[-1]) + 1) // n).bit_length() - 1 if int(values[-1]) >= n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        # numpy sets the least bit first, as does the reader
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low_bits else np.zeros((0, 0), np.uint8)
        low, packed = np.packbits(bits.ravel(), bitorder="little"), np.packbits(high, bitorder="little")
        samples = ones[::SAMPLE].astype("<u4")
        return struct.pack(cls.HEAD, n, low_bits, len(packed), len(samples)) + low.tobytes() + packed.tobytes() + samples.tobytes()

    def select(self, i: int) -> int:
        """Number i, from the sample before it: whole bytes are counted, then the bits of one."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, word = at >> 3, int(self.high[at >> 3]) & (0xFF << (at & 7)) & 0xFF
        while (ones := int(ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, (i + 1) * self.low_bits
        around = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little")
        return around >> (first & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


class Segment:
    """Random access to a segment's documents."""

    def __init__(self, data: bytes | memoryview):
        magic, self.width, self.documents, self.n_ids, self.before, ids, ends, names, self.first = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        at = struct.calcsize(HEAD)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)
        self.ends = EliasFano(memoryview(data)[at + ids : at + ids + ends])
        self.names = EliasFano(memoryview(data)[at + ids + ends : at + ids + ends + names])

    @staticmethod
    def encode(names: list[int], ids: list[bytes], width: int, before: int) -> bytes:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        whole = b"".join(ids)
        whole += b"\0" * (-len(whole) % 8)
        ends = EliasFano.encode(np.cumsum(lengths))
        doc_ids = EliasFano.encode(np.array([n - names[0] for n in names], np.uint64))
        return struct.pack(HEAD, MAGIC, width, len(ids), int(lengths.sum()), before, len(whole), len(ends), len(doc_ids), names[0]) + whole + ends + doc_ids

    def document(self, i: int) -> tuple[int, int, np.ndarray]:
        """doc_id, place within the shard and ids of document i."""
        start = self.ends.select(i - 1) if i else 0
        return self.first + self.names.select(i), self.before + start, self.ids[start : self.ends.select(i)]

    def all(self):
        """doc_id, place within the shard and ids of every document."""
        ends = self.ends.all().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for name, a, b in zip(self.names.all().tolist(), starts.tolist(), ends.tolist(), strict=True):
            yield self.first + name, self.before + a, self.ids[a:b]


def segment_name(shard: int, number: int) -> str:
    return f"shard-{shard:07d}-{number:05d}.ef"


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file of a shared folder whole or not at all."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    made = f"{root}/_{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(made) as f:
        f.write(data)
    files.move(made, f"{root}/{name}")


def make_folder(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(conf).mkdirs(p)


def write_shard(folder: str, name: str, where: str | None, end_id: int):
    """mapInArrow function: texts in order to segments in the folder; a row for each segment."""

    def run(it):
        enc = tokenizing.encoder(name, where)
        width = enc.width
        last = np.array([end_id], f"<u{width}").tobytes()
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        names, ids, held = [], [], 0

        def close():
            nonlocal number, before, held
            put(folder, segment_name(shard, number), Segment.encode(names, ids, width, before))
            made = (shard, number, len(names), held // width)
            number, before, held = number + 1, before + held // width, 0
            names.clear()
            ids.clear()
            return made

        rows = []
        for b in common.slices(it, keep=True):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = enc.packed(text) + last
                names.append(doc_id)
                ids.append(one)
                held += len(one)
                if held >= SEGMENT_IDS * width or len(names) >= SEGMENT_DOCS:
                    rows.append(close())
        if names:
            rows.append(close())
        yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.int64()) for i, k in enumerate(("shard", "number", "documents", "n_ids"))})

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, where: str | None = None, shards: int | None = None) -> DataFrame:
    """Write documents (doc_id, text) to a new folder in ascending doc_id order; a row for each segment."""
    spark = docs.sparkSession
    make_folder(spark, folder)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.texts(docs).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = dealt.mapInArrow(write_shard(folder, tokenizer, where, end_id), "shard bigint, number bigint, documents bigint, n_ids bigint")
    return common.Workspace(spark, "token-files").table(made, "segments")


def write_manifest(segments: DataFrame, folder: str, tokenizer: str, end_id: int, where: str | None = None) -> list[int]:
    """Ids before each shard, in a file beside the segments; a number for each shard, as many as the tasks that wrote them."""
    sizes = {r["shard"]: r["n"] for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    before, total = [], 0
    for shard in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(shard, 0)
    made = {"tokenizer_sha256": tokenizing.version(tokenizer, where), "end_id": end_id, "ids": total, "before": before}
    put(folder, "manifest.json", json.dumps(made).encode())
    return before


def read_segments(before: list[int], visit):
    """mapInArrow function: segments to what `visit` makes of doc_id, start and ids of each document."""

    def run(it):
        for b in common.slices(it, 1):
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base = before[int(path.rsplit("/", 1)[-1].split("-")[1])]
                names, starts, sizes, values = [], [], [], []
                for doc_id, start, ids in Segment(data.as_buffer().to_pybytes()).all():
                    names.append(doc_id)
                    starts.append(base + start)
                    sizes.append(len(ids))
                    values.append(visit(ids))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values)], ["doc_id", "start", "n_tokens", "value"])

    return run


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def as_list(ids: np.ndarray) -> list[int]:
    return ids.tolist()


def read(spark: SparkSession, folder: str, visit=as_list, kind: str = "array<bigint>") -> DataFrame:
    """doc_id, start (ids before it in the data set), n_tokens and value, its ids or what `visit` makes of them."""
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).first()[0]
    before = json.loads(manifest)["before"]
    if not before:
        return spark.createDataFrame([], f"doc_id bigint, start bigint, n_tokens bigint, value {kind}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.ef").load(folder).select("path", "content")
    common.small_batches(spark)
    return files.mapInArrow(read_segments(before, visit), f"doc_id bigint, start bigint, n_tokens bigint, value {kind}")
