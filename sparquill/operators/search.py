"""Full-text search over a stored inverted index.

`postings` in a folder: for each segment and term its places (id, tf) in one row, and their number, df. Documents go to segments
by their id, as many as have `SEGMENT_BYTES` of the table's files each, or `PACKED` times that of text, so the work and the
memory of a task and the length of a list are bounded, and only texts are shuffled, once. A segment's words are numbered and
counted as arrays, not row by row. A search reads the terms of all segments and tells which ones match; lists of other terms
are not taken up.

Words are runs of letters, marks, digits and underscores of any script, joined by a single apostrophe or full stop, in lower
case. Of a query the first ten parts between blanks count. Each matches a term exactly, by an edit, by a prefix of two letters
or more and by a part of three letters or more, and each such leg adds tf * log(1 + documents / df), in millionths; a document's
score is the sum over all terms.

Null and empty texts have no terms, repeated ids count as one document, an empty table gives no hits.
"""

from __future__ import annotations

import functools
import hashlib
import operator
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import Folder, shared_folder

WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
UNIT = 1_000_000
SEGMENT_BYTES = 8 << 20
#: Texts that files pack more than this many times get more segments.
PACKED = 4
#: Terms of an Arrow batch that a segment is returned in.
TERMS = 20_000
FORMAT = "segments"
MOST_WORDS = 10


def words(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def postings_of(docs: DataFrame) -> DataFrame:
    """id, term, tf of documents (id, content)."""
    return docs.select("id", F.explode(words(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def file_states(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of change of the files that a table is read from."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    state = []
    for f in sorted(df.inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(f)
        s = p.getFileSystem(conf).getFileStatus(p)
        state.append((f, s.getLen(), s.getModificationTime()))
    return state


def legs(query: str) -> Column:
    """How often a word of the query matches the column `term` by one of the four legs."""
    term, total = F.col("term"), F.lit(0).cast("bigint")
    for word in query.split()[:MOST_WORDS]:
        tokens = regex.findall(WORD, word.lower())
        exact = [term == t for t in tokens]
        prefix = [F.startswith(term, F.lit(t[:2])) for t in tokens if len(t) >= 2]
        part = [F.contains(term, F.lit(g)) for g in sorted({t[i : i + 3] for t in tokens for i in range(len(t) - 2)})]
        for leg in (exact, [F.levenshtein(term, F.lit(word), 1) >= 0], prefix, part):
            if leg:
                total = total + F.when(functools.reduce(operator.or_, leg), 1).otherwise(0)
    return total


def lists_of(segments):
    """mapInArrow function: segment, id and words of a segment's documents to segment, term, df and places of its terms."""
    batches = [b for b in segments if b.num_rows]
    if not batches:
        return
    segment, ids, words = (pa.concat_arrays([b.column(k) for b in batches]) for k in ("segment", "id", "words"))
    del batches
    ids, length = ids.dictionary_encode(null_encoding="encode"), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(words).dictionary_encode()
    # numbers of terms are made to go by their order
    order, among = pc.array_sort_indices(words.dictionary), len(ids.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    keys = rank[words.indices.to_numpy()] * among + np.repeat(ids.indices.to_numpy(), length)
    keys, tf = np.unique(keys, return_counts=True)
    term, doc = np.divmod(keys, among)
    starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(term))
    terms = words.dictionary.take(order)
    for k in range(0, len(terms), TERMS):
        at = starts[k : k + TERMS + 1]
        places = pa.StructArray.from_arrays([ids.dictionary.take(pa.array(doc[at[0] : at[-1]])), pa.array(tf[at[0] : at[-1]])], ["id", "tf"])
        df = np.diff(at)
        columns = [pa.array(np.full(len(df), segment[0].as_py(), np.int32)), terms.slice(k, len(df)), pa.array(df), pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), places)]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "term", "df", "places"])


class SearchIndex:
    """An index that has been built in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.documents = spark.read.parquet(f"{path}/size").first()["n"]

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> SearchIndex:
        """Index documents (id, content)."""
        spark = docs.sparkSession
        docs.agg(F.count_distinct("id").alias("n"), F.sum(F.octet_length("content")).alias("bytes")).write.parquet(f"{path}/size")
        n = -(-max(sum(length for _, length, _ in file_states(docs)), (spark.read.parquet(f"{path}/size").first()["bytes"] or 0) // PACKED, 1) // SEGMENT_BYTES)
        dealt = docs.select("id", "content", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("segment")).repartitionById(n, F.col("segment"))
        place = T.StructType().add("id", docs.schema["id"].dataType).add("tf", "long")
        lists = T.StructType().add("segment", "integer").add("term", "string").add("df", "long").add("places", T.ArrayType(place))
        # a partition is one segment
        dealt.select("segment", "id", words(F.col("content")).alias("words")).mapInArrow(lists_of, lists).write.parquet(f"{path}/postings")
        return cls(spark, path)

    @classmethod
    def kept(cls, name: str, docs: DataFrame, source: DataFrame) -> SearchIndex:
        """The index of a table's documents, built once as long as the files of the table stay as they are."""
        spark, state = docs.sparkSession, file_states(source)
        folder = Folder(spark, f"{shared_folder(spark)}/search-{name}-{FORMAT}-{hashlib.sha1(repr(state).encode()).hexdigest()[:16]}")
        if "built" not in folder.names():
            made = f"index-{uuid.uuid4().hex}"
            cls.build(docs, f"{folder.path}/{made}")
            folder.put_if_absent("built", made)
        return cls(spark, f"{folder.path}/{folder.read('built')}")

    def matched(self, query: str) -> DataFrame:
        """segment, term, df, places, legs of the terms that a word of the query matches."""
        return self.spark.read.parquet(f"{self.path}/postings").withColumn("legs", legs(query)).where("legs > 0")

    def scores(self, query: str, within: DataFrame | None = None) -> DataFrame:
        """id, score of all documents that match; within: ids that count."""
        met = self.matched(query)
        df = met.groupBy("term", "legs").agg(F.sum("df").alias("df"))
        weight = F.round(F.log(1 + F.lit(self.documents) / F.col("df")) * UNIT).cast("bigint") * F.col("legs")
        lists = met.select("term", "places").join(df.select("term", weight.alias("weight")), "term")
        found = lists.select("weight", F.explode("places").alias("p")).groupBy(F.col("p.id").alias("id")).agg((F.sum(F.col("p.tf") * F.col("weight")) / UNIT).alias("score"))
        return found if within is None else found.join(within.select("id").distinct(), "id", "left_semi")

    def search(self, query: str, limit: int = 10, within: DataFrame | None = None) -> DataFrame:
        """The best documents, equal scores by id; a limit of 0 means ten, a negative one 100,000."""
        most = 100_000 if limit < 0 else limit or 10
        return self.scores(query, within).orderBy(F.desc("score"), "id").limit(most)
