"""The registered queries of this package: thin uses of the operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, centroids, chat_format, common, decontaminate, html_extract, ngram_join, packing, quality, suffix_dedup, syncmers, token_counts, token_files, toxicity


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = rows.unionByName(probe).withColumn("parts", chat_format.text_part(F.coalesce(F.col("text"), F.lit(""))))
    out = chat_format.format_chats(messages)
    turns = chat_format.read_back(F.col("formatted"))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedupe(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each call. The texts of about half of the sources are counted first, so that the count of the
    whole table finds theirs stored, and encodes the others; each distinct text is encoded once."""
    cache = token_counts.CountCache(spark, f"{common.shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents")
    part = F.col("source") if "source" in docs.columns else F.col("doc_id").cast("string")
    token_counts.store_counts(docs.where(F.crc32(F.coalesce(part, F.lit(""))) % 2 == 0), cache)
    out = token_counts.count_tokens(docs, cache)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = toxicity.scores(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = quality.scores(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, at = centroids.cluster(read(spark, sf_dir, "embeddings"), k=40, rounds=5, dimensions=64, scale=256, seed="2:")
    return centroids.with_inertia(assigned, at).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    token_files.write_manifest(token_files.write(read(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", 2), folder, "word_bpe_49k.json", 2)
    return token_files.read(spark, folder, token_files.crc32, "bigint").withColumnRenamed("value", "ids_crc32")


DAY, HOUR = 86_400_000_000, 3_600_000_000


def op13_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the orders at most 72 hours before them; an odd checksum of the id floors a time to its day."""
    odd = lambda c: F.crc32(F.col(c).cast("string")) % 2 == 1
    placed = lambda c, ts: F.when(odd(c), F.floor(F.col(ts) / DAY) * DAY).otherwise(F.col(ts))
    clicks = read(spark, sf_dir, "clicks").select(F.col("click_id").alias("id"), F.col("client_id").alias("client"), asof.micros("ts").alias("us"))
    sales = read(spark, sf_dir, "sales").select("sale_id", F.col("client_id").alias("client"), "priority", F.floor(F.col("total") * 100 + 0.5).cast("bigint").alias("total_cents"), asof.micros("sold_at").alias("us"))
    orders = sales.withColumn("at", placed("sale_id", "us")).drop("us")
    twins = orders.where(F.crc32(F.col("sale_id").cast("string")) % 3 != 0).withColumns({"sale_id": -1 - F.col("sale_id"), "priority": 6 - F.col("priority")})
    rank = [F.col("priority"), F.bitwise_not("sale_id")]  # the complement falls as the id rises
    out = asof.asof_join(clicks.select("id", "client", placed("id", "us").alias("ts")), orders.unionByName(twins), 72 * HOUR, rank, ["sale_id", "total_cents"])
    return out.select(F.col("id").alias("click_id"), F.col("client").alias("client_id"), F.col("ts").alias("ts_us"), "sale_id", (F.col("ts") - F.col("at")).alias("lag_us"), "total_cents", F.coalesce("n_tied", F.lit(0)).alias("n_tied"))


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_ngram_jaccard_join, op3_chat_format, op4_syncmer_fingerprints, op5_packing, op6_decontamination, op7_suffix_array_dedup, op8_token_counts, op9_toxicity, op10_quality, op11_centroid_clustering, op12_token_files, op13_asof_join)}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _short_shingles(key: str) -> str:
    """Runs of as many words as a benchmark item with fewer than five words has."""
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT {key}, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT {key}, {words} AS w FROM documents) x JOIN (SELECT DISTINCT len({words}) AS m FROM benchmark) s ON m BETWEEN 1 AND 4 AND len(w) >= m) y"


def _shingles(table: str, key: str) -> str:
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) x WHERE len(w) > 0) y"


def _crc32(digits: str) -> str:
    """The unsigned CRC-32 of a text of ASCII signs: eight steps of the reflected polynomial for each sign."""
    steps = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS UBIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), CAST(list_transform(string_split({digits}, ''), lambda s: ascii(s)) AS UBIGINT[])), lambda c, b: {steps}), 4294967295)"


#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {
    "op3_chat_format": r"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(k)),
 e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|\|(?:role|end|image|audio|document)[:|])', '\\l\1', 'g'), '\[(/?INST\]|/?SYS\])', '\\b\1', 'g') AS body FROM t)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
 length(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(body) + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 11 ELSE 13 END) AS BIGINT) AS formatted_chars FROM e WHERE conv_id IS NOT NULL GROUP BY conv_id""",
    "op6_decontamination": f"""WITH d AS ({_shingles("documents", "doc_id")} UNION {_short_shingles("doc_id")}), b AS ({_shingles("benchmark", "item_id")}), n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
 SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (g) GROUP BY ALL) s JOIN n USING (item_id) WHERE n_shared * 10 >= 8 * n_item""",
    "op13_asof_join": f"""WITH c AS (SELECT DISTINCT click_id, client_id, CASE WHEN {_crc32("CAST(click_id AS VARCHAR)")} % 2 = 1 THEN epoch_us(ts) // 86400000000 * 86400000000 ELSE epoch_us(ts) END AS ts_us FROM clicks),
 s AS (SELECT sale_id, client_id, priority, CAST(floor(total * 100 + 0.5) AS BIGINT) AS total_cents, {_crc32("CAST(sale_id AS VARCHAR)")} AS h, epoch_us(sold_at) AS us FROM sales),
 a AS (SELECT * EXCLUDE (us), CASE WHEN h % 2 = 1 THEN us // 86400000000 * 86400000000 ELSE us END AS t0 FROM s),
 o AS (SELECT sale_id, client_id, priority, total_cents, t0 FROM a UNION ALL SELECT -1 - sale_id, client_id, 6 - priority, total_cents, t0 FROM a WHERE h % 3 <> 0),
 w AS (SELECT *, row_number() OVER (PARTITION BY client_id, t0 ORDER BY priority DESC NULLS LAST, sale_id NULLS LAST) AS rn, count(*) OVER (PARTITION BY client_id, t0) AS n_tied FROM o WHERE client_id IS NOT NULL AND t0 IS NOT NULL),
 b AS (SELECT c.*, w.sale_id, w.total_cents, w.n_tied, w.t0 FROM c ASOF LEFT JOIN (SELECT * FROM w WHERE rn = 1) w ON c.client_id = w.client_id AND c.ts_us >= w.t0),
 m AS (SELECT *, coalesce(ts_us - t0 <= 259200000000, false) AS near FROM b)
 SELECT click_id, client_id, ts_us, CASE WHEN near THEN sale_id END AS sale_id, CASE WHEN near THEN ts_us - t0 END AS lag_us, CASE WHEN near THEN total_cents END AS total_cents, CASE WHEN near THEN n_tied ELSE 0 END AS n_tied FROM m""",
}
