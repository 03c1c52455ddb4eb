"""Entities of the engine as typed views over stored tables.

The engine models developer activity: tool events, memories, findings, decisions, state, code symbols and references. A
deployment maps its own tables to these views; here they are mapped from the generic tables that the queries run on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kind of token event that stands for an event type.
TOKEN_KINDS = {"purchase": "read", "view": "outline", "click": "symbol", "signup": "injected", "error": "failure"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    return day + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, ts_us, session, name, kind, tokens, k (from the JSON attributes)."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(k)) for t, k in TOKEN_KINDS.items()])
    ts = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.col("event_id").alias("id"),
        ts.alias("ts"),
        micros(ts).alias("ts_us"),
        F.col("user_id").alias("session"),
        F.col("event_type").alias("name"),
        kind.alias("kind"),
        F.floor(F.col("value")).cast("bigint").alias("tokens"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, source, content, tags, size: documents as memories."""
    d = table(spark, sf_dir, "documents")
    tags = F.filter(F.array(F.col("source"), F.concat(F.lit("lang:"), "lang"), F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("n_chars") < 100, "forget")), lambda t: t.isNotNull())
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), "source", F.col("text").alias("content"), tags.alias("tags"), F.col("n_chars").alias("size"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, analyzer, severity, file, accepted: labelled documents as findings."""
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    severity = F.when(F.col("toxic") == 1, "critical").when(F.col("quality") == 0, "warning").otherwise("info")
    return joined.select(F.col("doc_id").alias("id"), F.col("source").alias("analyzer"), severity.alias("severity"), F.concat_ws("/", "lang", "source").alias("file"), (F.col("quality") == 1).alias("accepted"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, created, seq, value, precedence: orders as versions of decisions."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("topic"), F.col("o_orderdate").cast("date").alias("created"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"), F.substring("o_orderpriority", 1, 1).cast("int").alias("precedence"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, field, value, updated: line items as entity-attribute-value rows."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("agent"), F.col("l_linenumber").alias("field"), F.col("l_quantity").cast("bigint").alias("value"), F.col("l_shipdate").cast("date").alias("updated"))


def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, lines: line items as per-commit file changes."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_quantity").cast("bigint").alias("lines"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, symbol, start, end: the line items of a part as ranges within it."""
    li = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return li.select(F.col("l_partkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("symbol"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file, line: events as places that refer into a file."""
    e = table(spark, sf_dir, "events")
    n = F.greatest(F.col("event_id") % 2000, F.lit(0)) + 1
    return e.select(F.col("event_id").alias("id"), n.alias("file"), (F.col("user_id") * 37 % 2500).cast("int").alias("line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w: parts and suppliers that line items connect."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").cast("bigint").alias("w"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, seq, role, text: conversation turns as prompts (user) and mutations (assistant)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line_no (from 1), text: the lines of documents as source lines."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("p", "text")).select("id", (F.col("p") + 1).alias("line_no"), "text")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, status, owner, created, completed, parent: orders as tasks."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "claimed").otherwise("done")
    created = F.col("o_orderdate").cast("date")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        status.alias("status"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("owner"),
        created.alias("created"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(created, 30)).alias("completed"),
        (F.col("o_custkey") % 50).alias("parent"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, sender, addressee (0: all), content, priority, parent, created, expires (an hour later): events as messages."""
    e = events(spark, sf_dir)
    return e.select("id", F.col("session").alias("sender"), F.when(F.col("session") % 10 == 1, 0).otherwise(F.col("k")).cast("bigint").alias("addressee"), F.col("name").alias("content"), F.when(F.col("tokens") >= 60, "high").otherwise("normal").alias("priority"), (F.col("session") % 7).alias("parent"), F.col("ts_us").alias("created"), (F.col("ts_us") + 3_600_000_000).alias("expires"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts_us, session, shape, status, rejections, memory: events as proposals."""
    e = events(spark, sf_dir)
    status = F.when(F.col("k") < 40, "open").when(F.col("k") < 70, "accepted").otherwise("rejected")
    return e.select("id", "ts_us", "session", F.col("name").alias("shape"), status.alias("status"), F.when(F.col("k") >= 70, 1).otherwise(0).alias("rejections"), F.when(F.col("k").between(40, 69), F.col("id")).alias("memory"))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, analyzer, kind, name, file, size, est_tokens: parts as survey entries."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("analyzer"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("file"), F.col("p_size").cast("int").alias("size"), F.floor("p_retailprice").cast("bigint").alias("est_tokens"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, deleted: customers in debt as tombstones."""
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"), F.floor("c_acctbal").cast("bigint").alias("deleted"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, symbols (ids in order), size: the parts that line items name as indexed files."""
    s = symbols(spark, sf_dir)
    return s.groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list("symbol")).alias("symbols"), F.sum(F.col("end") - F.col("start")).cast("bigint").alias("size"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts_us, session, name, file, command, error: clicks, copies once, as tool calls and prompts.

    The file is k of the attributes, the command what was done on which system, an error that of an error event. Attributes
    may be cut off, so the two fields are matched and not parsed.
    """
    c = table(spark, sf_dir, "clicks").select("click_id", "ts", "client_id", "kind", "props").distinct()
    field = lambda pattern: F.nullif(F.regexp_extract("props", pattern, 1), F.lit(""))
    os = field('"os": "([a-z]+)"')
    command = F.concat(F.lit("LANG=C /usr/bin/"), "kind", F.lit("   --on "), F.coalesce(os, F.lit("any")), F.lit(" 2>/dev/null|sort"))
    return c.select(
        F.col("click_id").alias("id"),
        micros(F.col("ts")).alias("ts_us"),
        F.col("client_id").alias("session"),
        F.col("kind").alias("name"),
        field('"k": ([0-9]+)').alias("file"),
        command.alias("command"),
        F.when(F.col("kind") == "error", F.concat(F.lit("failed on "), F.coalesce(os, F.lit("any")))).alias("error"),
    ).where("session is not null and ts_us is not null")
