"""Chat formatting with typed content parts, by DataFrame functions only.

A message is a role and an array of parts: text, image, audio or document. A visitor turns each part into its piece of the
turn's body, in order: text is escaped, any other part becomes a placeholder, and its reference and the number of tokens it
expands to are recorded. The template marks system, user and assistant turns. Control strings inside texts are escaped
(backslash doubled, the first character of a control string replaced), so the output can be read back exactly.

Null texts count as empty, null parts are skipped, null roles become 'user', unknown roles are written with a mark of their
own. Turns are ordered by turn (nulls first), then role and text, so ties and repeated rows have one defined order. A row
without conv_id is left out. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of an image tile side (pixels), of a second of audio, of a document page.
TILE, AUDIO_RATE, PAGE_TOKENS = 14, 25, 1024
#: A character that a control string starts with is written as backslash and letter.
CONTROL = r"(?=/?s>|\|(?:role|end|image|audio|document)[:|])"
SQUARE = r"(?=/?INST\]|/?SYS\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "<" + CONTROL, r"\\l"), r"\[" + SQUARE, r"\\b")


def unescape(text: Column) -> Column:
    # a doubled backslash is parked on a character pair that no escaped text can hold: backslash, zero
    parked = F.replace(text, F.lit("\\\\"), F.lit("\\0"))
    return F.replace(F.replace(F.replace(parked, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\0"), F.lit("\\"))


def part_tokens(p: Column) -> Column:
    """Tokens that a part other than text expands to."""
    size = lambda x: F.coalesce(x, F.lit(0))
    return (
        F.when(p["type"] == "image", F.ceil(size(p["width"]) / TILE) * F.ceil(size(p["height"]) / TILE))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["type"] == "document", size(p["pages"]) * PAGE_TOKENS)
        .otherwise(0)
        .cast("bigint")
    )


def visit(p: Column) -> Column:
    """A part's piece of the body."""
    return F.when(p["type"].isin("image", "audio", "document"), F.concat(F.lit("<|"), p["type"], F.lit("|"), escape(F.coalesce(p["ref"], F.lit(""))), F.lit("|"), part_tokens(p).cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


OPEN = {"user": "<s>[INST] ", "assistant": "<|end|>", "system": "[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": "</s>", "system": " [/SYS]"}


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation: formatted, loss_spans (start, length in code points of assistant bodies), attachments.

    messages: conv_id, turn, role, parts.
    """
    role = F.coalesce(F.col("role"), F.lit("user"))
    pick = lambda m, other: F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in m.items()], other)
    parts = F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    turns = messages.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            pick(OPEN, F.concat(F.lit("<|role|"), F.hex(role), F.lit("|>"))).alias("open"),
            F.array_join(F.transform(parts, visit), "").alias("body"),
            pick(CLOSE, F.lit("<|end|>")).alias("close"),
            F.transform(F.filter(parts, lambda p: p["type"].isin("image", "audio", "document")), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("attached"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["open"], t["body"], t["close"])), "")
    length = lambda t: F.length(t["open"]) + F.length(t["body"]) + F.length(t["close"])
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    spans = F.aggregate(
        "turns",
        begin,
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).cast("bigint").alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["open"])).cast("bigint").alias("start"), F.length(t["body"]).cast("bigint").alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return chats.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"))


#: A turn of the output: opening mark, body, closing mark. Bodies hold none of the marks.
TURN = r"(?s)(<s>\[INST\] |<\|end\|>|\[SYS\] |<\|role\|[0-9A-F]*\|>)(.*?)( \[/INST\]|</s>| \[/SYS\]|<\|end\|>)"


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation; placeholders stay as written."""
    found = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    at = lambda t, k: F.regexp_extract(t, "^" + TURN + "$", k)

    def turn(t: Column) -> Column:
        mark = at(t, 1)
        role = F.when(mark == OPEN["user"], "user").when(mark == OPEN["assistant"], "assistant").when(mark == OPEN["system"], "system").otherwise(F.decode(F.unhex(F.regexp_extract(mark, r"role\|([0-9A-F]*)", 1)), "UTF-8"))
        return F.struct(role.alias("role"), unescape(at(t, 2)).alias("text"))

    return F.transform(found, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
