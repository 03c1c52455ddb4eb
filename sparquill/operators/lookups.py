"""Lookups across tables: usage of a day in session logs, project markers, includes in order, read checks, symbol search,
search across instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions.scalars import estimated_tokens
from ..sources.store import stored
from .relational import ranked, top_k


def usage_of_day(lines: DataFrame, needle: str, schema: str, wanted: Column, amount: Column, window_us: int, now_us: int) -> DataFrame:
    """messages, amount, messages_window, amount_window: sums over today and over the last `window_us` of it, by UTC days.

    lines: at_us, line (JSON). Lines without the needle are not parsed, malformed ones, also by
    the types of the schema, and those of other roles are skipped.
    `wanted` and `amount` read the parsed line m.
    """
    day = 86_400_000_000
    read = lines.where(F.contains("line", F.lit(needle)))
    parsed = read.select("at_us", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    today = parsed.where(F.col("m._bad").isNull() & wanted & F.col("at_us").between(now_us // day * day, now_us // day * day + day - 1))
    late = F.col("at_us") > now_us - window_us
    n = F.coalesce(amount, F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return today.agg(F.count("*").alias("messages"), total(n).alias("amount"), F.count_if(late).alias("messages_window"), total(F.when(late, n)).alias("amount_window"))


def project_markers(paths: DataFrame, markers: Sequence[dict], folder_key: str = "root") -> DataFrame:
    """root, folder, label, marker of each marker that a project's files have. paths: root, path (of files, from the root).

    A marker has check, file, label and, by its check, further fields. `file`: every folder down to max_depth (0: the root
    alone, -1: any) that holds the file. `directory`: the folder stands at the root and is not empty. `sibling`: a folder where
    the file marker sibling_of was found holds this file too. Folders named in skip are not entered.
    """
    p = paths.where("path is not null").select(folder_key, "path").distinct().withColumn("parts", F.split("path", "/"))
    p = p.select(folder_key, "path", F.slice("parts", F.lit(1), F.size("parts") - 1).alias("above"), F.element_at("parts", -1).alias("base"))
    folder = F.array_join("above", "/")

    def entered(m: dict) -> Column:
        deep = F.lit(True) if m.get("max_depth", 0) < 0 else F.size("above") <= m.get("max_depth", 0)
        return deep & ~F.coalesce(F.arrays_overlap("above", F.array(*map(F.lit, m["skip"]))), F.lit(False)) if m.get("skip") else deep

    def entry(where: Column, m: dict, at: Column) -> Column:
        return F.when(where, F.struct(at.alias("folder"), F.lit(m["label"]).alias("label"), F.lit(m["file"]).alias("marker")))

    tops = F.array_join(F.slice("above", 1, 1), "/")
    alone = [entry((F.col("base") == m["file"]) & entered(m), m, folder) for m in markers if m["check"] == "file"]
    alone += [entry((F.size("above") > 0) & (tops == m["file"]), m, F.lit("")) for m in markers if m["check"] == "directory"]
    found = p.select(folder_key, F.explode(F.filter(F.array(*alone), lambda x: x.isNotNull())).alias("e")).select(folder_key, "e.*").distinct()
    beside = {m["file"]: m for m in markers if m["check"] == "sibling"}
    if not beside:
        return found
    held = p.select(folder_key, folder.alias("folder"), F.explode(F.filter(F.array(*[entry(F.col("base") == f, m, F.lit(m["sibling_of"])) for f, m in beside.items()]), lambda x: x.isNotNull())).alias("e"))
    held = held.select(folder_key, "folder", F.col("e.folder").alias("_of"), "e.label", "e.marker").distinct()
    of = found.select(folder_key, "folder", F.col("marker").alias("_of")).distinct()
    return found.unionByName(held.join(of, [folder_key, "folder", "_of"], "left_semi").drop("_of"))


def include_order(includes: DataFrame, root, rounds: int = 100) -> DataFrame:
    """name, place: the root and all it includes, each after what it includes itself, in the order of a walk that goes through
    the includes in their order and passes over what it has seen.

    includes: name, nth, inc, of blueprints whose names differ. Where nothing includes itself, the walk first comes to a node
    on the least of its ways from the root, compared by their places; so the ways shorten in rounds until none changes, and
    the walk's order is that of the ways with each node after all that its own way begins. A way longer than `rounds`, or a
    node that includes itself in the end, is an error.
    """
    edges = stored(includes.where("inc is not null").select("name", "nth", "inc").distinct())
    spark = includes.sparkSession
    kind = includes.schema["name"].dataType.simpleString()
    least = F.min("way").alias("way")
    front = spark.range(1).select(F.lit(root).cast(kind).alias("name"), F.array().cast("array<bigint>").alias("way"))
    ways = stored(front)
    for _ in range(rounds):
        step = front.join(edges, "name").select(F.col("inc").alias("name"), F.concat("way", F.array(F.col("nth").cast("bigint"))).alias("way")).groupBy("name").agg(least)
        front = stored(step.join(ways.withColumnRenamed("way", "known"), "name", "left").where("known is null or way < known").select("name", "way"))
        if front.isEmpty():
            break
        ways = stored(ways.unionByName(front).groupBy("name").agg(least))
    else:
        raise RuntimeError(f"{root} includes itself, or its includes are deeper than {rounds}")
    # behind all that goes on from it: no place is as large
    late = ways.withColumn("key", F.concat("way", F.array(F.lit((1 << 63) - 1))))
    a, b = late.select("name", F.col("key").alias("ka")), late.select(F.col("name").alias("inc"), F.col("key").alias("kb"))
    if not edges.join(a, "name").join(b, "inc").where("kb >= ka").isEmpty():
        raise ValueError(f"{root} includes itself")
    return ranked(late, "key", name="place").select("name", "place")


def read_check(asked: DataFrame, index: DataFrame, disk: DataFrame, ratios: Mapping[str, float], default: float = 3.0) -> DataFrame:
    """path, indexed, fresh, symbols, outline, tokens of each path asked for.

    index: path, mtime, symbols, tokens. disk: path, mtime, size, language. Fresh is what was indexed at the file's time; a
    file that is gone is indexed and not fresh. Tokens that the index doesn't know (0) are estimated from the file's size.
    """
    i = index.select("path", F.col("mtime").alias("known_at"), "symbols", F.col("tokens").alias("known"))
    d = disk.select("path", "mtime", "size", "language")
    met = asked.select("path").distinct().join(i.withColumn("indexed", F.lit(True)), "path", "left").join(d, "path", "left")
    ratio = F.coalesce(*[F.when(F.col("language") == k, F.lit(v)) for k, v in ratios.items()], F.lit(default))
    guess = F.when((F.coalesce("known", F.lit(0)) == 0) & (F.col("size") > 0), estimated_tokens(F.col("size"), ratio))
    indexed = F.coalesce("indexed", F.lit(False))
    no = lambda c: F.coalesce(F.when(indexed, c), F.lit(0)).cast("bigint")
    return met.select("path", indexed.alias("indexed"), (indexed & F.coalesce(F.col("known_at") == F.col("mtime"), F.lit(False))).alias("fresh"), no(F.col("symbols")).alias("symbols"), (no(F.col("symbols")) > 0).alias("outline"), no(F.coalesce(guess, F.col("known"))).alias("tokens"))


def symbol_search(symbols: DataFrame, q: str, limit: int = 20, kind: str | None = None, path_part: str | None = None) -> DataFrame:
    """id, score of symbols (id, name, signature, doc, kind, path) that a query hits; kind and path filter what was fetched.

    Four legs: the name begins with the query, holds it, the signature or the comment holds one of its words. A leg that hits
    adds log(1 + symbols / hits of the leg), in millionths. Twice the limit (of 20 if it isn't positive) is fetched, the best
    first, and filtered then, so there may be fewer or more than the limit.
    """
    low, fetched = q.lower(), 2 * (limit if limit > 0 else 20)
    words = [w for w in low.split() if w]
    hits = lambda c: F.coalesce(F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*map(F.lit, words))), F.lit(False)) if words else F.lit(False)
    name = F.coalesce(F.lower("name"), F.lit(""))
    legs = {"prefix": F.startswith(name, F.lit(low)), "part": F.contains(name, F.lit(low)), "sig": hits("signature"), "said": hits("doc")}
    met = symbols.select("id", "kind", "path", *[F.when(c, 1).otherwise(0).alias(n) for n, c in legs.items()])
    counts = met.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"n_{c}") for c in legs])  # one row
    weight = lambda c: F.when(F.col(c) == 1, F.floor(F.log(1 + F.col("n") / F.col(f"n_{c}")) * 1_000_000 + 0.5)).otherwise(0)
    scored = met.where(" or ".join(f"{c} = 1" for c in legs)).join(F.broadcast(counts)).withColumn("score", sum(map(weight, legs)).cast("bigint"))
    top = top_k(scored.select("id", "kind", "path", "score"), fetched, F.desc("score"), "id")
    if kind is not None:
        top = top.where(F.col("kind") == kind)
    return (top.where(F.contains("path", F.lit(path_part))) if path_part else top).select("id", "score")


def cross_search(entities: Sequence[tuple[str, DataFrame, int | None]], needle: str) -> DataFrame:
    """instance, type, id, title, detail of what holds the needle, in any case, in title or detail, over all types.

    entities: type, rows (instance, id, title, detail), and how many of each instance are shown, by id; None shows all. The
    rows that a partition can't place among the first are dropped before they are shuffled.
    """
    out = None
    for kind, df, most in entities:
        part = F.lit(needle.lower())
        hit = df.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), part) | F.contains(F.lower(F.coalesce("detail", F.lit(""))), part))
        if most is not None:
            w = Window.partitionBy("instance").orderBy("id")
            hit = hit.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
        part_of = hit.select("instance", F.lit(kind).alias("type"), F.col("id").cast("bigint").alias("id"), N.shortened(F.col("title"), 80).alias("title"), N.shortened(F.col("detail"), 80).alias("detail"))
        out = part_of if out is None else out.unionByName(part_of)
    return out


def latest_stamp(entries: DataFrame, key: str, stamp: str, at: str, order: str) -> DataFrame:
    """key, stamp: of each key the stamp of its latest entry that carries one, the first of the order among equally late ones."""
    carries = F.coalesce(F.col(stamp), F.lit("")) != ""
    return entries.groupBy(key).agg(F.max_by(stamp, F.when(carries, F.struct(at, (-F.col(order)).alias("o")))).alias(stamp))
