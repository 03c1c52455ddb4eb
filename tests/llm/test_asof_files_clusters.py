"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparquill.llm import asof, centroids, queries, token_files, tokenizing

SF = "/root/testdata/sf0.001"


def latest(events, orders, tolerance):
    out = set()
    for i, client, ts in set(events):
        own = [o for o in orders if o[0] == client and None not in (client, o[1], ts) and o[1] <= ts <= o[1] + tolerance]
        if not own:
            out.add((i, client, ts, None, 0, None))
            continue
        at = max(o[1] for o in own)
        tied = [o for o in own if o[1] == at]
        best = min(tied, key=lambda o: (o[2] is None, -(o[2] or 0), o[3] is None, o[3] or 0))
        out.add((i, client, ts, at, len(tied), best[3]))
    return out


EVENTS, ORDERS = "id bigint, client bigint, ts bigint, level string, code string, at string", "client bigint, at bigint, priority int, sale bigint, block string, next string, id string, n string"


def joined(spark, events, orders, tolerance, **more):
    e = spark.createDataFrame([(*x, "x", "x", "x") for x in events], EVENTS)
    o = spark.createDataFrame([(*x, "x", "x", "x", "x") for x in orders], ORDERS)
    out = asof.asof_join(e, o, tolerance, [F.col("priority"), F.bitwise_not("sale")], ["sale"], **more)
    assert out.columns == ["id", "client", "ts", "at", "n_tied", "sale"]
    return [(r["id"], r["client"], r["ts"], r["at"], r["n_tied"] or 0, r["sale"]) for r in out.collect()]


@pytest.mark.parametrize(("tolerance", "depth", "spread"), [(50, 1, 300), (0, 0, 40), (1000, 2, 200_000), (4095, 1, 3_000_000), (64, 64, 900)])
def test_asof_join(spark, tolerance, depth, spread):
    rng = random.Random(tolerance)
    some = lambda x, share=0.05: None if rng.random() < share else x
    client = lambda: some(1 if rng.random() < 0.4 else rng.randrange(2, 9))
    at = lambda: some(rng.randrange(-spread // 3, spread))
    orders = [(client(), at(), some(rng.randrange(3)), some(rng.randrange(-500, 500))) for _ in range(500)]
    orders += orders[:40]
    events = [(k, client(), at()) for k in range(700)]
    events += events[:50] + [(700 + k, o[0], o[1]) for k, o in enumerate(orders[:60])]
    events += [(1000 + k, o[0], o[1] + tolerance + k % 2) for k, o in enumerate(orders) if o[1] is not None and k < 60]
    ours = joined(spark, events, orders, tolerance, depth=depth)
    assert len(ours) == len(set(ours)) and set(ours) == latest(events, orders, tolerance)
    assert any(r[5] is not None for r in ours)


def test_asof_of_empty_tables(spark):
    assert joined(spark, [], [(1, 5, 1, 1)], 10) == [] and joined(spark, [(1, 1, 5)], [], 10) == [(1, 1, 5, None, 0, None)]


def test_nodes_of_an_interval_are_canonical(spark):
    rng = random.Random(4)
    rows = [(a, a + 1 + rng.randrange(1 << rng.randrange(1, 20)), rng.randrange(1 << 12)) for a in (rng.randrange(-(1 << 18), 1 << 20) for _ in range(300))]
    df = spark.createDataFrame(rows, "a bigint, b bigint, x int")
    for depth in (0, 1, 3, 64):
        for r in df.select("a", "b", asof.cover(F.col("a"), F.col("b"), depth, 20).alias("n")).collect():
            nodes = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"], n["level"]) for n in r["n"])
            assert all(x[1] == y[0] for x, y in zip(nodes, nodes[1:], strict=False)), "apart or overlapping"
            leaf = 1 << max(0, (r["b"] - r["a"]).bit_length() - 1 - depth)
            assert nodes[0][0] == r["a"] // leaf * leaf and nodes[-1][1] == -(-r["b"] // leaf) * leaf
            held = {(lo, hi) for lo, hi, _ in nodes}
            for lo, hi, level in nodes:  # no two siblings, which would be their parent
                assert (lo ^ 1 << level, hi ^ 1 << level) not in {(a, b) for a, b in held if b - a == hi - lo} or lo >> level & 1 == 0 and (hi, hi + (hi - lo)) not in held


def test_no_window_grows_with_a_client(spark):
    times = spark.range(40_000).select(F.lit(1).cast("bigint").alias("client"), (F.col("id") * 3).alias("at"))
    rows = asof.with_next(times, 1 << 30).orderBy("at").select("at", "next").collect()
    assert [r["next"] for r in rows] == [*range(3, 120_000, 3), None]


def lloyd(vectors, k, rounds, dimensions, scale, seed):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in vectors if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"{seed}{x[0]}".encode()).hexdigest(), x[1]))
    c = [list(v) for _, v in order[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    home = lambda v: min(range(len(c)), key=lambda g: (away(v, c[g]), g))
    for _ in range(rounds):
        own = [home(v) for _, v in kept]
        for g in range(len(c)):
            mine = [v for (_, v), h in zip(kept, own, strict=True) if h == g]
            c[g] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c[g]
    return sorted(((i, g := home(v), away(v, c[g])) for i, v in kept), key=str), c


def embedded(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in vectors], "vec_id bigint, embedding array<double>, cluster string, v string")


@pytest.mark.parametrize("large", [1.0, 3e6, 4e16])
def test_clusters_equal_a_full_scan(spark, large):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 6)) * 4
    vectors = [(i, (heads[i % 12] + rng.normal(size=6) * (0.2 if i % 3 else 2)).tolist()) for i in range(600)]
    vectors = [(i, [x * large for x in v]) for i, v in vectors] if large < 1e10 else [*vectors, (990, [large] * 6), (991, [-large] * 6)]
    vectors += vectors[:30] + [(700 + i, [0.5] * 6) for i in range(40)] + [(None, [1.0] * 6), (800, None), (801, [1.0] * 5), (802, [1.0] * 5 + [None]), (803, [1.0] * 5 + [float("nan")]), (804, [float("inf")] * 6), (805, [])]
    out, c = centroids.cluster(embedded(spark, vectors), 25, 4, 6, 8, "2:")
    assigned, at = lloyd(vectors, 25, 4, 6, 8, "2:")
    most = centroids.LONGEST
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()), key=str) == sorted(((i, g, min(d, most)) for i, g, d in assigned), key=str)
    assert c.tolist() == at
    rows = centroids.with_inertia(out, c).collect()
    assert {r["inertia"] for r in rows} == {min(most, sum(min(d, most) for *_, d in assigned))}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[r["cluster"]])).encode()).hexdigest() for r in rows)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    heads = rng.integers(-2000, 2000, (40, 16))
    x = heads[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 16))
    groups = centroids.group(heads)
    assert 2 <= groups.max() + 1 <= 4
    own, above, below = centroids.first_assignment(x, heads, groups)
    moved = heads + rng.integers(-5, 6, heads.shape)
    again, above, below, scans = centroids.next_assignment(x, own, above, below, heads, moved, groups)
    assert (again == centroids.first_assignment(x, moved, groups)[0]).all() and scans.mean() < 4
    far = np.sqrt(centroids.squares(x, moved).astype(float))
    assert (above * (1 + 1e-6) + 1e-6 >= far[np.arange(len(x)), again]).all()
    far[np.arange(len(x)), again] = np.inf
    for g in range(groups.max() + 1):
        assert (below[:, g] <= far[:, groups == g].min(axis=1) * (1 + 1e-6) + 1e-6).all()


def test_few_or_no_vectors(spark):
    out, c = centroids.cluster(embedded(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])]), 40, 5, 2, 256, "2:")
    assert len(c) == 2 and {(r["vec_id"], r["cluster"], r["distance"]) for r in out.collect()} == {(1, 0, 0), (2, 0, 0)}
    out, c = centroids.cluster(embedded(spark, [(1, None)]), 40, 5, 2, 256, "2:")
    assert centroids.with_inertia(out, c).collect() == []


def test_clustering_query(spark):
    rows = queries.op11_centroid_clustering(spark, SF).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assigned, _ = lloyd(vectors, 40, 5, 64, 256, "2:")
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=str) == assigned


@pytest.mark.parametrize(("n", "below"), [(1, 1), (1, 9), (7, 100), (1000, 10), (3000, 10**6), (500, 1 << 62), (4096, 4096 * 300)])
def test_elias_fano(n, below):
    values = np.sort(np.random.default_rng(n).integers(0, below, n, dtype=np.uint64))
    data = token_files.EliasFano.encode(values)
    ef = token_files.EliasFano(data)
    assert ef.all().tolist() == values.tolist() == [ef.select(i) for i in range(n)]
    assert len(data) * 8 <= n * (2.2 + max(0, np.log2(below / n))) + 8 * 40


TEXTS = [None, "", "  \n", "a b", "a b", "<|endoftext|> x<|startoftext|>", "it's 'S x\x1cy\u0085z Éé́ ΑΣ 12,5 ß÷", "wörter straße " * 3000, "y" * 5000]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id bigint, text string, start string, value string")


def library(texts, end):
    t = Tokenizer.from_file(tokenizing.path("word_bpe_49k.json"))
    return [[*x.ids, end] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 3000)
    rows = [(10 * k - 300, t) for k, t in enumerate(TEXTS * 8)] + [(7, "same id"), (7, "same id"), (7, "another"), (None, "no id")]
    folder = f"file://{tmp_path}/ids"
    segments = token_files.write(documents(spark, rows).repartition(5), folder, "word_bpe_49k.json", 2, shards=4)
    assert segments.count() > 4
    before = token_files.write_manifest(segments, folder, "word_bpe_49k.json", 2)
    out = sorted(token_files.read(spark, folder).collect(), key=lambda r: r["start"])
    held = [r for r in rows if r[0] is not None]
    assert sorted((r["doc_id"], r["value"]) for r in out) == sorted(zip([i for i, _ in held], library([t for _, t in held], 2), strict=True))
    assert [r["doc_id"] for r in out] == sorted(i for i, _ in held)
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    # single documents, by two selects
    by_start = {r["start"]: (r["doc_id"], r["value"]) for r in out}
    for f in (tmp_path / "ids").glob("shard-*.ef"):
        s = token_files.Segment(f.read_bytes())
        for i in range(s.documents):
            doc_id, at, ids = s.document(i)
            assert by_start[before[int(f.name.split("-")[1])] + at] == (doc_id, ids.tolist())


def test_an_attempt_that_is_repeated_leaves_the_same_files(spark, tmp_path):
    docs = documents(spark, enumerate(TEXTS))
    made = []
    for _ in range(2):
        token_files.write(docs, str(tmp_path / "ids"), "word_bpe_49k.json", 2, shards=2)
        made.append({f.name: f.read_bytes() for f in (tmp_path / "ids").glob("*.ef")})
    assert made[0] == made[1] and len(made[0]) == 2


def test_token_files_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write_manifest(token_files.write(documents(spark, [(None, "x")]), folder, "word_bpe_49k.json", 2), folder, "word_bpe_49k.json", 2)
    assert token_files.read(spark, folder).collect() == []


def test_token_file_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = {}, 0
    for (i, _), ids in zip(docs, library([t for _, t in docs], 2), strict=True):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op12_token_files(spark, SF).collect()} == want
