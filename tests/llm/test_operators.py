"""Operators against brute force on small tables with nulls, empty, long, repeated and tied rows and clashing columns."""

import hashlib
import random
import re
import time
import uuid
import zlib

import numpy as np
import pytest

from sparquill.llm import chat_format, common, decontaminate, html_extract, ngram_join, packing, quality, queries, suffix_array, suffix_dedup, syncmers, tokenizing, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    base = rng.choices(words, k=80)
    rows = [(0, None), (1, ""), (2, "one"), (3, "Two words"), (4, "two WORDS"), (5, passage), (6, "x " * 3000)]
    for i in range(10, 40):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(3, 120)))))
    for i in range(40, 130):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    for i in range(130, 140):
        rows.append((i, " ".join(rng.choices(words, k=20)) + "\n" + passage + "\né" + " ".join(rng.choices(words, k=10))))
    rows += [(10, rows[7][1]), (141, rows[8][1])]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id bigint, text string, n string, token int, spans int")


def expected_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("n", "num", "den", "small"), [(5, 8, 10, 32), (3, 90, 100, 2), (5, 8, 10, 2)])
def test_ngram_join(spark, monkeypatch, n, num, den, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rows = corpus()
    out = ngram_join.link_components(frame(spark, [*rows, (None, "lost")]), n, num, den).collect()
    want = expected_components(rows, n, num, den)
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want


def test_ngram_join_empty(spark):
    assert ngram_join.link_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("many", [4096, 1])
def test_suffix_array_against_sorting(monkeypatch, many):
    monkeypatch.setattr(suffix_array, "MANY", many)
    rng = np.random.default_rng(0)
    for _ in range(150):
        k = int(rng.integers(1, 5))
        t = np.concatenate([rng.integers(1, k + 1, int(rng.integers(1, 60))), [0]])
        b = t.tolist()
        sa = suffix_array.suffix_array(t, k + 1)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        shared = suffix_array.common_prefixes(t, sa, 7)
        for x, y in zip(sa, sa[1:], strict=False):
            m = 0
            while m < 7 and b[x + m : x + m + 1] == b[y + m : y + m + 1] and x + m < len(b) and y + m < len(b):
                m += 1
            assert shared[y] == m


def expected_removed(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        cut = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first.setdefault(b[k : k + length], i) < i:
                cut[k : k + length] = True
        out[i] = (len(b), hashlib.sha256(bytes(x for x, c in zip(b, cut, strict=True) if not c)).hexdigest(), int(cut.sum()), int((cut & ~np.concatenate([[False], cut[:-1]])).sum()) if len(b) else 0)
    return out


@pytest.mark.parametrize(("shard", "split", "entries"), [(1_500_000, 4000, 400_000), (200, 3, 400_000), (200, 3, 50)])
def test_suffix_dedup(spark, monkeypatch, shard, split, entries):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    monkeypatch.setattr(suffix_dedup, "ENTRIES", entries)
    rows = corpus(2)
    # a line that a third of the rows hold, with other neighbours in each
    line = "This line stands in very many of the documents of this table, whoever wrote them."
    rows += [(200 + i, f"{i * 7919 % 1000} before\n{line}\n{i * 104729 % 1000} after it comes {'more ' * (i % 13)}") for i in range(60)]
    out = suffix_dedup.dedupe(frame(spark, [*rows, (None, "lost")])).collect()
    want = expected_removed(rows)
    assert len(out) == len(rows)
    for r in out:
        got = (r["n_bytes"], hashlib.sha256(bytes(r["kept"])).hexdigest(), sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]))
        assert got == want[r["doc_id"]]
    assert suffix_dedup.dedupe(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_suffix_dedup_keeps_characters(spark):
    text = "é" * 60
    rows = [(1, "a" + text), (2, text + "b"), (3, None)]
    for r in suffix_dedup.dedupe(frame(spark, rows), characters=True, carry=("n", "spans")).collect():
        bytes(r["kept"]).decode("utf-8")
        assert (r["row"]["n"], r["row"]["spans"]) == ("x", 2)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    words = ["v%d" % i for i in range(200)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 50)))) for k in range(25)] + [(98, None), (99, " "), (97, "Rare phrase"), (96, "one two three four"), (96, "one two three four"), (None, "lost")]
    rows = [(0, None), (1, ""), (2, items[0][1]), (2, items[0][1]), (3, "a rare PHRASE inside"), (4, "rare, phrase"), (5, "one two three four"), (6, "two three four"), (7, "zero one two three four five"), (None, "rare phrase")]
    for i in range(10, 80):
        own = rng.choices(words, k=rng.randint(0, 300))
        if i % 3 == 0:
            w = items[i % 25][1].split()
            if i % 2 and len(w) > 20:
                w[3] = "changed"
            own[len(own) // 2 : len(own) // 2] = w
        rows.append((i, " ".join(own)))
    def runs(t, m):
        w = common.lower_words(t or "")
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()

    want = []
    for k, s in set(items):
        m = min(5, len(common.lower_words(s or "")))
        if m and k is not None:
            want += [(i, k) for i, t in rows if i is not None and len(runs(s, m) & runs(t, m)) * 10 >= 8 * len(runs(s, m))]
    want.sort()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, rows)
    out = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert out == want
    assert want
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect() if r["doc_id"] is not None) == sorted(i for i, _ in rows if i is not None and i not in {d for d, _ in want})
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.keep_clean(docs, none).count() == len(rows)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_packing_round_trip(spark):
    rows = corpus(4)
    out = packing.pack(frame(spark, rows)).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.path("byte_bpe_50k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    pieces, sequences = {}, {}
    for r in out:
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, p in pieces.items():
        copies = sum(1 for d, _ in rows if d == i)
        assert sum(n for _, n in p) == copies * len(ids[i])
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_cutting_stock_plan_is_tight(spark):
    assert spark.range(3).count() == 3  # the driver has started Spark: the solver must not stall in it
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 257, 20_000), minlength=257)[1:]
    sizes = np.flatnonzero(h) + 1
    plan = packing.solve(sizes, h[sizes - 1], 256)
    assert (sum(p * t for p, t in plan) == h[sizes - 1]).all()
    assert all(p @ sizes <= 256 for p, _ in plan)
    assert sum(t for _, t in plan) <= 1.01 * (h[sizes - 1] * sizes).sum() / 256


TEXTS = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "x<|endoftext|>y", "don't we'll\nI'm", "a b", "a  b", "12 345\n6", "héllo wörld.\nÇa va?", "\x01", "漢字 かな", "a\tb c", "!!! ...", "x" * 3000, "tail\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_encoder_equals_library(name):
    enc = tokenizing.Encoder(name)
    if name.endswith(".model"):
        one = enc.pieces.encode
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizing.path(name))
        one = lambda x: t.encode(x, add_special_tokens=False).ids
    for x in TEXTS:
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == one(x)
        assert enc.count(x) == len(one(x))


def test_token_count_cache(spark, tmp_path):
    cache = token_counts.CountCache(spark, str(tmp_path / f"cache-{uuid.uuid4().hex}"))
    rows = corpus(5)
    first = sorted(map(tuple, token_counts.count_tokens(frame(spark, rows), cache).collect()))
    held = spark.read.parquet(cache.path).count()
    assert held == len({t or "" for _, t in rows})
    assert sorted(map(tuple, token_counts.count_tokens(frame(spark, rows), cache).collect())) == first
    assert spark.read.parquet(cache.path).count() == held
    token_counts.count_tokens(frame(spark, [(1, "new text")]), cache).collect()
    assert spark.read.parquet(cache.path).count() == held + 1
    assert len(first) == len(rows)


def test_token_query_equals_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizing.path("byte_bpe_50k.json"))
    rows = [*corpus(9), (900, "lone \t tab"), (901, "many words " * 600), (902, "don't <|endoftext|> stop"), (None, "lost")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op8_token_counts(spark, str(tmp_path)).collect()
    want = sorted((i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows if i is not None)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in out) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in out)
    assert any(r["over_limit"] for r in out)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_counts.count_tokens(empty, token_counts.CountCache(spark, str(tmp_path / "none"))).count() == 0


def test_likeness_against_sets():
    """The likeness of fingerprints is near the Dice coefficient of the anchors' sets that they stand for."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(900)]
    a = " ".join(words)
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        b = " ".join(w if rng.random() < share or share == 1.0 else w[::-1] + "z" for w in words)
        x, y = ({int(h) for h in syncmers.anchors(t.encode())[1]} for t in (a, b))
        assert abs(syncmers.likeness(syncmers.fingerprint(a.encode()), syncmers.fingerprint(b.encode())) - 2 * len(x & y) / (len(x) + len(y))) < 0.12


def test_fingerprints(spark):
    rows = corpus(6)
    out = syncmers.compare_with_next(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    order = sorted(((i, t or "") for i, t in rows))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert any(r["doc_id"] == i and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t) and r["fingerprint"] == syncmers.fingerprint(t.encode()) for r in out)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    assert syncmers.compare_with_next(frame(spark, [(3, "alone")])).collect()[0]["near_edited"] > 0
    assert syncmers.compare_with_next(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_syncmers_are_context_free():
    a = b"the quick brown fox jumps over the lazy dog and runs far away from here"
    found = {int(h) for h in syncmers.anchors(a)[1]}
    assert {int(h) for h in syncmers.anchors(b"0123456789 something else " + a + b" more")[1]} >= found
    assert syncmers.matches(a, b"xx" + a)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\l \\b \\0 \\\\", "<|end|><|role|41|>", "[SYS] a [/SYS]", "", "é\n[/INST]</s>", "<|image|x|3|>"]
    rows = [(c, k, r, t) for c in (1, 2) for k, (r, t) in enumerate(zip(["system", "user", "assistant", "tool|>", "user", "assistant", None], nasty, strict=True))]
    df = spark.createDataFrame([*rows, (3, 0, "user", None), (None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    out = chat_format.format_chats(df.withColumn("parts", chat_format.text_part(df["text"])))
    got = out.select("conv_id", chat_format.read_back(out["formatted"]).alias("t"), chat_format.loss_text(out["formatted"], out["loss_spans"]).alias("l")).collect()
    by = {r["conv_id"]: r for r in got}
    assert set(by) == {1, 2, 3}
    assert [(t["role"], t["text"]) for t in by[1]["t"]] == [(r or "user", t) for _, _, r, t in rows[:7]]
    assert by[2]["l"] == nasty[2] + nasty[5]


def test_chat_parts(spark):
    df = spark.sql("select 1L as conv_id, 0L as turn, 'user' as role, array(named_struct('type','text','text','see','ref',cast(null as string),'width',cast(null as int),'height',cast(null as int),'seconds',cast(null as double),'pages',cast(null as int)), named_struct('type','image','text',cast(null as string),'ref','a|>.png','width',28,'height',15,'seconds',cast(null as double),'pages',cast(null as int))) as parts")
    r = chat_format.format_chats(df).collect()[0]
    assert r["formatted"].startswith("<s>[INST] see<|image|")
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a|>.png", 4)]


def test_html(spark):
    page = '<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head &amp; shoulders</h1><p><b>First para that is long enough.<br><p>Second  one,\n with more words in it.</p><div class="comments"><p>Nice post, I like it a lot!</p></div></article><script>var a = "<p>no</p>";</script><footer>&copy; us, all rights reserved</footer></body></html>'
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<<>>< <p"), (1, "u", page)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(out) == 5
    assert {r["page_id"]: r["text"] for r in out}[1] == "Head & shoulders\n\nFirst para that is long enough.\n\nSecond one, with more words in it."
    assert {r["page_id"]: r["text"] for r in out}[2] == ""


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><body><p>{}</p></body></html>",
        "<html><head><meta charset=x><p>{}</p></html>",
        "<body><button><p>{}</p></body>",
        "<body><article><p title=\"it>{}</p></article></body>",
        "<body><p data-x=\"<b>no</b>\" class='a>b'>{}</p></body>",
        "<body><!-- never closed? --><p>{}</p><!-- open",
    ],
)
def test_html_with_faults(page):
    text = "Here is a whole sentence of text, long enough to be content."
    assert html_extract.main_text(page.format(text), html_extract.fit()) == text


def test_html_is_linear():
    n = 20_000
    pages = [unit * n for unit in ('<p title="it>a ', '<p "', '<p a=">" ', "<! ", "<button>x", "<p '\"'\"", '<x ">" ', "<p a=\"b'>\" ")]
    pages += ["<b>x" * n + "</i>" * n, "<span>x" * n + "<h1>y</h1>" * n, "<p><table>" + "<span>" * n + "<h1></h1>" * n, "<p " + "a='>' " * n + ">x</p>"]
    for page in pages:
        began = time.process_time()
        html_extract.parse(page)
        assert time.process_time() - began < 10


STORY = "This paragraph is long enough to be an article's, with many words in it, and a full stop at its end. It goes on for a while, too."


@pytest.mark.parametrize("count", [10, 600, 5000])
def test_html_with_many_attributes(count):
    page = "<p " + " ".join(f'a{i}="{i}"' for i in range(count)) + f' title="1 > 0 leaked words">{STORY}</p>'
    assert html_extract.main_text(page, html_extract.fit()) == STORY


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<article class="comment-piece"><p>{STORY}</p><p>{STORY}</p></article>', f"{STORY}\n\n{STORY}"),
        (f'<article><p>{STORY}</p><section class="notice-of-award"><p>{STORY}</p></section></article>', f"{STORY}\n\n{STORY}"),
        (f'<article><p>{STORY}</p><section class="comment-list"><div class="comment odd"><p>{STORY}</p></div></section></article><div class="site-footer"><p>{STORY}</p></div>', STORY),
        (f"<article><p>{STORY} So E = <math><mi>m</mi></math> c2.</p></article>", f"{STORY} So E = m c2."),
        (f"<article><p>{STORY} Press <button><div>x</div></button> now <b>and</p><p>{STORY}</p></article>", f"{STORY} Press now and\n\n{STORY}"),
    ],
)
def test_html_by_text_and_class(page, text):
    assert html_extract.main_text(f"<html><body>{page}</body></html>", html_extract.fit()) == text


def test_html_tables(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.extract(none).count() == 0
    long = "<p>" + "A sentence with quite a few words in it. " * 20_000 + "</p>"
    df = spark.createDataFrame([(1, "u", long, "x", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    assert html_extract.extract(df).collect()[0]["text"] == long[3:-5]


def test_html_on_unseen_templates():
    w = html_extract.fit()
    good = 0
    for page in html_extract.labelled_pages(60, seed=77):
        want = "\n\n".join(n.text for n in html_extract.parse(page) if n.text and "\x02" in n.text).replace("\x02", "")
        good += html_extract.main_text(page.replace("\x02", ""), w) == want
    assert good >= 55


def test_marginals_are_exact():
    nodes = html_extract.parse("<div><p>one two three</p><ul><li>a</li></ul></div>")
    rng = random.Random(0)
    w = {f: rng.uniform(-1, 1) for n in nodes for f in n.features} | {(e, a, b): rng.uniform(-1, 1) for e in ("text", "block") for a in (0, 1) for b in (0, 1)}
    total, each = 0.0, np.zeros(len(nodes))
    for bits in range(1 << len(nodes)):
        s = [(bits >> k) & 1 for k in range(len(nodes))]
        z = sum(sum(w[f] for f in n.features) for n, x in zip(nodes, s, strict=True) if x)
        z += sum(w[(html_extract.edge(nodes[n.parent], n), s[n.parent], s[k])] for k, n in enumerate(nodes) if k)
        total += np.exp(z)
        each += np.exp(z) * np.array(s)
    assert np.allclose(html_extract.marginals(nodes, w)[0], each / total)


def test_deobfuscation():
    counts = np.zeros(toxicity.SYMBOLS**3, np.int64)
    for text in ["you stupid idiot moron", "the weather is fine today"] * 20:
        s = np.concatenate([[0, 0], toxicity.symbols(text), [0]])
        counts += np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)
    r = toxicity.Restorer(counts)
    assert [r.decode(x) for x in ("1d10t", "stuuuupid", "m.o.r.o.n")] == ["idiot", "stupid", "moron"]
    assert "stupid" in r.words("s t u p i d")
    assert r.words("") == set()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    r = toxicity.Restorer(rng.integers(0, 50, toxicity.SYMBOLS**3))
    for word in ("1d10t", "aab", "m.o", "s$a", "xx11", "@b-"):
        best = {}
        paths = [("", 0.0, 0, 0)]
        for i in range(len(word)):
            paths = [(done + out, p + cost + (r.log[a][b][toxicity.symbol(out)] if out else 0.0), *((b, toxicity.symbol(out)) if out else (a, b))) for done, p, a, b in paths for out, cost in r.options(word, i)]
        for done, p, a, b in paths:
            best[done] = max(best.get(done, -1e9), p + r.log[a][b][0])
        assert np.isclose(best[r.decode(word)], max(best.values()))


def test_machine_against_pair_sums():
    rng = np.random.default_rng(4)
    w, v = rng.normal(size=30), rng.normal(size=(30, 5))
    i, x = np.array([1, 4, 9, 20]), rng.normal(size=4)
    pairs = sum(x[a] * x[b] * (v[i[a]] * v[i[b]]).sum() for a in range(4) for b in range(a))
    assert np.isclose(quality.raw(w, v, i, x)[0], (w[i] * x).sum() + pairs)


def test_toxic_precision_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    both = sum(r["predicted"] * r["toxic"] for r in rows)
    assert both / sum(r["predicted"] for r in rows) >= 0.9
    assert both / sum(r["toxic"] for r in rows) >= 0.9


def test_weights_minimise_the_penalised_loss():
    rng = np.random.default_rng(2)
    rows = [(int(rng.random() < (0.9 if 0 in h or 3 in h else 0.1)), h) for h in ([int(f) for f in np.flatnonzero(rng.random(6) < 0.4)] for _ in range(300))]

    def loss(w, b):
        z = np.array([sum(w[f] for f in h) + b for _, h in rows])
        y = np.array([y for y, _ in rows])
        return (np.where(y > 0, toxicity.TOXIC_WEIGHT, 1.0) * np.log1p(np.exp(np.where(y > 0, -z, z)))).sum() + toxicity.RIDGE / 2 * (w**2).sum()

    w, b = toxicity.logistic(rows, 6)
    assert all(loss(w + d, b) >= loss(w, b) - 1e-3 for d in 0.05 * np.vstack([np.eye(6), -np.eye(6)])) and w[0] > 1 and w[3] > 1
    assert toxicity.logistic([], 3)[1] == toxicity.PRIOR and toxicity.logistic([(1, [])], 0)[1] == toxicity.PRIOR


def test_a_query_meets_stored_counts(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k % 60}", "x", f"src{k % 5}", 1) for k in range(100)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    caches = []
    monkeypatch.setattr(token_counts, "CountCache", lambda s, path, make=token_counts.CountCache: caches.append(make(s, path)) or caches[-1])
    out = queries.op8_token_counts(spark, str(tmp_path)).collect()
    digests = spark.read.parquet(caches[0].path).count()
    assert len(out) == 100 and digests == 60  # none was encoded twice


@pytest.mark.parametrize(("name", "label", "least"), [("op10_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", label).collect()
    assert all(0 <= r["score"] <= 1 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) / len(rows) >= least


@pytest.mark.parametrize("module", ["toxicity", "quality"])
def test_classifiers_on_odd_rows(spark, module):
    import importlib

    m = importlib.import_module(f"sparquill.llm.{module}")
    label = "toxic" if module == "toxicity" else module
    docs = frame(spark, corpus(8))
    model = m.fit(docs, spark.createDataFrame([], f"doc_id bigint, {label} int"))
    assert m.scores(docs, model).count() == len(corpus(8))
    assert m.scores(docs.limit(0), model).count() == 0
    assert m.scores(docs.unionByName(frame(spark, [(None, "lost")])), model).count() == len(corpus(8))
