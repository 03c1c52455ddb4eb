"""Line states, comments, imports and complexity on fixtures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparquill import plans
from sparquill.operators import source_lines as L

GO = """package a // first
/* block
 * TODO(ann): fix AB-12 soon
still */ x := "/* no */ // no" // yes
y := `raw
// not a comment
` + "a\\"b" /* in */ + z
/*/ open */ w
// FIXME later
"""


def scan(text, g):
    """Sign by sign: the comment, and the code with and without strings, of each line."""
    out, state = [], None
    for line in text.split("\n"):
        comment, code, bare, i = "", "", "", 0
        while i < len(line):
            rest = line[i:]
            if state is None:
                mark = next((m for m in g.line if rest.startswith(m)), None)
                block = next((b for b in g.block if rest.startswith(b[0])), None)
                if mark and block:
                    mark, block = (mark, None) if len(mark) > len(block[0]) else (None, block)
                quote = next((q for q in [*g.multi, *((q, q) for q in g.quotes)] if rest.startswith(q[0])), None)
                if mark:
                    comment += rest[len(mark) :]
                    break
                if block:
                    state, i = ("block", block[1]), i + len(block[0])
                    continue
                if quote:
                    state, i = ("multi" if quote in g.multi else "string", quote[1]), i + len(quote[0])
                    code, bare = code + quote[0], bare + quote[0]
                    continue
                code, bare, i = code + rest[0], bare + rest[0], i + 1
            elif state[0] != "block" and rest[0] == "\\" or not rest.startswith(state[1]):
                n = 2 if state[0] != "block" and rest[0] == "\\" else 1
                comment, code, i = comment + (rest[:n] if state[0] == "block" else ""), code + (rest[:n] if state[0] != "block" else ""), i + n
            else:
                i += len(state[1])
                if state[0] != "block":
                    code, bare = code + state[1], bare + state[1]
                state = None
        if state and state[0] == "string":
            state = None
        out.append((comment.strip(), code, bare))
    return out


def parted(spark, texts, language):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in L.lines_of(frame, language).orderBy("id", "line_no").collect():
        out.setdefault(r["id"], []).append((r["comment"], r["code"], r["bare"]))
    return [out.get(k) for k in range(len(texts))]


def test_comments_of_a_fixture(spark):
    rows = parted(spark, [GO, None, ""], L.C_LIKE)
    assert [c for c, _, _ in rows[0]] == ["first", "block", "TODO(ann): fix AB-12 soon", "still  yes", "", "", "in", "/ open", "FIXME later", ""]
    assert rows[0][3][1].strip() == 'x := "/* no */ // no"' and rows[0][5] == ("", "// not a comment", "")
    assert rows[1] is None and rows[2] == [("", "", "")]


@pytest.mark.parametrize("language", [L.C_LIKE, L.HASHED, L.MARKUP])
def test_states_of_random_files(spark, language):
    rng = random.Random(len(language.quotes))
    marks = [*language.line, *(x for b in [*language.block, *language.multi] for x in b), *language.quotes, "a", " ", "\n", "\n", "*", "/", "-", "<!-", "\\"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.choice([3, 20, 200]))) for _ in range(60)]
    star = lambda c: re.sub(r"^\*+\s?", "", c) if language is L.C_LIKE else c
    for text, rows in zip(texts, parted(spark, texts, language), strict=True):
        assert rows == [(star(c), code, bare) for c, code, bare in scan(text, language)], text


def test_marks_rules_and_density(spark):
    lines = L.lines_of(spark.createDataFrame([(1, GO)], "id int, text string"), L.C_LIKE)
    found = L.marked_comments(lines, {"TODO": "info", "FIXME": "warning", "BUG": "critical"}).orderBy("line_no").collect()
    assert [tuple(r) for r in found] == [(1, 3, "TODO", "ann", "fix AB-12 soon", "AB-12", "info"), (1, 9, "FIXME", None, "later", None, "warning")]
    assert sorted(tuple(r) for r in L.rule_hits(lines, {"no": "no", "later": "later", "raw": "raw"}).collect()) == [(1, 4, "no"), (1, 5, "raw"), (1, 6, "no")]
    many = "// a\n" * 6 + "x = 1\n" * 5 + "\n" * 20
    few = "// a\n" * 5 + "x = 1\n"
    plain = "// increment i\ni++\n// increment j\nj++\n" + "k\n" * 50
    df = spark.createDataFrame([(1, many), (2, few), (3, plain)], "id int, text string")
    assert sorted(r["id"] for r in L.excess_comments(L.lines_of(df, L.C_LIKE), "^increment ").collect()) == [1, 3]


def test_imports_with_blocks(spark):
    text = 'import "fmt"\nimport (\n  "os"\n  x "path" "second"\n)\n"not one"\n)\nimport "io"'
    rows = [(1, n, t) for n, t in enumerate(text.split("\n"), 1)]
    out = L.imports(spark.createDataFrame(rows, "id int, line_no int, text string"), "import (", ")", [("single", r'^import "([^"]+)"'), ("block", r'"([^"]+)"')])
    assert [(r["line_no"], r["target"]) for r in out.orderBy("line_no").collect()] == [(1, "fmt"), (3, "os"), (4, "path"), (8, "io")]


CODE = "func a() { if x { } for y { f = func() { if p && q { } } } } func b() { } func c() {" + " if x { }" * 14 + " } func d() {" + " if x && y { }" * 17


def test_complexity_gives_branches_to_the_innermost_function(spark):
    out = L.complexity(spark.createDataFrame([(1, CODE)], "id int, text string"), r"\{", r"\}", r"func[^{}]*\{", r"\bif\b|\bfor\b|&&|\|\|")
    rows = out.withColumn("severity", L.severity(F.col("complexity"))).orderBy("start").collect()
    assert [(r["complexity"], r["severity"]) for r in rows] == [(3, None), (3, None), (1, None), (15, "warning"), (35, "critical")]


def test_complexity_of_pages(spark):
    sf = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect():
        html = re.sub(r"<!--.*?-->", "", r["html"], flags=re.S)
        token = re.compile(r"<(?:nav|article|div|aside|footer)[^>]*>|<(?:a|li|p|td|h[1-6])[ >]|<(?:ul|ol|table|section|header)[^>]*>|</(?:nav|article|div|aside|footer|ul|ol|table|section|header)>")
        stack, count = [], {}
        found = token.findall(html)
        for at, t in enumerate(found):
            if re.match(r"<(?:nav|article|div|aside|footer)", t):
                stack.append(at)
                count[at] = 1
            elif re.match(r"<(?:ul|ol|table|section|header)", t):
                stack.append(None)
            elif t.startswith("</"):
                if stack:
                    stack.pop()
            else:
                inner = next((x for x in reversed(stack) if x is not None), None)
                if inner is not None:
                    count[inner] += 1
        want |= {(r["page_id"], at, n) for at, n in count.items()}
    assert {(r["id"], r["start"], r["complexity"]) for r in plans.QUERIES["f5_block_complexity"](spark, sf).collect()} == want
