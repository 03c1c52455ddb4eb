"""Lines of source files: which parts are comments, strings and code, and what is counted in code.

A language names its comment marks and quotes. In strings a backslash takes the meaning of the next sign. What a line does to the state (code, within a block comment, within a string
that spans lines) is a small map from the state before it to the state after it, whatever came before; the maps of a file's
lines are composed by doubling, so the state before each line takes log2(lines) passes over the file and no driver or Python.
A file is one row of text; its lines are arrays within that row, and only results become rows.

Null texts have no lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored


@dataclass(frozen=True)
class Language:
    """Marks of a language. multi: quotes of strings that may span lines."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    quotes: tuple[str, ...] = ()
    multi: tuple[tuple[str, str], ...] = ()


C_LIKE = Language(("//",), (("/*", "*/"),), ('"', "'"), (("`", "`"),))
HASHED = Language(("#",), (), ('"', "'"), (('"""', '"""'), ("'''", "'''")))
MARKUP = Language((), (("<!--", "-->"),))


CODE, COMMENT, STRING = "code", "comment", "string"


class Automaton:
    """What each sign does to the state, worked out once for a language.

    A state is a mode (code first, then the modes that outlast a line, then the others) and the signs of a mark that may be
    under way; in each mode only its own marks count, the longest first. Text between signs of marks is one step.
    """

    def __init__(self, language: Language):
        g = language
        self.kinds, self.marks, starts = [CODE], [{}], {}
        for kind, pairs in ((COMMENT, g.block), (STRING, g.multi), (COMMENT, [(m, "") for m in g.line]), (STRING, [(q, q) for q in g.quotes])):
            for start, end in pairs:
                starts[start] = len(self.kinds)
                self.kinds.append(kind)
                self.marks.append({end: 0} if end else {})
        self.marks[0] = starts
        self.lasting = 1 + len(g.block) + len(g.multi)
        whole = {mark for m in self.marks for mark in m} | ({"\\"} if g.quotes or g.multi else set())
        self.any_mark = "|".join(re.escape(m) for m in sorted(whole))
        self.signs = sorted({c for m in self.marks for mark in m for c in mark} | ({"\\"} if g.quotes or g.multi else set()))
        self.states = [(m, "") for m in range(len(self.kinds))]
        self.table: list[tuple] = []  # for each state and sign, the text between signs last: next state, and what is written
        self.ends: list[tuple] = []
        for state in self.states:  # grows while it is read
            self.table += [self._step(state, c) for c in [*self.signs, None]]
            self.ends.append(self._step(state, ""))

    def _step(self, state: tuple[int, str], sign: str | None) -> tuple:
        """sign: None for text between signs, "" for the end of the line."""
        mode, held = state
        out = {"comment": "", "code": "", "bare": "", "marked": self.kinds[mode] == COMMENT}

        def write(text: str, kind: str) -> None:
            for name in {CODE: ("code", "bare"), COMMENT: ("comment",), STRING: ("code",)}[kind]:
                out[name] += text

        held += sign or ""
        while held:
            marks = self.marks[mode]
            if self.kinds[mode] == STRING and held[0] == "\\":
                if len(held) == 1 and sign:
                    break  # the next sign is part of the string, whatever it is
                write(held[:2], STRING)
                held = held[2:]
                continue
            if sign and any(m.startswith(held) and m != held for m in marks):
                break
            mark = max((m for m in marks if held.startswith(m)), key=len, default=None)
            if mark is None:
                write(held[0], self.kinds[mode])
                held = held[1:]
                continue
            then = marks[mark]
            kind = self.kinds[then or mode]
            if kind == COMMENT:
                out["marked"] = True
            else:
                write(mark, CODE)
            mode, held = then, held[len(mark) :]
        if sign == "":
            return (mode if mode < self.lasting else 0, out)
        if (mode, held) not in self.states:
            self.states.append((mode, held))
        return (self.states.index((mode, held)), out)

    def of(self, rows: list[tuple], name: str, at: Column) -> Column:
        values = [r[0] if name == "next" else r[1][name] for r in rows]
        return F.lit(values[0]) if len(set(values)) == 1 else F.element_at(F.array(*map(F.lit, values)), at)

    def split(self, line: Column) -> Column:
        signs = "".join("\\" + c for c in self.signs)
        return F.regexp_extract_all(line, F.lit(f"[{signs}]|[^{signs}]+"), F.lit(0))

    def place(self, state: Column, part: Column) -> Column:
        """Where the table has a state and a part of a line."""
        at = F.array_position(F.array(*map(F.lit, self.signs)), part).cast("int")
        return state * (len(self.signs) + 1) + F.when(at == 0, len(self.signs) + 1).otherwise(at)

    def plain(self, line: Column) -> Column:
        """Whether a line holds no whole mark, so that the state stays and all of it is of the state's kind."""
        return ~F.rlike(line, F.lit(self.any_mark))

    def map_of(self, line: Column) -> Column:
        """The state after the line for each lasting state before it."""
        starts, parts = F.array(*map(F.lit, range(self.lasting))), self.split(line)
        through = lambda s: F.aggregate(parts, s, lambda a, x: self.of(self.table, "next", self.place(a, x)))
        return F.when(self.plain(line), starts).otherwise(F.transform(starts, lambda s: self.of(self.ends, "next", through(s) + 1)))

    def before_lines(self, lines: Column) -> Column:
        """The state before each line: maps composed over 1, 2, 4, ... lines."""
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.size(lines))).cast("int")))

        def double(maps: Column, k: Column) -> Column:
            back = F.call_function("shiftleft", F.lit(1), k)
            joined = lambda m, i: F.transform(F.element_at(maps, i - back + 1), lambda x: F.element_at(m, x + 1))
            return F.transform(maps, lambda m, i: F.when(i >= back, joined(m, i)).otherwise(m))

        maps = F.aggregate(steps, F.transform(lines, self.map_of), double)
        return F.concat(F.array(F.lit(0)), F.transform(F.slice(maps, F.lit(1), F.size(maps) - 1), lambda m: F.element_at(m, 1)))

    def parts(self, line: Column, before: Column) -> Column:
        """comment, code (with strings), bare (without what is in strings) and marked (whether a comment is there)."""
        into = {CODE: ("code", "bare"), COMMENT: ("comment",), STRING: ("code",)}
        modes = {name: [k for k, (m, _) in enumerate(self.states) if name in into[self.kinds[m]]] for name in ("comment", "code", "bare")}

        def put(acc: Column, state: Column, written: dict[str, Column], marked: Column) -> Column:
            return F.struct(state.alias("s"), *[F.concat(acc[n], x).alias(n) for n, x in written.items()], (acc["marked"] | marked).alias("marked"))

        def step(acc: Column, part: Column) -> Column:
            at = self.place(acc["s"], part)
            then = self.of(self.table, "next", at)
            between = (at - 1) % (len(self.signs) + 1) == len(self.signs)
            own = lambda n: F.when(between & then.isin(modes[n]), part).otherwise("")
            return put(acc, then, {n: F.concat(self.of(self.table, n, at), own(n)) for n in modes}, self.of(self.table, "marked", at))

        start = F.struct(before.alias("s"), *[F.lit("").alias(n) for n in modes], before.isin([k for k in range(self.lasting) if self.kinds[k] == COMMENT]).alias("marked"))
        last = lambda acc: put(acc, self.of(self.ends, "next", acc["s"] + 1), {n: self.of(self.ends, n, acc["s"] + 1) for n in modes}, self.of(self.ends, "marked", acc["s"] + 1))
        of_kind = {name: before.isin([m for m in range(self.lasting) if name in into[self.kinds[m]]]) for name in modes}
        whole = F.struct(before.alias("s"), *[F.when(c, line).otherwise("").alias(n) for n, c in of_kind.items()], start["marked"].alias("marked"))
        return F.when(self.plain(line), whole).otherwise(F.aggregate(self.split(line), start, step, last))


def lines_of(files: DataFrame, language: Language) -> DataFrame:
    """id, line_no (from 1), text, comment, code, bare, marked of files (id, text)."""
    a = Automaton(language)
    rows = files.select("id", F.split("text", "\n").alias("lines")).withColumn("before", a.before_lines(F.col("lines")))
    lined = rows.select("id", F.posexplode(F.arrays_zip("lines", "before")).alias("p", "l"))
    parted = lined.select("id", (F.col("p") + 1).alias("line_no"), F.col("l.lines").alias("text"), a.parts(F.col("l.lines"), F.col("l.before")).alias("x"))
    # lines within a block comment often begin with a star
    star = F.regexp_replace(F.trim("x.comment"), r"^\*+\s?", "") if ("/*", "*/") in language.block else F.trim("x.comment")
    return parted.select("id", "line_no", "text", star.alias("comment"), "x.code", "x.bare", "x.marked")


def marked_comments(lines: DataFrame, severities: dict[str, str]) -> DataFrame:
    """id, line_no, keyword, owner, said, ticket, severity of comments that hold one of the keywords, in capitals as given."""
    rule = rf"\b({'|'.join(map(re.escape, severities))})\b(?:\(([^)]*)\))?\s*:?\s*(.*)$"
    held = lines.where(F.rlike("comment", F.lit(rule)))
    part = lambda k: F.trim(F.regexp_extract("comment", rule, k))
    none = lambda c: F.nullif(c, F.lit(""))
    severity = F.coalesce(*[F.when(part(1) == k, F.lit(v)) for k, v in severities.items()])
    ticket = none(F.regexp_extract(part(3), r"\b([A-Z][A-Z0-9]+-[0-9]+)\b", 1))
    return held.select("id", "line_no", part(1).alias("keyword"), none(part(2)).alias("owner"), part(3).alias("said"), ticket.alias("ticket"), severity.alias("severity"))


def rule_hits(lines: DataFrame, rules: dict[str, str]) -> DataFrame:
    """id, line_no, rule of code that matches a rule; comments don't count."""
    hits = F.filter(F.array(*[F.when(F.rlike("code", F.lit(p)), F.lit(r)) for r, p in rules.items()]), lambda r: r.isNotNull())
    return lines.select("id", "line_no", F.explode(hits).alias("rule"))


def excess_comments(lines: DataFrame, obvious: str, share: float = 0.3, most: int = 5, least_obvious: int = 2) -> DataFrame:
    """id, comments, filled, plain of files whose comment lines are too many or too obvious.

    A comment line is a line with nothing but a comment on it; `obvious` matches comments that say what the code says.
    """
    alone = F.col("marked") & (F.trim("code") == "")
    counted = lines.groupBy("id").agg(F.count_if(alone).alias("comments"), F.count_if(F.trim("text") != "").alias("filled"), F.count_if(alone & F.rlike("comment", F.lit(obvious))).alias("plain"))
    return counted.where((F.col("plain") >= least_obvious) | ((F.col("comments") > most) & (F.col("comments") > share * F.col("filled"))))


def imports(lines: DataFrame, block_start: str, block_end: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """id, line_no, target: the first pattern that matches a line (id, line_no, text) names what it imports.

    patterns: where they hold ("block", "single" or "" for anywhere) and an expression with one group. A line that holds the
    start outside of a block opens one, a line that is the end closes it; neither is an import.
    """
    start, end = F.contains("text", F.lit(block_start)), F.trim("text") == block_end
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(F.when(end, False).when(start, True), ignorenulls=True).over(w), F.lit(False))
    held = lines.withColumn("inside", state).where(~(F.when(F.col("inside"), end).otherwise(start)))
    where = {"block": F.col("inside"), "single": ~F.col("inside"), "": F.lit(True)}
    target = F.coalesce(*[F.when(where[at] & F.rlike("text", F.lit(p)), F.regexp_extract("text", p, 1)) for at, p in patterns])
    return held.select("id", "line_no", target.alias("target")).where("target is not null")


def complexity(files: DataFrame, opening: str, closing: str, head: str, branch: str) -> DataFrame:
    """id, start, end, complexity of each function of code (id, text) without comments and strings.

    head: what opens a function's body, the opening mark included; opening, closing: marks of other blocks. Marks are numbered
    in order; a mark's partner is the next closing one of its level. A branch counts for the function that opened last among
    those around it and for no outer one; a function without branches has 1. Functions that nothing closes end with their
    file.
    """
    token = f"(?:{head})|(?:{branch})|(?:{opening})|(?:{closing})"
    t = files.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("at", "token"))
    is_ = lambda p: F.rlike("token", F.lit(f"^(?:{p})$"))
    kind = F.when(is_(head), "head").when(is_(branch), "branch").when(is_(opening), "open").otherwise("close")
    # written, as functions and branches both read it
    t = stored(t.select("id", "at", kind.alias("kind")))
    order = Window.partitionBy("id").orderBy("at")
    depth = F.sum(F.when(F.col("kind").isin("head", "open"), 1).when(F.col("kind") == "close", -1).otherwise(0)).over(order)
    t = t.withColumn("depth", depth).withColumn("last", F.max("at").over(Window.partitionBy("id")))
    marks = t.where("kind <> 'branch'").withColumn("level", F.col("depth") + F.when(F.col("kind") == "close", 1).otherwise(0))
    end = F.min(F.when(F.col("kind") == "close", F.col("at"))).over(Window.partitionBy("id", "level").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    functions = marks.withColumn("end", F.coalesce(end, F.col("last") + 1)).where("kind = 'head'").select("id", F.col("at").alias("start"), "end")
    from .relational import narrowest_range

    points = t.where("kind = 'branch'").select("id", "at", F.concat_ws(":", "id", "at").alias("point"))
    owned = narrowest_range(points, functions, "id", "at", "start", "end", "point", "start").withColumn("id", F.split_part("point", F.lit(":"), F.lit(1)).cast(files.schema["id"].dataType))
    counts = owned.groupBy("id", "start").agg(F.count("*").alias("n"))
    return functions.join(counts, ["id", "start"], "left").select("id", "start", "end", (F.coalesce("n", F.lit(0)) + 1).alias("complexity"))


def severity(score: Column, warning: int = 15, critical: int = 34) -> Column:
    return F.when(score >= critical, "critical").when(score >= warning, "warning")
