"""Names and lines of source files as column expressions: languages, tests and their subjects, marked lines, secrets, display."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import lookup

#: Languages by extension, by whole name and by the interpreter of a first line.
EXTENSIONS = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "sh": "bash"}
FILENAMES = {"Makefile": "make", "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "Rakefile": "ruby"}
INTERPRETERS = {"python": "python", "python3": "python", "bash": "bash", "sh": "bash", "node": "javascript", "ruby": "ruby", "php": "php"}
#: Endings of test files and what stands in their place in the file that they test.
TEST_ENDINGS = {"_test.go": ".go", ".test.ts": ".ts", ".spec.ts": ".ts", ".test.tsx": ".tsx", ".spec.tsx": ".tsx"}


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(path: Column, content: Column, extensions: Mapping[str, str] = EXTENSIONS, filenames: Mapping[str, str] = FILENAMES, interpreters: Mapping[str, str] = INTERPRETERS) -> Column:
    """The language by extension (in any case), else by the whole file name, else by the first line's interpreter, else empty."""
    known = lambda key, values: lookup(key, dict(values), None)
    extension = F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))
    # of "#!/usr/bin/env -S python3 -u" the interpreter is python3
    interpreter = F.regexp_extract(content, r"\A#!\s*(?:\S*/)?(?:env\s+(?:-\S+\s+)*)?(?:\S*/)?([^\s/]+)", 1)
    return F.coalesce(known(extension, extensions), known(base_name(path), filenames), known(interpreter, interpreters), F.lit(""))


def subject_of_test(path: Column, endings: Mapping[str, str] = TEST_ENDINGS) -> Column:
    """The file that a test is for by its name, in the test's folder; null for a file that isn't named as a test."""
    base = base_name(path)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(base))
    out = F.when(F.startswith(base, F.lit("test_")) & F.endswith(base, F.lit(".py")), F.concat(folder, F.substring(base, F.lit(6), F.length(base))))
    for ending, then in reversed(endings.items()):
        out = F.when(F.endswith(base, F.lit(ending)), F.concat(folder, F.substring(base, F.lit(1), F.length(base) - len(ending)), F.lit(then))).otherwise(out)
    return out


def marked(line: Column, severities: Mapping[str, str]) -> Column:
    """keyword, owner, said, severity and ticket of a line's first keyword, as a struct; null for a line without one.

    KEYWORD(owner): said. Keywords are whole words in their own case; the ticket is the first one that `said` names.
    """
    pattern = rf"\b({'|'.join(severities)})\b(?:\(([^)]*)\))?\s*:?\s*(.*)$"
    part = lambda n: F.trim(F.regexp_extract(line, pattern, n))
    filled = lambda c: F.nullif(c, F.lit(""))
    ticket = F.regexp_extract(part(3), r"\b([A-Z][A-Z0-9]+-\d+)\b", 1)
    fields = F.struct(part(1).alias("keyword"), filled(part(2)).alias("owner"), part(3).alias("said"), lookup(part(1), dict(severities), None).alias("severity"), filled(ticket).alias("ticket"))
    return F.when(part(1) != "", fields)


def secrets(line: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """rule, severity and what was found, masked but for its first four letters, of each rule (name, severity, pattern) that a
    line breaks, as an array. The first group of a pattern is the secret."""

    def hit(name: str, severity: str, pattern: str) -> Column:
        secret = F.regexp_extract(line, pattern, 1)
        masked = F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(secret) - 4)))
        return F.when(secret != "", F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), masked.alias("masked")))

    return F.filter(F.array(*[hit(*r) for r in rules]), lambda h: h.isNotNull())


def shortened(text: Column, most: int) -> Column:
    """The text without blanks around it, cut after so many characters with an ellipsis."""
    bare = F.trim(text)
    return F.when(F.length(bare) <= most, bare).otherwise(F.concat(F.substring(bare, 1, most), F.lit("…")))


def shown_path(path: Column) -> Column:
    """The last part of a path after three dots; a path without folders, or that ends in one, as it is."""
    last = base_name(path)
    return F.when(F.coalesce(path, F.lit("")) == "", "an unknown file").when(F.contains(path, F.lit("/")) & (last != ""), F.concat(F.lit(".../"), last)).otherwise(path)


def fuzzy_trigger(prompt: Column, trigger: str, most: int = 2) -> Column:
    """Whether words of a prompt in lower case come near a trigger: a window of as many words, within an edit distance that
    grows with the trigger's length, by a third of one word and by a fifth of several, at least one and at most `most`."""
    words = trigger.split()
    n = len(words)
    share = len(trigger) // 3 if n == 1 else -(-len(trigger) // 5)
    allowed = max(1, min(most, share))
    near = lambda x: F.levenshtein(x, F.lit(trigger), allowed) >= 0
    parts = F.split(prompt, r"\s+")
    if n == 1:
        return F.exists(parts, near)
    starts = F.when(F.size(parts) >= n, F.sequence(F.lit(1), F.size(parts) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: near(F.array_join(F.slice(parts, i, F.lit(n)), " ")))
