"""Previews of large results by tool, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import estimate_tokens

# Tokens from which a tool's result is stored and shown as a preview.
THRESHOLDS = {"browser": 500, "exec": 1500, "Read": 2500, "web_fetch": 2500, "web_search": 10000, "process": 1500}
DEFAULT_THRESHOLD = 2000
# Kinds of files by what their text begins with or holds, first match wins.
FILE_MARKS = (("html", ("<!DOCTYPE", "<html")), ("javascript", ("import ", "export ")), ("python", ("def ", "import ")), ("go", ("package ", "func ")))


def is_large(tool: Column, text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair])
    return estimate_tokens(text) > F.coalesce(known[tool], F.lit(DEFAULT_THRESHOLD))


def file_type(text: Column) -> Column:
    out = F.lit("text")
    for kind, marks in reversed(FILE_MARKS):
        some = F.lit(False)
        for m in marks:
            some = some | F.contains(text, F.lit(m))
        out = F.when(some, kind).otherwise(out)
    return F.when(F.startswith(text, F.lit("{")) | F.startswith(text, F.lit("[")), "json").otherwise(out)


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1)).cast("long")


def web_title(text: Column) -> Column:
    """The first heading of level 1, up to 60 characters, or a stand-in."""
    title = F.substring(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), 1, 60)
    return F.when(title != "", title).otherwise("Article/page content")


def has_errors(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)error|ERR!|failed|exception"))


def head_lines(text: Column, chars: Column | int) -> Column:
    """How many lines fit, from the start, before the characters (with line ends) pass a limit."""
    return _fit(F.split(text, "\n", -1), chars)


def tail_lines(text: Column, chars: Column | int, head: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return F.least(_fit(F.reverse(lines), chars), F.size(lines) - head)


def _fit(lines: Column, chars) -> Column:
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(acc: Column, line: Column) -> Column:
        full = acc["full"] | (acc["used"] + F.length(line) > chars)
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + F.length(line) + 1).alias("used"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    return F.aggregate(lines, start, add, lambda acc: acc["n"])


def head_and_tail(text: Column, head_chars: int, tail_chars: int) -> Column:
    """The first and the last lines that fit, and between them how many are left out."""
    lines = F.split(text, "\n", -1)
    head = head_lines(text, head_chars)
    tail = tail_lines(text, tail_chars, head)
    ended = lambda some: F.array_join(F.transform(some, lambda x: F.concat(x, F.lit("\n"))), "")
    first = ended(F.slice(lines, F.lit(1), head))
    last = F.when(tail > 0, ended(F.slice(lines, F.size(lines) - tail + 1, tail))).otherwise("")
    return F.concat(first, F.lit("\n... ["), (F.size(lines) - head - tail).cast("string"), F.lit(" lines omitted] ...\n\n"), last)


def exec_preview(text: Column, preview_tokens: int = 400) -> Column:
    """The first and last lines, 60 and 40 % of the characters, and how many are left out."""
    most = 4 * preview_tokens
    head = head_lines(text, int(most * 0.6))
    left = F.size(F.split(text, "\n", -1)) - head - tail_lines(text, int(most * 0.4), head)
    return F.when(left > 0, head_and_tail(text, int(most * 0.6), int(most * 0.4))).otherwise(F.substring(text, 1, most))
