"""Texts that a prompt shows: stored results, search results, memory. All are Columns; the clock is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import previews
from .text import estimate_tokens, result_id

# Names of tools' results.
LABELS = {"browser": "Browser Snapshot", "exec": "Command Output", "Read": "File Content", "web_fetch": "Web Content", "process": "Process Log"}
DEFAULT_LABEL = "Tool Output"
# What a preview says about ways to read more, by tool.
TIPS = {
    "browser": ('mode="full" - Get complete snapshot', 'mode="search", query="text" - Find specific elements', 'mode="lines", start_line=N, end_line=M - Get line range'),
    "exec": ('mode="search", query="error" - Find error messages', 'mode="lines", start_line=1, end_line=50 - Get first 50 lines', 'mode="around", line=100, context_lines=10 - Get context around line 100'),
    "Read": ('mode="full" - Get complete file', 'mode="lines", start_line=1, end_line=100 - Get specific line range', 'mode="search", query="function" - Find specific patterns'),
    "web_fetch": ('mode="full" - Get complete content', 'mode="search", query="keyword" - Find specific sections'),
}
DEFAULT_TIPS = ('mode="full" - Get complete output', 'mode="search", query="text" - Search for text', 'mode="lines", start_line=N, end_line=M - Get line range')
# A page's title in an accessibility snapshot; element types are the words after list marks.
TITLE = r"""(?i)(?:title|heading)[:\s]+["']?([^"'\n]+)"""
ELEMENT = r"(?m)(?:^|\n)\s*-\s*(\w+)"
BLANKS = " \n\t\r"
PREVIEW_TOKENS = 400


def iso(ts: Column) -> Column:
    """A moment as ISO 8601 in the session's time zone, to the millisecond."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def grouped(n: Column) -> Column:
    """A whole number with commas."""
    return F.format_number(n, 0)


def percent(score: Column) -> Column:
    return F.floor(F.coalesce(score, F.lit(0.0)) * 100 + 0.5).cast("string")


def element_counts(text: Column, top: int = 8) -> Column:
    """Of an accessibility snapshot: the most frequent element types as type:count, most first, then in order of appearance."""
    types = F.transform(F.regexp_extract_all(text, F.lit(ELEMENT), F.lit(1)), F.lower)
    # One walk over the types, which are few, for each different one.
    ordered = F.array_sort(F.transform(F.array_distinct(types), lambda x, i: F.struct((-F.size(F.filter(types, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("x"))))
    return F.array_join(F.transform(F.slice(ordered, 1, top), lambda s: F.concat(s["x"], F.lit(":"), (-s["n"]).cast("string"))), " ")


def about(tool: Column, text: Column) -> Column:
    """A line on what a result is, by tool; empty if there is nothing to say."""
    lines = F.concat(previews.line_count(text).cast("string"), F.lit(" lines"))
    title = F.substring(F.regexp_extract(text, TITLE, 1), 1, 50)
    browser = F.concat(F.when(title != "", F.concat(F.lit('"'), title, F.lit('" | '))).otherwise(""), element_counts(text))
    errors = F.concat(lines, F.when(previews.has_errors(text), " | ⚠️ Output may contain errors").otherwise(""))
    read = F.concat(lines, F.lit(" | "), previews.file_type(text))
    return F.when(tool == "browser", browser).when(tool == "exec", errors).when(tool == "Read", read).when(tool == "web_fetch", previews.web_title(text)).otherwise(lines)


def _by_tool(tool: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, value in values.items():
        out = F.when(tool == name, value).otherwise(out)
    return out


def _options(tips) -> str:
    return "".join(f"\n   • {t}" for t in tips)


def stored_result(tool: Column, text: Column, clock: Column, preview_tokens: int = PREVIEW_TOKENS) -> Column:
    """What stands for a large result: a mark with its id, its size, the beginning (of a command's output also the end), and how to read more."""
    rid, facts = result_id(text), about(tool, text)
    preview = F.when(tool == "exec", previews.exec_preview(text, preview_tokens)).otherwise(F.substring(text, 1, 4 * preview_tokens))
    head = F.concat(F.lit("[STORED: "), rid, F.lit("]\n\n📄 "), _by_tool(tool, {t: LABELS[t] for t in TIPS}, DEFAULT_LABEL), F.lit("\n📊 Size: ~"), grouped(estimate_tokens(text)), F.lit(" tokens\n"))
    line = F.concat(F.when(facts != "", F.concat(F.lit("📋 "), facts)).otherwise(""), F.lit("\n🕐 "), clock)
    body = F.concat(F.lit("\n\n--- PREVIEW ---\n"), F.btrim(preview, F.lit(BLANKS)), F.lit("\n--- END PREVIEW ---\n\n💡 Retrieve full content with: retrieve_tool_result(result_id=\""), rid, F.lit('")\n   Options:'))
    return F.concat(head, line, body, _by_tool(tool, {t: _options(x) for t, x in TIPS.items()}, _options(DEFAULT_TIPS)))


def _read_more(rid: Column, query: str) -> Column:
    return F.concat(F.lit('\n\n💡 Retrieve full: retrieve_tool_result(result_id="'), rid, F.lit(f'")\n   Options: mode="search", query="{query}" | mode="lines", start_line=N, end_line=M'))


def fallback_preview(text: Column, preview_tokens: int = PREVIEW_TOKENS) -> Column:
    """Of more than 20 lines the first and the last, 60 and 40 % of the characters; else the beginning, up to a line end in its last fifth."""
    most = 4 * preview_tokens
    cut = F.substring(text, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), "\n")
    lined = F.when(F.contains(cut, F.lit("\n")) & (last > 0.8 * most), F.substring(cut, F.lit(1), last)).otherwise(cut)
    begin = F.when(F.length(text) > most, F.concat(lined, F.lit("\n... [truncated]"))).otherwise(text)
    return F.when(previews.line_count(text) > 20, previews.head_and_tail(text, int(most * 0.6), int(most * 0.4))).otherwise(begin)


def summarised(tool: Column, text: Column, summary: Column, clock: Column, least: int = 150, most: int = 500, preview_tokens: int = PREVIEW_TOKENS) -> Column:
    """A result with its summary, clamped to `most` characters; without one, or with one under `least`, its preview."""
    rid = result_id(text)
    facts = F.concat(F.lit("📄 "), _by_tool(tool, LABELS, DEFAULT_LABEL), F.lit(" | ~"), grouped(estimate_tokens(text)), F.lit(" tokens | "), clock)
    short = F.when(F.length(summary) > most, F.concat(F.substring(summary, 1, most - 3), F.lit("..."))).otherwise(summary)
    good = F.concat(F.lit("[STORED: "), rid, F.lit("]\n"), facts, F.lit("\n\n"), short, _read_more(rid, "..."))
    hint = F.when(F.rlike(text, F.lit("(?i)error|ERR!|failed|exception|fatal")), "\n⚠️ Output may contain errors").otherwise("")
    preview = F.concat(F.lit("\n\n--- PREVIEW ---\n"), F.btrim(fallback_preview(text, preview_tokens), F.lit(BLANKS)), F.lit("\n--- END PREVIEW ---"))
    bad = F.concat(F.lit("[STORED: "), rid, F.lit("] ⚠️ Summarization unavailable\n"), facts, hint, preview, _read_more(rid, "error"))
    return F.when(F.length(F.coalesce(summary, F.lit(""))) >= least, good).otherwise(bad)


def search_result(text: Column, query: str, context: int = 5, max_tokens: int = 2000) -> Column:
    """Each line that holds the query, in any case, with the lines around it, until nine tenths of a budget are used."""
    lines = F.split(text, "\n", -1)
    low = F.lit(query.lower())
    hits = F.filter(F.transform(lines, lambda x, i: F.when(F.contains(F.lower(x), low), i)), lambda i: i.isNotNull())
    count = F.size(hits)
    head = F.concat(F.lit("Found "), count.cast("string"), F.when(count > 1, " matches").otherwise(" match"), F.lit(f' for "{query}":\n\n'))

    def block(at: Column) -> Column:
        begin = F.greatest(F.lit(0), at - context)
        near = F.transform(F.slice(lines, begin + 1, at - begin + 1 + context), lambda x, j: F.concat(F.when(j + begin == at, "> ").otherwise("  "), (j + begin + 1).cast("string"), F.lit(": "), x, F.lit("\n")))
        return F.concat(F.lit("--- Line "), (at + 1).cast("string"), F.lit(" ---\n"), F.array_join(near, ""), F.lit("\n"))

    def add(acc: Column, x: Column) -> Column:
        full = F.length(acc["out"]) > 0.9 * 4 * max_tokens
        more = F.concat(acc["out"], F.lit("\n... and "), (count - acc["n"]).cast("string"), F.lit(" more matches"))
        return F.when(acc["done"], acc).otherwise(F.struct(F.when(full, more).otherwise(F.concat(acc["out"], block(x))).alias("out"), (acc["n"] + 1).alias("n"), full.alias("done")))

    start = F.struct(head.alias("out"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    found = F.aggregate(hits, start, add, lambda acc: F.btrim(acc["out"], F.lit(BLANKS)))
    return F.when(count > 0, found).otherwise(F.lit(f'No matches found for "{query}"'))


def chunk_box(tool: Column, day: Column, score: Column, rid: Column, idx: Column, text: Column) -> Column:
    """One relevant chunk of a past result, in a frame."""
    lines = F.array_join(F.transform(F.split(text, "\n", -1), lambda x: F.concat(F.lit("│  "), x, F.lit("\n"))), "")
    rule = "─" * 41
    head = F.concat(F.lit("┌─ ["), F.coalesce(tool, F.lit("unknown")), F.lit("] "), F.coalesce(day, F.lit("unknown")), F.lit(" (relevance: "), percent(score), F.lit("%)\n│  Result ID: "), rid, F.lit("\n│  Chunk "), (idx + 1).cast("string"))
    return F.concat(head, F.lit(f"\n├{rule}\n"), lines, F.lit(f"└{rule}\n\n"))


def fact_line(category: Column, text: Column, score: Column) -> Column:
    return F.concat(F.lit("  • ["), F.coalesce(category, F.lit("general")), F.lit("] "), text, F.lit(" ("), percent(score), F.lit("%)\n"))


def summary_lines(topic: Column, text: Column, entities: Column, score: Column) -> Column:
    names = F.when(F.size(F.coalesce(entities, F.array().cast("array<string>"))) > 0, F.concat(F.lit("  │  Entities: "), F.array_join(entities, ", "), F.lit("\n"))).otherwise("")
    return F.concat(F.lit("  ┌─ "), topic, F.lit(" ("), percent(score), F.lit("%)\n  │  "), text, F.lit("\n"), names, F.lit("  └──\n"))


def tool_answer(rid: Column, tool: str, mode: str, lines: Column, content: Column, tokens: Column) -> Column:
    """The answer of a retrieval that worked."""
    head = F.concat(F.lit("📄 Retrieved from: "), rid, F.lit(f"\nTool: {tool} | Mode: {mode} | Total: "), lines.cast("string"), F.lit(" lines (~"), tokens.cast("string"), F.lit(" tokens)\n\n---\n"))
    return F.concat(head, content)


def tool_error(message: Column, hint: Column) -> Column:
    return F.concat(F.lit("❌ "), message, F.when(hint.isNotNull() & (hint != ""), F.concat(F.lit("\n💡 "), hint)).otherwise(""))
