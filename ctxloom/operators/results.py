"""Store of large results: saving, chunks, and four ways to read one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.errors import MemoryError_
from ctxloom.functions import previews, render
from ctxloom.functions.text import estimate_tokens, full_within, line_range, result_id, short_hash
from ctxloom.functions.vector import cosine, hash_embedding


def save(new: DataFrame, stored: DataFrame | None = None, *, text: str = "text", order: str = "id") -> DataFrame:
    """One row for each different text that the store lacks: result_id, content_hash, token_count, the first writer, how often it was written."""
    hashed = new.select(short_hash(F.col(text)).alias("content_hash"), result_id(F.col(text)).alias("result_id"), estimate_tokens(F.col(text)).alias("token_count"), F.col(order).alias("__o"))
    one = hashed.groupBy("content_hash").agg(F.min("result_id").alias("result_id"), F.max("token_count").alias("token_count"), F.min("__o").alias("first_writer"), F.count("*").alias("writes"))
    return one.join(stored.select("content_hash"), "content_hash", "left_anti") if stored is not None else one


def exists(new: DataFrame, stored: DataFrame, *, text: str = "text") -> DataFrame:
    return new.withColumn("content_hash", short_hash(F.col(text))).join(stored.select("content_hash"), "content_hash", "left_semi")


def fixed_chunks(text: Column, size: int = 2000, overlap: int = 200) -> Column:
    """array<struct<chunk_idx, start_offset, end_offset, chunk_text>> at a fixed stride; the last chunk is the one that reaches the end."""
    if not 0 <= overlap < size:
        raise MemoryError_("INVALID_OVERLAP", "overlap must be smaller than the chunk")
    stride, n = size - overlap, F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / F.lit(float(stride)))).cast("int")
    one = lambda i: F.struct(i.alias("chunk_idx"), (i * stride).alias("start_offset"), F.least(i * stride + size, n).alias("end_offset"), F.substring(text, i * stride + 1, F.lit(size)).alias("chunk_text"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one))


def chunk_ends(text: str, size: int, overlap: int, marks: tuple[str, ...], least: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk of a text, in order."""
    at, n = 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n:
            best = max(text.rfind(m, at, end) for m in marks) - at
            end = at + best + 1 if best > least else end
        yield at, end
        if end >= n:
            return
        at = end - overlap


def bounded_chunks(df: DataFrame, *, keys: list[str], text: str = "text", size: int = 2000, overlap: int = 200, marks: tuple[str, ...] = (". ", "\n\n"), within: int | None = None) -> DataFrame:
    """keys, chunk_idx, start_offset, end_offset, chunk_text: a chunk ends after the last mark in its second half (or its last `within` characters), if there is one.

    Where a chunk starts depends on where the one before ended, so each text is
    walked once, in its row, in Arrow batches and without a shuffle.
    """
    if not 0 <= overlap < size // 2:
        raise MemoryError_("INVALID_OVERLAP", "overlap must be under half a chunk")
    least = size // 2 if within is None else size - within
    new = [T.StructField("chunk_idx", T.IntegerType()), T.StructField("start_offset", T.IntegerType()), T.StructField("end_offset", T.IntegerType()), T.StructField("chunk_text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows, out = [], []
                for r, t in enumerate(part.column(len(keys)).to_pylist()):
                    found = [(i, s, e, t[s:e]) for i, (s, e) in enumerate(chunk_ends(t or "", size, overlap, marks, least))]
                    rows += [r] * len(found)
                    out += found
                made = zip(*out) if out else [()] * 4
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows, pa.int64())) for c in range(len(keys))), *(pa.array(m, k) for m, k in zip(made, kinds))], [*keys, *(f.name for f in new)])

    chosen = df.select(*keys, text)
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[: len(keys)], *new]))


def save_with_chunks(new: DataFrame, *, text: str = "text", order: str = "id", size: int = 2000, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """The stored results, one for each different text, and their chunks: chunk_id (of result and place, so that a second run gives it again), result_id, chunk_idx, offsets, chunk_text, token_count, embedding."""
    results = save(new, text=text, order=order)
    # A result's id is 32 bits of its hash, which different texts come to share; the whole hash tells them apart.
    one = new.select(result_id(F.col(text)).alias("result_id"), F.sha2(text, 256).alias("__h"), F.col(text).alias("full_result")).dropDuplicates(["__h"]).drop("__h")
    cut = bounded_chunks(one, keys=["result_id"], text="full_result", size=size, overlap=overlap)
    chunk_id = F.concat(F.lit("ch_"), F.substring(F.sha2(F.concat_ws(":", "result_id", F.col("chunk_idx").cast("string")), 256), 1, 12))
    return results, cut.withColumn("chunk_id", chunk_id).withColumn("token_count", estimate_tokens(F.col("chunk_text"))).withColumn("embedding", hash_embedding(F.col("chunk_text")))


def chunks_of(chunks: DataFrame, rid: str) -> DataFrame:
    """The chunks of one result, in order."""
    return chunks.where(F.col("result_id") == rid).orderBy("chunk_idx")


def top_chunks(chunks: DataFrame, query_vector: list[float], *, k: int, least: float = 0.7, id_col: str = "chunk_id", results: DataFrame | None = None, tool: str | None = None, session: str | None = None) -> DataFrame:
    """The k most similar chunks at or above least; without a sort of all of them.

    results (result_id, tool_name, session_id, created_at) enriches what was
    found. Only a filter by tool or session needs it before: results that
    fail it drop their chunks.
    """
    rows = chunks.where(F.col("embedding").isNotNull())
    if results is not None and (tool is not None or session is not None):
        fit = F.lit(True) if tool is None else F.col("tool_name") == tool
        fit = fit if session is None else fit & (F.col("session_id") == session)
        rows = rows.join(results.where(fit).select("result_id").distinct(), "result_id", "left_semi")
    scored = rows.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 6))
    found = scored.where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)
    return found if results is None else found.join(results, "result_id", "left")


def newest_similar(index: DataFrame, query_vector: list[float], *, k: int = 10, scan: int = 1000, tool: str | None = None, session: str | None = None, id_col: str = "id") -> DataFrame:
    """Of the `scan` newest rows of the tool-result index, of one tool or session if asked for, the k most similar. The cap is the store's own."""
    rows = index if tool is None else index.where(F.col("tool_name") == tool)
    rows = rows if session is None else rows.where(F.col("session_key") == session)
    newest = rows.orderBy(F.desc("created_at"), F.desc(id_col)).limit(scan)
    scored = newest.withColumn("score", F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), 6))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def rag_context(chunks: DataFrame) -> DataFrame:
    """One row, context: the chunks found (tool_name, created_at, score, result_id, chunk_idx, chunk_text, as top_chunks() limits them) in frames, best first."""
    box = render.chunk_box(F.col("tool_name"), F.date_format("created_at", "yyyy-MM-dd"), F.col("score"), F.col("result_id"), F.col("chunk_idx"), F.col("chunk_text"))
    boxes = chunks.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "result_id", "chunk_idx", box.alias("b")))).alias("x"))
    head = "📚 RELEVANT TOOL RESULTS FROM PAST:\n\n"
    return boxes.select(F.when(F.size("x") > 0, F.concat(F.lit(head), F.array_join(F.transform("x", lambda x: x["b"]), ""))).otherwise("").alias("context"))


def lines_of(df: DataFrame, *, keys: list[str], text: str = "text") -> DataFrame:
    """keys, line (from 1), content."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("p", "content")).select(*keys, (F.col("p") + 1).cast("long").alias("line"), "content")


def search_lines(df: DataFrame, query: str, *, keys: list[str], text: str = "text", context: int = 2) -> DataFrame:
    """Lines that hold the query, in any case, and the `context` lines around: keys, line, content, is_match. Only texts that hold it are cut into lines."""
    hit = F.contains(F.lower("content"), F.lit(query.lower()))
    rows = lines_of(df.where(F.contains(F.lower(text), F.lit(query.lower()))), keys=keys, text=text).withColumn("is_match", hit)
    near = F.max("is_match").over(Window.partitionBy(*keys).orderBy("line").rowsBetween(-context, context))
    return rows.withColumn("__near", near).where("__near").drop("__near")


def around_line(df: DataFrame, line: int, *, keys: list[str], text: str = "text", context: int = 5) -> DataFrame:
    return lines_of(df, keys=keys, text=text).where(F.col("line").between(line - context, line + context))


def search_summary(df: DataFrame, query: str, *, keys: list[str], text: str = "text") -> DataFrame:
    """keys, match_count, matches (the first ten line numbers)."""
    at = F.transform(F.split(text, "\n", -1), lambda x, i: F.when(F.contains(F.lower(x), F.lit(query.lower())), i + 1))
    return df.select(*keys, F.array_compact(at).alias("a")).select(*keys, F.size("a").cast("long").alias("match_count"), F.slice("a", 1, 10).alias("matches"))


def retrieve(results: DataFrame, rid: str, mode: str = "full", *, query: str | None = None, line: int | None = None, start_line: int = 1, end_line: int | None = None, context_lines: int = 5, max_tokens: int = 2000) -> DataFrame:
    """One stored result, read whole (within a budget), by search, by line range or around a line."""
    row = results.where(F.col("result_id") == rid)
    text = F.col("full_result")
    if mode == "full":
        return row.select("result_id", full_within(text, max_tokens).alias("content"))
    if mode == "search":
        if not query:
            raise MemoryError_("MISSING_QUERY", "query is required for search")
        return search_lines(row, query, keys=["result_id"], text="full_result", context=context_lines)
    if mode == "lines":
        return row.select("result_id", line_range(text, max(1, start_line), end_line or start_line + 100, max_tokens).alias("content"))
    if mode == "around":
        if line is None:
            raise MemoryError_("MISSING_LINE", "line is required for around")
        return around_line(row, line, keys=["result_id"], text="full_result", context=context_lines)
    raise MemoryError_("INVALID_MODE", f"{mode!r} is none of full, search, lines, around")


def stats(results: DataFrame) -> DataFrame:
    """How many, their tokens and characters, and how many have been read since."""
    return results.agg(F.count("*").alias("results"), F.sum("token_count").alias("tokens"), F.sum(F.length("full_result")).alias("chars"), F.count_if(F.col("accessed_at") > F.col("created_at")).alias("accessed"))


def process(rows: DataFrame, *, tool: str = "tool_name", text: str = "text", clock: Column | None = None) -> DataFrame:
    """rows with is_large and shown: large results as a stored mark and a preview by tool, others whole; and tokens before and after. What is stored already stays."""
    t, body = F.col(tool), F.col(text)
    clock = F.lit("") if clock is None else clock
    out = rows.withColumn("is_large", previews.is_large(t, body) & ~is_stored(body))
    out = out.withColumn("shown", F.when(F.col("is_large"), render.stored_result(t, body, clock)).otherwise(body))
    return out.withColumn("tokens_in", estimate_tokens(body)).withColumn("tokens_out", estimate_tokens(F.col("shown")))


def is_stored(text: Column) -> Column:
    """Whether a result has been replaced by its mark already."""
    return F.contains(text, F.lit("[STORED: tr_"))


def shown_history(messages: DataFrame, *, clock: Column, role: str = "role", content: str = "content") -> DataFrame:
    """messages whose large tool results, in blocks of users' messages, are replaced by what stands for them; with results_stored and tokens_saved, a number each for every message."""
    tool = lambda b: F.coalesce(b["name"], F.lit("unknown"))
    large = lambda b: (F.col(role) == "user") & (b["type"] == "tool_result") & b["content"].isNotNull() & ~is_stored(b["content"]) & previews.is_large(tool(b), b["content"])
    new = lambda b: render.stored_result(tool(b), b["content"], clock)
    pairs = F.transform(content, lambda b: F.struct(b.alias("b"), F.when(large(b), new(b)).alias("n")))
    with_new = messages.withColumn("__p", pairs)
    saved = F.aggregate("__p", F.lit(0).cast("long"), lambda acc, p: acc + F.when(p["n"].isNull(), F.lit(0)).otherwise(estimate_tokens(p["b"]["content"]) - estimate_tokens(p["n"])))
    stored = F.size(F.filter("__p", lambda p: p["n"].isNotNull())).cast("long")
    changed = F.transform("__p", lambda p: p["b"].withField("content", F.coalesce(p["n"], p["b"]["content"])))
    return with_new.withColumn(content, changed).withColumn("results_stored", stored).withColumn("tokens_saved", saved).drop("__p")
