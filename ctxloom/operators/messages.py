"""Messages with content blocks: texts, ids, validation, tool chains.

content is an array of structs (type, text, id, tool_use_id, name, content);
a plain text is one block of type text. Everything but the grouping of tool
chains is an expression on a row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.text import TOOL_ID

BLOCK = "struct<type:string,text:string,id:string,tool_use_id:string,name:string,content:string>"
USES, RESULTS = ("tool_use", "toolCall"), ("tool_result", "toolResult")


def blocks_of(text: Column) -> Column:
    """A plain text as content."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.alias("id"), null.alias("tool_use_id"), null.alias("name"), null.alias("content"))).cast(f"array<{BLOCK}>")


def message_text(content: Column, cap: int = 500) -> Column:
    """Text blocks and shortened tool results, a line each; other blocks and empty ones have none."""

    def one(b: Column) -> Column:
        result = F.concat(F.lit("[Tool result: "), F.substring(F.coalesce(b["content"], F.lit("")), 1, cap), F.lit("...]"))
        return F.when((b["type"] == "text") & b["text"].isNotNull(), b["text"]).when(b["type"].isin(*RESULTS), result).otherwise("")

    return F.array_join(F.filter(F.transform(F.coalesce(content, F.array().cast(f"array<{BLOCK}>")), one), lambda t: t != ""), "\n")


def has_tool_calls(content: Column) -> Column:
    return F.coalesce(F.exists(content, lambda b: b["type"].isin(*USES, *RESULTS)), F.lit(False))


def tool_use_ids(content: Column) -> Column:
    found = F.transform(F.filter(content, lambda b: b["type"].isin(*USES)), lambda b: b["id"])
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def tool_result_ids(content: Column) -> Column:
    found = F.transform(F.filter(content, lambda b: b["type"].isin(*RESULTS)), lambda b: F.coalesce(b["tool_use_id"], b["id"]))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def block_types(messages: DataFrame, *, content: str = "content") -> DataFrame:
    return messages.select(F.explode(content).alias("b")).groupBy(F.col("b.type").alias("type")).agg(F.count("*").alias("n"))


def strip_tools(messages: DataFrame, *, content: str = "content") -> DataFrame:
    """Without tool blocks; messages that have nothing else go."""
    return messages.withColumn(content, F.filter(content, lambda b: ~b["type"].isin(*USES, *RESULTS))).where(F.size(content) > 0)


def is_system(role: Column) -> Column:
    return F.coalesce(role.isin("system", "developer"), F.lit(False))


def _id_ok(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(TOOL_ID)), F.lit(False))


def valid_block(b: Column) -> Column:
    use = (F.coalesce(b["name"], F.lit("")) != "") & _id_ok(b["id"])
    result = _id_ok(b["tool_use_id"]) & b["content"].isNotNull()
    return F.when(b["type"] == "tool_use", use).when(b["type"] == "tool_result", result).otherwise(b.isNotNull())


def valid_message(role: Column, content: Column) -> Column:
    return role.isNotNull() & F.coalesce(F.forall(content, valid_block), F.lit(False))


def sanitise(messages: DataFrame, *, role: str = "role", content: str = "content") -> DataFrame:
    """Without invalid blocks; messages without a role, and those left without blocks, go."""
    kept = messages.where(F.col(role).isNotNull()).withColumn(content, F.filter(content, valid_block))
    return kept.where(F.size(content) > 0)


def invalid_blocks(messages: DataFrame, *, content: str = "content") -> DataFrame:
    """One row: how many blocks are invalid for which reason."""
    b = F.col("b")
    use, result = b["type"] == "tool_use", b["type"] == "tool_result"
    nameless = use & (F.coalesce(b["name"], F.lit("")) == "")
    reasons = {
        "tool_use_missing_name": nameless,
        "tool_use_invalid_id": use & ~nameless & ~_id_ok(b["id"]),
        "tool_result_invalid_id": result & ~_id_ok(b["tool_use_id"]),
        "tool_result_missing_content": result & _id_ok(b["tool_use_id"]) & b["content"].isNull(),
    }
    counts = messages.select(F.explode(content).alias("b")).agg(*[F.count_if(c).alias(n) for n, c in reasons.items()])
    return counts.withColumn("total", sum((F.col(n) for n in reasons), F.lit(0).cast("long")))


def tool_results(messages: DataFrame, *, role: str = "role", content: str = "content", keys: list[str], call_id: str | None = None) -> DataFrame:
    """One row for each tool result: keys, tool_call_id, text. Results are blocks; a message of role toolResult without such blocks is one as a whole, with call_id (a column, if there is one)."""
    blocks = F.filter(F.coalesce(content, F.array().cast(f"array<{BLOCK}>")), lambda b: b["type"].isin(*RESULTS))
    found = F.transform(blocks, lambda b: F.struct(F.coalesce(b["tool_use_id"], b["id"]).alias("tool_call_id"), F.coalesce(b["content"], F.lit("")).alias("text")))
    own = F.struct((F.col(call_id) if call_id else F.lit(None)).cast("string").alias("tool_call_id"), message_text(F.col(content)).alias("text"))
    whole = (F.col(role) == "toolResult") & (F.size(blocks) == 0)
    return messages.select(*keys, F.inline(F.when(whole, F.array(own)).otherwise(found)))


def recent(turn: str, n: int, by: str = "conv_id") -> Column:
    """Among the last n of a conversation."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(turn))) <= n


def tool_chains(messages: DataFrame, *, by: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """by, turn, group_id (the turn at which the group starts), kind (tool-chain or single).

    A tool use opens a chain and ends one before it; results that the chain
    waits for join it; when none is left to wait for, the chain ends, and an
    assistant's message without tool use right after it joins as well; anything
    else ends it and stands alone. Each step depends on the one before, so a
    conversation is folded as a group.
    """
    rows = messages.select(by, turn, role, tool_use_ids(F.col(content)).alias("uses"), tool_result_ids(F.col(content)).alias("results"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(turn, kind="stable")
        turns, roles, uses, results = (pdf[c].tolist() for c in (turn, role, "uses", "results"))
        group, kind, start, waits, absorb = [], [], None, set(), False
        for t, who, u, r in zip(turns, roles, uses, results):
            if absorb and who == "assistant" and not len(u):
                group.append(start), kind.append("tool-chain")
                start, absorb = None, False
                continue
            if absorb:
                start, absorb = None, False
            if len(u):
                start, waits = t, set(u)
                kind.append("tool-chain")
            elif start is not None and waits & set(r):
                waits -= set(r)
                absorb = not waits
                kind.append("tool-chain")
            else:
                start = None
                kind.append("single")
            group.append(t if start is None else start)
        return pd.DataFrame({by: pdf[by].to_numpy(), turn: turns, "group_id": group, "kind": kind})

    kinds = dict(messages.dtypes)
    return rows.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {turn} {kinds[turn]}, group_id {kinds[turn]}, kind string")
