"""From messages to facts: batches, conflicts, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.functions.vector import by_size, cosine

from .lexical import memory_bm25
from .memory import fact_score


def extractable(role: Column, text: Column, has_tools: Column | None = None) -> Column:
    good = role.isin("user", "assistant") & (F.length(F.trim(text)) >= 10)
    return good & ~has_tools if has_tools is not None else good


def batches(messages: DataFrame, *, size: int = 5) -> DataFrame:
    """conv_id, batch, n, first_turn, last_turn: the full batches that a count trigger would flush, and what is left at the end."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = messages.where(extractable(F.col("role"), F.col("text"))).withColumn("batch", F.floor(place / size).cast("long"))
    return rows.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


def is_tool_message(role: Column, content: Column) -> Column:
    """Whether a message is a tool's, a system's, or holds a call or a result; no message counts as one."""
    blocks = F.exists(content, lambda b: b["type"].isin("tool_use", "tool_result"))
    return F.coalesce(role.isin("tool", "system"), F.lit(False)) | (role.isNull() & content.isNull()) | F.coalesce(blocks, F.lit(False))


def prompt_texts(messages: DataFrame, *, last: int = 8, cap: int = 500, between: str = "\n", mark: str = "") -> DataFrame:
    """conv_id, prompt: the extractable ones of the last `last` messages, in order, numbered and cut, with a mark where they are."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = messages.withColumn("r", place).where(F.col("r") <= last).where(extractable(F.col("role"), F.col("text")))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.max(F.col("role") == "user").alias("u")).where("u")
    text = lambda x: F.concat(F.substring(x["text"], 1, cap), F.when(F.length(x["text"]) > cap, mark).otherwise(""))
    line = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.upper(x["role"]), F.lit(": "), text(x))
    return got.select("conv_id", F.array_join(F.transform("m", line), between).alias("prompt"))


def fact_prompts(messages: DataFrame, *, last: int = 8) -> DataFrame:
    """conv_id, prompt: what asks a model for the lasting facts of a conversation, messages cut at 500 characters."""
    p = prompt_texts(messages, last=last, cap=500, between="\n\n", mark="...")
    return p.withColumn("prompt", F.concat(F.lit("Which lasting facts does this conversation give?\n\n"), F.col("prompt"), F.lit("\n\nAnswer with a JSON array of facts, or [].")))


def memory_prompts(messages: DataFrame, *, last: int = 8, projects: list[str] = (), stack: str | None = None) -> DataFrame:
    """conv_id, prompt: what asks for facts and a summary, messages cut at 1000 characters, with what is known of the user's work."""
    known = (f"\nProjects: {', '.join(projects)}." if projects else "") + (f" Tools: {stack}." if stack else "")
    p = prompt_texts(messages, last=last, cap=1000, between="\n\n", mark="...")
    return p.withColumn("prompt", F.concat(F.lit("What of this conversation is worth remembering?\n\n"), F.col("prompt"), F.lit("\n" + known + '\n\nAnswer with JSON: "facts", an array, and "summary", an object or null.')))


def conflict_prompt(old_value: Column, old_confidence: Column, value: Column, category: Column, confidence: Column, context: Column) -> Column:
    """What asks whether a new fact contradicts an old one, and what then holds."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    old = F.concat(F.lit("Old fact: "), old_value, F.lit("\nConfidence: "), known(old_confidence))
    new = F.concat(F.lit("\n\nNew fact: "), value, F.lit("\nConfidence: "), known(confidence), F.lit("\nSaid: "), known(context))
    return F.concat(F.lit("Category: "), category, F.lit("\n"), old, new, F.lit("\n\nDo they contradict? Answer with JSON: conflicts, reason, resolution."))


def _contradicts(threshold: float) -> Column:
    low = F.lower("value"), F.lower("old_value")
    within = F.contains(low[0], low[1]) | F.contains(low[1], low[0])
    vectors = F.col("embedding").isNotNull() & F.col("__e").isNotNull()
    return F.when(vectors, cosine(F.col("embedding"), F.col("__e")) >= threshold).otherwise(within)


#: New and old vectors that are compared in one task at a time.
BLOCK = 1024


def held(inner: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """keys, inner, outer: which texts of inner (keys, inner) are within which of outer (keys, outer), with repeats; both without nulls and repeats.

    A text is looked up by its head, whose width is the largest power of two
    that fits, at all places of the outer texts; then, of the lengths that texts
    with this head have, as a whole. So no two texts are compared without one
    being within the other, and rows grow with the outer texts' length.
    """
    p = inner.where("inner <> ''").withColumn("__n", F.length("inner")).withColumn("__w", F.expr("shiftleft(1, length(bin(__n)) - 1)"))
    heads = p.groupBy(*keys, "__w", F.xxhash64(F.substring(F.col("inner"), F.lit(1), F.col("__w"))).alias("__h")).agg(F.collect_set("__n").alias("__ns"))  # at most __w lengths
    widths = p.agg(F.collect_set("__w").alias("__ws"))
    places = outer.join(F.broadcast(widths)).select(*keys, "outer", F.explode(F.filter("__ws", lambda w: w <= F.length("outer"))).alias("__w"))  # one row
    places = places.select(*keys, "outer", "__w", F.explode(F.sequence(F.lit(1), F.length("outer") - F.col("__w") + 1)).alias("__at"))
    places = places.withColumn("__h", F.xxhash64(F.substring(F.col("outer"), F.col("__at"), F.col("__w"))))
    found = places.join(heads, [*keys, "__w", "__h"]).select(*keys, "outer", "__at", F.explode("__ns").alias("__n")).where("__at + __n - 1 <= length(outer)")
    parts = found.select(*keys, F.substring(F.col("outer"), F.col("__at"), F.col("__n")).alias("inner"), "outer")
    whole = parts.join(p.select(*keys, "inner"), [*keys, "inner"])
    return whole.unionByName(inner.where("inner = ''").join(outer, keys))


def _first_similar(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("old_id")
        hit = np.full((left.num_rows, right.num_rows), threshold <= 0)
        if hit.size:
            a, z = by_size(left["embedding"]), by_size(right["__e"])
            for d in a.keys() & z.keys():
                (ai, x, xn), (zi, y, yn) = a[d], z[d]
                norm = xn[:, None] * yn
                with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
                    # NaN counts as large, as in Spark.
                    hit[np.ix_(ai, zi)] = ~(np.where(norm == 0, 0.0, (x @ y.T) / norm) < threshold)
        at = np.flatnonzero(hit.any(1)) if hit.size else np.zeros(0, int)
        on = hit[at].argmax(1) if len(at) else at
        return pa.table({**{c: left[c].take(pa.array(at)) for c in ("user_id", "category", "id")}, "old_id": right["old_id"].take(pa.array(on))})

    return run


def similar(new: DataFrame, old: DataFrame, threshold: float) -> DataFrame:
    """user_id, category, id, old_id: for each new vector the first old one, by id, of its user and category that is similar, in each block of old ones. Every new vector meets every old one; both sides are dealt into blocks, and a pair of blocks is a group."""
    keys = ["user_id", "category"]
    lots = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = lots(new, "__a").join(lots(old, "__z"), keys)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = new.join(sizes, keys).withColumn("__i", deal("id", "__a")).withColumn("__j", every("__z")).select(*keys, "__i", "__j", "id", "embedding")
    right = old.join(sizes, keys).withColumn("__j", deal("old_id", "__z")).withColumn("__i", every("__a")).select(F.col("user_id").alias("__u"), F.col("category").alias("__c"), "__i", "__j", "old_id", "__e")  # other names, as both may come from one table
    schema = T.StructType([left.schema[c] for c in (*keys, "id")] + [right.schema["old_id"]])
    return left.groupBy(*keys, "__i", "__j").cogroup(right.groupBy("__u", "__c", "__i", "__j")).applyInArrow(_first_similar(threshold), schema)


def conflicts(new: DataFrame, old: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """For each new fact (user_id, id, category, value, embedding) the first old one, by id, of its user and category that it may contradict: similar vectors, or, where one has none, one text within the other.

    Different texts are matched once (held), whatever the number of facts that
    share them; vectors are compared in blocks (similar).
    """
    keys = ["user_id", "category"]
    o = old.select(*keys, F.struct(F.col("id").alias("old_id"), F.col("value").alias("old_value"), F.col("confidence").alias("old_confidence")).alias("o"), F.lower("value").alias("old_low"), F.col("embedding").alias("__e"))
    bare = F.when(F.col("__e").isNull(), F.col("o"))
    olds = o.where("old_low is not null").groupBy(*keys, "old_low").agg(F.min("o").alias("o"), F.min(bare).alias("bare"))
    news = new.select(*keys, F.lower("value").alias("low")).where("low is not null").distinct()
    texts = lambda df, c, name: df.select(*keys, F.col(c).alias(name))
    within = held(texts(olds, "old_low", "inner"), texts(news, "low", "outer"), keys).select(*keys, F.col("inner").alias("old_low"), F.col("outer").alias("low"))
    around = held(texts(news, "low", "inner"), texts(olds, "old_low", "outer"), keys).select(*keys, F.col("outer").alias("old_low"), F.col("inner").alias("low"))
    by_text = within.unionByName(around).join(olds, [*keys, "old_low"]).groupBy(*keys, "low").agg(F.min("o").alias("__any"), F.min("bare").alias("__bare"))

    with_vectors = o.where("__e is not null").withColumn("old_id", F.col("o.old_id"))
    near = similar(new.where("embedding is not null"), with_vectors, threshold).groupBy(*keys, "id").agg(F.min("old_id").alias("old_id"))
    by_vector = near.join(with_vectors.groupBy(*keys, "old_id").agg(F.min("o").alias("__near")), [*keys, "old_id"]).drop("old_id")

    rows = new.withColumn("low", F.lower("value")).join(by_text, [*keys, "low"], "left").join(by_vector, [*keys, "id"], "left")
    text = F.when(F.col("embedding").isNull(), F.col("__any")).otherwise(F.col("__bare"))
    rows = rows.withColumn("o", F.least(text, F.when(F.col("embedding").isNotNull(), F.col("__near")))).where("o is not null")
    first = F.row_number().over(Window.partitionBy("user_id", "id").orderBy("o.old_id"))
    return rows.withColumn("__r", first).where("__r = 1").select(*new.columns, "o.*")


def resolution(strategy: Column, old_value: Column, old_confidence: Column, value: Column, confidence: Column) -> Column:
    """struct<action, value, confidence> for a conflict."""
    old = F.coalesce(old_confidence, F.lit(0.0))
    update = lambda v, c: F.struct(F.lit("update").alias("action"), v.alias("value"), c.alias("confidence"))
    keep = F.struct(F.lit("keep").alias("action"), old_value.alias("value"), old_confidence.alias("confidence"))
    return (
        F.when(strategy == "keep_latest", update(value, confidence))
        .when((strategy == "keep_highest_confidence") & (confidence > old), update(value, confidence))
        .when(strategy == "merge", update(F.concat(old_value, F.lit("; "), value), F.greatest(old, confidence)))
        .when(strategy == "ask_user", F.struct(F.lit("defer").alias("action"), old_value.alias("value"), old_confidence.alias("confidence")))
        .otherwise(keep)
    )


def batch_conflicts(new: DataFrame, old: DataFrame, *, k: int = 20, least: float = 0.6, threshold: float = 0.8) -> DataFrame:
    """As conflicts(), but only among the k old facts of the user that retrieval finds for the new one, at or above least."""
    o = old.select("user_id", F.col("id").alias("old_id"), F.col("value").alias("__v"), F.col("embedding").alias("__e"))
    both = new.select("user_id", "id", "value", "embedding").join(o, "user_id")
    has = F.col("embedding").isNotNull() & F.col("__e").isNotNull()
    bm25 = memory_bm25(F.col("value"), F.col("__v"))
    _, score = fact_score(cosine(F.col("embedding"), F.col("__e")), bm25, has)
    ranked = both.withColumn("__s", F.round(score, 6)).where(F.col("__s") >= least)
    place = F.row_number().over(Window.partitionBy("user_id", "id").orderBy(F.desc("__s"), "old_id"))
    near = ranked.withColumn("__r", place).where(F.col("__r") <= k).select("user_id", "id", "old_id")
    o = old.select("user_id", "category", F.col("id").alias("old_id"), F.col("value").alias("old_value"), F.col("confidence").alias("old_confidence"), F.col("embedding").alias("__e"))
    pairs = near.join(new, ["user_id", "id"]).join(o, ["user_id", "category", "old_id"])
    first = F.row_number().over(Window.partitionBy("user_id", "id").orderBy("old_id"))
    return pairs.where(_contradicts(threshold)).withColumn("__r", first).where("__r = 1").drop("__r", "__e")


def resolve(new: DataFrame, old: DataFrame, *, strategy: str | Column = "keep_highest_confidence", threshold: float = 0.8) -> DataFrame:
    """Every new fact with what becomes of it: add, update, keep or defer, and the old fact concerned. strategy may be a column of new."""
    found = conflicts(new, old, threshold=threshold).select("user_id", "id", "old_id", "old_value", "old_confidence")
    rows = new.join(found, ["user_id", "id"], "left")
    act = resolution(F.lit(strategy), F.col("old_value"), F.col("old_confidence"), F.col("value"), F.col("confidence"))
    add = F.struct(F.lit("add").alias("action"), F.col("value").alias("value"), F.col("confidence").alias("confidence"))
    return rows.withColumn("r", F.when(F.col("old_id").isNull(), add).otherwise(act)).select("user_id", "id", "old_id", F.col("r.action").alias("action"), F.col("r.value").alias("value"), F.col("r.confidence").alias("confidence"))


def gate(facts: DataFrame, least: float = 0.5) -> DataFrame:
    """Facts that are sure enough, with where they come from."""
    kept = facts.where(F.col("confidence") >= least)
    return kept.withColumn("metadata", F.create_map(F.lit("confidence"), F.col("confidence").cast("string"), F.lit("source_context"), F.coalesce("source_context", F.lit(""))))


def merged_metadata(old: Column, new: Column) -> Column:
    """Entries of both, the new ones winning."""
    mine = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(mine, new)


def route(facts: DataFrame, mode: str) -> DataFrame:
    """What a storage mode keeps: facts without vectors, vectors without facts' keys, or both."""
    if mode not in ("facts", "semantic", "hybrid"):
        raise ValueError(f"no such storage mode: {mode}")
    return facts.drop("embedding") if mode == "facts" else facts.where(F.col("embedding").isNotNull()) if mode == "semantic" else facts
