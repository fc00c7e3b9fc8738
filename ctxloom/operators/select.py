"""Selection of the messages that a prompt needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.functions.text import estimate_tokens
from ctxloom.functions.vector import pair_similarity

from .messages import is_system


def query_texts(messages: DataFrame, prompt: str | None = None, *, recent: int = 3) -> DataFrame:
    """conv_id, query_text: the last `recent` user texts in order, and the prompt, blank lines between."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    users = messages.where("role = 'user'").withColumn("r", place).where((F.col("r") <= recent) & (F.coalesce("text", F.lit("")) != ""))
    last = users.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("u"))  # at most `recent`
    parts = F.transform("u", lambda x: x["text"])
    return last.select("conv_id", F.array_join(F.concat(parts, F.array(F.lit(prompt))) if prompt else parts, "\n\n").alias("query_text"))


def score(messages: DataFrame, prompt: str | None = None, *, recent: int = 3) -> DataFrame:
    """messages with score (six places) and keep: system and recent messages get 1, texts under ten characters 0, the rest the cosine to the query's vector."""
    queries = query_texts(messages, prompt, recent=recent).withColumnRenamed("query_text", "__q")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    # Texts alone are joined: a vector is larger than the part of a text that it is made of.
    rows = messages.withColumn("r", place).join(queries, "conv_id", "left").withColumn("__cos", pair_similarity(F.col("text"), F.col("__q")))
    keep = F.when(is_system(F.col("role")), "system").when(F.col("r") <= recent, "recent")
    empty = F.length(F.coalesce("text", F.lit(""))) < 10
    value = F.when(keep.isNotNull(), 1.0).when(empty, 0.0).otherwise(F.col("__cos"))
    return rows.select(*messages.columns, F.round(value, 6).alias("score"), keep.alias("keep"), empty.alias("empty"))


def top(scored: DataFrame, *, k: int | Column, least: float) -> DataFrame:
    """With selected: system, recent, and the k best others at or above least, ties to the earlier turn. k may be a column (dynamic)."""
    candidate = F.col("keep").isNull() & (F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("conv_id", candidate).orderBy(F.desc("score"), "turn"))
    return scored.withColumn("selected", F.col("keep").isNotNull() | (candidate & (place <= k)))


def select_context(messages: DataFrame, prompt: str | None = None, *, k: int = 10, recent: int = 3, least: float = 0.65) -> DataFrame:
    """The messages that stay, in order of conversation and turn: system, the last `recent`, and the k most similar to the query.

    A short conversation, of k + recent messages at most, stays whole. One
    shuffle by conversation serves the ranks and the join.
    """
    size = F.count("*").over(Window.partitionBy("conv_id"))
    chosen = top(score(messages, prompt, recent=recent), k=k, least=least)
    return chosen.withColumn("n", size).where(F.col("selected") | (F.col("n") <= k + recent)).drop("n", "selected")


def bucket(keep: Column, value: Column, empty: Column, least: float) -> Column:
    return F.coalesce(keep, F.when(empty, "empty").when(value >= 0.8, "high").when(value >= least, "medium").otherwise("low"))


def distribution(scored: DataFrame, *, least: float) -> DataFrame:
    return scored.groupBy(bucket(F.col("keep"), F.col("score"), F.col("empty"), least).alias("bucket")).agg(F.count("*").alias("n"))


def score_stats(scored: DataFrame, *, by: list[str] = (), score: str = "score") -> DataFrame:
    """mean, least and most of scores, rounded, and how many there are."""
    s = F.col(score)
    return scored.groupBy(*by).agg(F.round(F.avg(s), 6).alias("mean"), F.round(F.min(s), 6).alias("least"), F.round(F.max(s), 6).alias("most"), F.count(s).alias("n"))


def hit_rate(events: DataFrame, hit: Column, *, by: list[str] = ()) -> DataFrame:
    """n, hits, and hits in per cent of all; 0 without events."""
    g = events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    return g.withColumn("hit_rate", F.round(F.coalesce(F.try_divide(F.col("hits") * F.lit(100.0), F.col("n")), F.lit(0.0)), 4))


def savings(chosen: DataFrame) -> DataFrame:
    """Tokens in, out and saved, and the reduction in per cent, of messages with the flag selected."""
    t = estimate_tokens(F.col("text"))
    sums = chosen.agg(F.sum(t).alias("tokens_in"), F.sum(F.when(F.col("selected"), t).otherwise(0)).alias("tokens_out"))
    saved = F.col("tokens_in") - F.col("tokens_out")
    return sums.select("tokens_in", "tokens_out", saved.alias("tokens_saved"), F.round(100.0 * saved / F.col("tokens_in"), 4).alias("reduction_pct"))
