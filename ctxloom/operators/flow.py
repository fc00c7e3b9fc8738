"""The two flows as a whole: from messages to the context of a prompt, and from messages to memory."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.config import Config
from ctxloom.functions.extraction import parse, valid_facts, valid_summary
from ctxloom.functions.text import dynamic_k, tokens
from ctxloom.functions.vector import hash_embedding, pair_similarity

from . import extraction, fusion, memory, messages
from .lexical import B, K1, idf

#: From so many messages on candidates are reranked.
RERANK_FROM = 50


def conversation_bm25(items: DataFrame, queries: DataFrame) -> DataFrame:
    """conv_id, group_id, bm25 (capped at 1 after division by 10): items (conv_id, group_id, text) against their own conversation's query (conv_id, query_text), with that conversation's statistics. Items that share no term are left out."""
    sized = items.select("conv_id", "group_id", tokens(F.col("text")).alias("t")).withColumn("length", F.size("t"))
    stats = sized.groupBy("conv_id").agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))
    asked = queries.select("conv_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("conv_id", "term").agg(F.count("*").alias("qtf"))
    hits = sized.select("conv_id", "group_id", "length", F.explode("t").alias("term")).groupBy("conv_id", "group_id", "length", "term").agg(F.count("*").alias("tf")).join(asked, ["conv_id", "term"])
    seen = hits.withColumn("df", F.count("*").over(Window.partitionBy("conv_id", "term"))).join(stats, "conv_id")
    norm = F.col("tf") + K1 * (1 - B + B * F.coalesce(F.try_divide(F.col("length"), F.col("avgdl")), F.lit(0.0)))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm
    return seen.groupBy("conv_id", "group_id").agg(F.least(F.lit(1.0), F.sum(part) / 10).alias("bm25"))


def select_messages(rows: DataFrame, config: Config = Config(), prompt: str | None = None, *, window: int | None = None, whole_chains: bool = True) -> DataFrame:
    """rows (conv_id, turn, role, content) that the prompt needs, with group_id, keep (short, system, recent, relevant) and score.

    Invalid blocks go first. A conversation of at most k + recent_n messages
    stays whole. Tool chains stand and fall as one: an item is a chain or a
    single message. Items whose first message is a system one stay, as do those
    that start among the last recent_n messages; of the others the k best at or
    above min_score, by config's mix of BM25 within the conversation and
    cosine, reranked by pair_score where config asks for it and there are
    RERANK_FROM messages or more. window: a model's tokens, from which k
    follows; without it k is top_k.
    """
    valid = messages.sanitise(rows)
    size = F.count("*").over(Window.partitionBy("conv_id"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    k = dynamic_k(F.lit(window), F.lit(prompt or ""), config.min_top_k, config.max_top_k) if window and config.dynamic_window else F.lit(config.top_k)
    marked = valid.select("conv_id", "turn", "role", "content", messages.message_text(F.col("content")).alias("text"), size.alias("n"), place.alias("r"))
    if whole_chains:
        marked = marked.join(messages.tool_chains(valid).select("conv_id", "turn", "group_id"), ["conv_id", "turn"])
    else:
        marked = marked.withColumn("group_id", F.col("turn"))
    first = F.struct("turn", "role", "r")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    items = marked.groupBy("conv_id", "group_id").agg(F.array_join(lines, "\n").alias("text"), F.min(first).alias("f"), F.any_value("n").alias("n"))

    users = marked.where((F.col("role") == "user") & (F.col("text") != "")).withColumn("u", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("u") <= config.recent_n)
    asked = users.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("u"))
    queries = asked.select("conv_id", F.array_join(F.concat("u", F.array(F.lit(prompt))) if prompt else F.col("u"), "\n\n").alias("query_text"))

    scored = items.join(queries, "conv_id", "left").withColumn("cos", pair_similarity(F.col("text"), F.col("query_text")))
    if config.hybrid:
        scored = scored.join(conversation_bm25(items, queries), ["conv_id", "group_id"], "left")
        value = config.bm25_weight * F.coalesce("bm25", F.lit(0.0)) + config.cosine_weight * F.col("cos")
    else:
        value = F.col("cos")
    keep = F.when(F.col("n") <= k + config.recent_n, "short").when(messages.is_system(F.col("f.role")), "system").when(F.col("f.r") <= config.recent_n, "recent")
    scored = scored.withColumn("keep", keep).withColumn("score", F.round(F.when(F.col("keep").isNotNull(), 1.0).when(F.length("text") < 10, 0.0).otherwise(value), 6))
    candidate = F.col("keep").isNull() & (F.col("score") >= config.min_score)
    if config.rerank:
        pair = fusion.pair_score(tokens(F.col("query_text")), tokens(F.col("text")))
        many = (F.col("n") >= RERANK_FROM) & (F.count_if(candidate).over(Window.partitionBy("conv_id")) > k)
        scored = scored.withColumn("rank_by", F.when(many, F.round(fusion.final_score(pair, F.col("score"), config.rerank_weight), 6)).otherwise(F.col("score")))
    else:
        scored = scored.withColumn("rank_by", F.col("score"))
    best = F.row_number().over(Window.partitionBy("conv_id", candidate).orderBy(F.desc("rank_by"), "group_id"))
    chosen = scored.withColumn("keep", F.coalesce("keep", F.when(candidate & (best <= k), "relevant"))).where("keep is not null").select("conv_id", "group_id", "keep", F.col("rank_by").alias("score"))
    return marked.select("conv_id", "turn", "role", "content", "group_id").join(chosen, ["conv_id", "group_id"])


@dataclass(frozen=True)
class Flushed:
    """facts: the user's facts afterwards; summaries: those to merge; outcomes: a row for each new fact, with what became of it."""

    facts: DataFrame
    summaries: DataFrame
    outcomes: DataFrame

    def counters(self) -> DataFrame:
        """One row: extracted, stored, updated, skipped, deferred, embeddings_stored."""
        is_ = lambda *v: F.count_if(F.col("outcome").isin(*v))
        return self.outcomes.agg(F.count("*").alias("extracted"), is_("stored").alias("stored"), is_("updated").alias("updated"), is_("skipped").alias("skipped"), is_("kept", "deferred").alias("not_stored"), F.count_if((F.col("outcome") == "stored") & F.col("embedding").isNotNull()).alias("embeddings_stored"))


#: From the text of a batch to a model's answer; models plug in here.
Extractor = Callable[[Column], Column]


def extract(batch: DataFrame, extractor: Extractor, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Facts and summaries of a batch of messages (user_id, conv_id, turn, role, text), by storage mode: facts alone, summaries alone, or both.

    facts: user_id, conv_id, place, value, category, confidence,
    source_context; summaries: user_id, conv_id, topic, content, entities,
    projects. Answers that can't be read give neither.
    """
    prompts = extraction.prompt_texts(batch).join(batch.groupBy("conv_id").agg(F.min("user_id").alias("user_id")), "conv_id")
    read = prompts.select("user_id", "conv_id", parse(extractor(F.col("prompt"))).alias("p"))
    facts = read.select("user_id", "conv_id", F.posexplode(valid_facts(F.col("p")["facts"])).alias("place", "f")).select("user_id", "conv_id", "place", F.col("f.fact").alias("value"), "f.category", "f.confidence", "f.source_context")
    summaries = read.select("user_id", "conv_id", valid_summary(F.col("p")["summary"]).alias("s")).where("s is not null").select("user_id", "conv_id", "s.*")
    return (facts.limit(0) if config.storage_mode == "semantic" else facts), (summaries.limit(0) if config.storage_mode == "facts" else summaries)


def flush(batch: DataFrame, stored: DataFrame, extractor: Extractor, config: Config = Config()) -> Flushed:
    """Extract, embed, resolve conflicts with what is stored, gate, store.

    stored: facts of all users (user_id, id, value, category, confidence,
    embedding). A conflicting fact updates the old one or leaves it, as the
    strategy says; one that is new is stored if it is sure enough, once for
    each user and text. An id follows from user and text, so a batch that runs
    twice stores nothing twice.
    """
    facts, summaries = extract(batch, extractor, config)
    identity = F.xxhash64("user_id", "value")
    new = facts.withColumn("id", identity)
    once = F.row_number().over(Window.partitionBy("user_id", "id").orderBy(F.desc("confidence"), "conv_id", "place"))
    new = new.withColumn("__r", once).where("__r = 1").drop("__r").withColumn("embedding", hash_embedding(F.col("value")).cast("array<float>"))
    acts = extraction.resolve(new, stored, strategy=config.conflict_strategy, threshold=config.conflict_similarity).select("user_id", "id", "old_id", "action", F.col("value").alias("new_value"), F.col("confidence").alias("new_confidence"))
    rows = new.join(acts, ["user_id", "id"])
    outcome = F.when(F.col("action") == "update", "updated").when(F.col("action") == "keep", "kept").when(F.col("action") == "defer", "deferred").when(F.col("confidence") < config.min_confidence, "skipped").otherwise("stored")
    outcomes = rows.withColumn("outcome", outcome)
    added = extraction.gate(outcomes.where("outcome = 'stored'"), config.min_confidence).select("user_id", "id", "value", "category", "confidence", "embedding", "metadata")
    latest = F.max_by(F.struct("new_value", "new_confidence", "embedding"), F.struct("confidence", "id"))
    changed = outcomes.where("outcome = 'updated'").groupBy("user_id", F.col("old_id").alias("id")).agg(latest.alias("u"))
    old = stored.select("user_id", "id", "value", "category", "confidence", "embedding").join(changed, ["user_id", "id"], "left")
    same = F.col("u").isNull()
    kept = old.select("user_id", "id", F.when(same, F.col("value")).otherwise(F.col("u.new_value")).alias("value"), "category", F.when(same, F.col("confidence")).otherwise(F.col("u.new_confidence")).alias("confidence"), F.when(same, F.col("embedding")).otherwise(F.col("u.embedding")).alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return Flushed(kept.unionByName(added), summaries, outcomes)


def flush_stream(batches: DataFrame, log, extractor: Extractor, config: Config = Config(), *, checkpoint: str, once: bool = False):
    """Run flush() on each micro-batch of a stream of messages and make a new version of the facts' log; once: what there is now, then stop (a manual flush). The log keeps its old version until the new one is whole, so a batch that fails is run again."""

    def step(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            done = flush(df, log.read(), extractor, config)
            log.replace(done.facts.select("user_id", "id", "value", "category", "confidence", "embedding"))

    writer = batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_stats(outcomes: DataFrame, buffered: DataFrame) -> DataFrame:
    """conv_id, extracted, stored, buffered: what a session has given so far and how many messages wait."""
    done = outcomes.groupBy("conv_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("outcome") == "stored").alias("stored"))
    wait = buffered.where(extraction.extractable(F.col("role"), F.col("text"))).groupBy("conv_id").agg(F.count("*").alias("buffered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wait.join(done, "conv_id", "full").select("conv_id", zero("extracted"), zero("stored"), zero("buffered"))


def merge_summaries(new: DataFrame, old: DataFrame, *, threshold: float = 0.85, cap: int = 1000) -> DataFrame:
    """old with each new summary folded in: into the one of its user and topic, else into the newest similar one, else as one of its own.

    Both: user_id, id, topic, content, entities, projects, source_messages,
    updated_at, embedding. Contents are joined as updates, the older first, and
    cut; names are united in the order first seen; counters are added. New
    summaries of one user and topic are folded among themselves before.
    """
    columns = ["user_id", "id", "topic", "content", "entities", "projects", "source_messages", "updated_at", "embedding"]
    exact = old.groupBy("user_id", "topic").agg(F.max_by("id", F.struct("updated_at", -F.col("id"))).alias("exact_id"))
    alike = memory.same_summary(new, old, threshold=threshold).withColumnRenamed("old_id", "alike_id")
    to = new.join(exact, ["user_id", "topic"], "left").join(alike, new["id"] == alike["new_id"], "left")
    aimed = to.select(*columns, F.coalesce("exact_id", "alike_id").alias("into"))
    part = lambda df, into, rank: df.select(*columns, into.alias("into"), F.lit(rank).alias("rank"))
    key = F.coalesce(F.col("into").cast("string"), F.concat(F.lit("topic:"), F.col("topic")))
    rows = part(old, F.col("id"), 0).unionByName(part(aimed, F.col("into"), 1)).withColumn("key", key)
    order = F.array_sort(F.collect_list(F.struct("rank", "updated_at", "id", "content", "entities", "projects")))
    g = rows.groupBy("user_id", "key").agg(order.alias("s"), F.min_by(F.struct("id", "topic", "embedding"), F.struct("rank", "updated_at", "id")).alias("f"), F.sum("source_messages").alias("source_messages"), F.max("updated_at").alias("updated_at"))
    joined = F.aggregate("s", F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["content"]).when(acc == x["content"], acc).otherwise(F.substring(F.concat(acc, F.lit("\n\nUpdate: "), x["content"]), 1, cap)))
    names = lambda c: F.array_distinct(F.flatten(F.transform("s", lambda x: F.coalesce(x[c], F.array().cast("array<string>")))))
    return g.select("user_id", F.col("f.id").alias("id"), F.col("f.topic").alias("topic"), joined.alias("content"), names("entities").alias("entities"), names("projects").alias("projects"), "source_messages", "updated_at", F.col("f.embedding").alias("embedding"))
