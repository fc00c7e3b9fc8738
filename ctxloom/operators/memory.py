"""Facts, summaries, patterns and the audit log.

Tables are change logs: a write appends rows, and the functions here fold a
log into what holds now. user_id always filters first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.errors import require
from ctxloom.functions import render
from ctxloom.functions.vector import cosine

from .lexical import memory_bm25


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of every key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return log.withColumn("__r", place).where("__r = 1").drop("__r")


def upsert_facts(facts: DataFrame) -> DataFrame:
    """Facts of one (user, scope, agent, session, key) become one: the smallest id, the newest values, the first creation. Facts without a key stay."""
    key = F.when(F.coalesce("key", F.lit("")) == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("k"), F.col("key")))
    keyed = facts.withColumn("__k", key)
    one = Window.partitionBy("user_id", "scope", "__k")
    newest = F.row_number().over(one.orderBy(F.desc("updated_at"), F.desc("id")))
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = keyed.select(*[c for c in facts.columns if c not in ("id", "created_at")], F.min("id").over(whole).alias("id"), F.min("created_at").over(whole).alias("created_at"), newest.alias("__r"))
    return rows.where("__r = 1").select(*facts.columns)


def visible(*, scopes: list[str] | None = None, agent_id: str | None = None, session_id: str | None = None, categories: list[str] | None = None) -> Column:
    """Which facts a request may see: of its scopes, those of the user or its agent, and no other session's."""
    out = F.lit(True)
    if scopes:
        out = out & F.col("scope").isin(*scopes)
    if agent_id is not None:
        out = out & ((F.col("scope") == "user") | F.coalesce(F.col("agent_id") == agent_id, F.lit(False)))
    if session_id is not None:
        out = out & ((F.col("scope") != "session") | F.coalesce(F.col("session_id") == session_id, F.lit(False)))
    if categories:
        out = out & F.col("category").isin(*categories)
    return out


def fact_score(cos: Column, bm25: Column, has_vector: Column) -> tuple[Column, Column]:
    """Hybrid score, and the score to rank by."""
    hybrid = F.when(has_vector, 0.6 * cos + 0.4 * bm25).otherwise(0.8 * bm25)
    return hybrid, F.greatest(hybrid, 0.8 * bm25)


def retrieve_facts(facts: DataFrame, embeddings: DataFrame | None, *, user_id: str, query: str, query_vector: list[float] | None = None, k: int = 10, least: float = 0.75, scan: int = 1000, **seen) -> DataFrame:
    """The k best visible facts of a user; of the `scan` most recently used ones, as the store's cap has it. Ties to the smaller id."""
    require(user_id=user_id, query=query)
    mine = facts.where((F.col("user_id") == user_id) & visible(**seen))
    # Scored before the one task of the limit, which so need not hold the texts.
    mine = mine.withColumn("bm25", memory_bm25(F.lit(query), F.col("value"))).orderBy(F.desc("last_accessed_at"), "id").limit(scan)
    if embeddings is not None and query_vector is not None:
        mine = mine.join(embeddings.select("content_hash", "embedding"), "content_hash", "left")
        cos, has = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector])), F.col("embedding").isNotNull()
    else:
        cos, has = F.lit(0.0), F.lit(False)
    rows = mine.withColumn("cos", cos).withColumn("has_embedding", has)
    hybrid, rank_by = fact_score(F.col("cos"), F.col("bm25"), F.col("has_embedding"))
    kept = rows.withColumn("hybrid", hybrid).withColumn("score", F.round(rank_by, 6)).where((F.col("hybrid") >= least) | (F.col("bm25") > 0.5))
    return kept.orderBy(F.desc("score"), "id").limit(k).select("id", "scope", "value", "category", "key", "score", F.round("cos", 6).alias("cos"), F.round("bm25", 6).alias("bm25"), "has_embedding")


def touches(results: DataFrame, as_of: datetime) -> DataFrame:
    """The audit rows of a retrieval; folding them in moves last_accessed_at."""
    return results.select(F.col("id").alias("fact_id"), F.lit("retrieved").alias("interaction_type"), F.lit(as_of).alias("ts"))


def append_interactions(rows: DataFrame, path: str) -> None:
    """Add rows (fact_id, interaction_type, ts) to the audit log, one folder a day, so that a purge by age drops folders."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def fold_touches(facts: DataFrame, touched: DataFrame) -> DataFrame:
    last = touched.groupBy(F.col("fact_id").alias("id")).agg(F.max("ts").alias("__t"))
    return facts.join(last, "id", "left").withColumn("last_accessed_at", F.greatest("last_accessed_at", F.coalesce("__t", "last_accessed_at"))).drop("__t").select(*facts.columns)


def mentions(names: Column, query: Column) -> Column:
    """Whether a name is part of the query or the query of a name, in any case."""
    q = F.lower(query)
    return F.coalesce(F.exists(names, lambda e: F.contains(q, F.lower(e)) | F.contains(F.lower(e), q)), F.lit(False))


def retrieve_summaries(summaries: DataFrame, embeddings: DataFrame | None, matched: DataFrame | None, *, user_id: str, query: str, query_vector: list[float] | None = None, projects: list[str] | None = None, k: int = 5, least: float = 0.3, scan: int = 200) -> DataFrame:
    """The k best summaries of a user: .4 for a full-text match (ids in matched), .3 BM25, .5 cosine, .15 and .1 for named entities and projects."""
    require(user_id=user_id, query=query)
    mine = summaries.where(F.col("user_id") == user_id)
    if projects:
        mine = mine.where(F.arrays_overlap("projects", F.array(*[F.lit(p) for p in projects])))
    mine = mine.orderBy(F.desc("last_accessed_at"), "id").limit(scan)
    hit = F.lit(False)
    if matched is not None:
        mine = mine.join(matched.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
        hit = F.col("__hit").isNotNull()
    cos = F.lit(0.0)
    if embeddings is not None and query_vector is not None:
        mine = mine.join(embeddings.select("content_hash", "embedding"), "content_hash", "left")
        cos = cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query_vector]))
    q = F.lit(query)
    bm25 = memory_bm25(q, F.concat_ws(" ", "topic", "content"))
    score = F.when(hit, 0.4).otherwise(0.0) + 0.3 * bm25 + 0.5 * cos + F.when(mentions(F.col("entities"), q), 0.15).otherwise(0.0) + F.when(mentions(F.col("projects"), q), 0.1).otherwise(0.0)
    return mine.withColumn("score", F.round(score, 6)).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k).select("id", "topic", "content", "score")


def search_memory(facts: DataFrame, summaries: DataFrame, k: int = 10) -> DataFrame:
    """Results of both kinds in one list, facts before summaries at equal scores."""
    both = facts.select(F.lit("fact").alias("source"), "id", F.col("value").alias("text"), "score").unionByName(summaries.select(F.lit("summary").alias("source"), "id", F.col("content").alias("text"), "score"))
    return both.orderBy(F.desc("score"), "source", "id").limit(k)


def merge_topics(summaries: DataFrame, *, cap: int = 1000) -> DataFrame:
    """Summaries of one (user, topic) become one: contents joined in order and cut, entities and projects united in first-seen order, counters added."""
    order = F.array_sort(F.collect_list(F.struct("created_at", "id", "content", "entities", "projects")))
    g = summaries.groupBy("user_id", "topic").agg(order.alias("s"), F.min("id").alias("id"), F.sum("source_messages").alias("source_messages"), F.max("updated_at").alias("updated_at"))
    pick = lambda c: F.transform("s", lambda x: x[c])
    return g.select("user_id", "topic", "id", F.substring(F.array_join(pick("content"), "\n"), 1, cap).alias("content"), F.array_distinct(F.flatten(pick("entities"))).alias("entities"), F.array_distinct(F.flatten(pick("projects"))).alias("projects"), "source_messages", "updated_at")


def same_summary(new: DataFrame, old: DataFrame, *, threshold: float = 0.85, scan: int = 50) -> DataFrame:
    """For each new summary the old one that it merges into: of the user's `scan` newest, the newest at or above the threshold (not the most similar)."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id"))
    recent = old.withColumn("__r", place).where(F.col("__r") <= scan).select("user_id", F.col("id").alias("old_id"), F.col("embedding").alias("__e"), "__r")
    pairs = new.select("user_id", F.col("id").alias("new_id"), "embedding").join(recent, "user_id").where(cosine(F.col("embedding"), F.col("__e")) >= threshold)
    return pairs.groupBy("new_id").agg(F.min_by("old_id", "__r").alias("old_id"))


def pattern_confidence(observations: DataFrame, *, keys: list[str], description: str, ts: str) -> DataFrame:
    """Counts, and a confidence that starts at .5 and gains .1 an observation up to .95; the newest description."""
    agg = observations.groupBy(*keys).agg(F.count("*").alias("observation_count"), F.max_by(description, ts).alias("description"))
    return agg.withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + 0.1 * (F.col("observation_count") - 1)), 6))


def stats(facts: DataFrame, embeddings: DataFrame, *, user_id: str) -> DataFrame:
    """scope, facts, with_embedding, coverage in per cent."""
    require(user_id=user_id)
    j = facts.where(F.col("user_id") == user_id).join(embeddings.select("content_hash").distinct().withColumn("has", F.lit(True)), "content_hash", "left")
    return j.groupBy("scope").agg(F.count("*").alias("facts"), F.count("has").alias("with_embedding")).withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("with_embedding") * F.lit(100.0), F.col("facts")), F.lit(0.0)), 0))


def user_counts(patterns: DataFrame, summaries: DataFrame, *, user_id: str) -> DataFrame:
    """One row: how many patterns and summaries a user has."""
    require(user_id=user_id)
    rows = patterns.select("user_id", F.lit(1).alias("p"), F.lit(0).alias("s")).unionByName(summaries.select("user_id", F.lit(0).alias("p"), F.lit(1).alias("s")))
    return rows.where(F.col("user_id") == user_id).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("patterns"), F.coalesce(F.sum("s"), F.lit(0)).alias("summaries"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n: the rows of each table, none left out for being empty."""
    one = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in sorted(tables.items())]
    out = one[0]
    for more in one[1:]:
        out = out.unionByName(more)
    return out


def format_results(results: DataFrame) -> DataFrame:
    """One row, context: found facts, then found summaries (source, text, score, category, topic, entities), each best first."""
    line = F.when(F.col("source") == "fact", render.fact_line(F.col("category"), F.col("text"), F.col("score"))).otherwise(render.summary_lines(F.col("topic"), F.col("text"), F.col("entities"), F.col("score")))
    got = results.select("source", F.struct((-F.col("score")).alias("s"), "id", line.alias("l")).alias("x"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("source") == kind, F.col("x"))))
    g = got.agg(of("fact").alias("f"), of("summary").alias("s"))
    part = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, lambda x: x["l"]), ""), F.lit("\n"))).otherwise("")
    return g.select(F.concat(part("f", "🧠 REMEMBERED FACTS:\n"), part("s", "📝 CONVERSATION SUMMARIES:\n")).alias("context"))


def format_context(facts: DataFrame) -> DataFrame:
    """category, block: a header and a bullet for each fact, best first."""
    bullet = F.concat(F.lit("• "), F.col("value"), F.when(F.col("scope") == "session", " (this session)").otherwise(" "))
    name = F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("general"))
    g = facts.select(name.alias("category"), F.struct((-F.col("score")).alias("s"), "id", bullet.alias("b")).alias("x")).groupBy("category").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    head = F.concat(F.upper(F.substring("category", 1, 1)), F.substring(F.col("category"), F.lit(2), F.length("category")))
    return g.select("category", F.concat(F.lit("**"), head, F.lit(":**\n"), F.array_join(F.transform("xs", lambda x: x["b"]), "\n")).alias("block"))


def inject(messages: DataFrame, context: DataFrame) -> DataFrame:
    """One system message, at turn -1, before each conversation that context (conv_id, text) has one for."""
    return messages.select("conv_id", "turn", "role", "text").unionByName(context.select("conv_id", F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), "text"))


def keep_newest(rows: DataFrame, n: int, *, by: list[str] = (), order: str, id_col: str) -> DataFrame:
    """The n newest rows (of each group), ties to the larger id. Without groups this is a distributed top n, not a sort of all rows."""
    if not by:
        return rows.orderBy(F.desc(order), F.desc(id_col)).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order), F.desc(id_col)))
    return rows.withColumn("__r", place).where(F.col("__r") <= n).drop("__r")


def unexpired(rows: DataFrame, as_of: datetime, *, created: str, hours: int) -> DataFrame:
    return rows.where(F.col(created) + F.make_dt_interval(hours=F.lit(hours)) >= F.lit(as_of))


def since(events: DataFrame, as_of: datetime, *, ts: str, days: int) -> DataFrame:
    return events.where(F.col(ts) >= F.lit(as_of) - F.make_dt_interval(days=F.lit(days)))


def update_facts(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: user_id, id, value, category, ts; nulls leave what is there. The newest non-null of each counts, and a new value has a new hash."""
    w = F.struct("ts")
    last = changes.groupBy("user_id", "id").agg(F.max_by("value", F.when(F.col("value").isNotNull(), w)).alias("__v"), F.max_by("category", F.when(F.col("category").isNotNull(), w)).alias("__c"), F.max("ts").alias("__t"))
    j = facts.join(last, ["user_id", "id"], "left")
    new = {"value": F.coalesce("__v", "value"), "category": F.coalesce("__c", "category"), "content_hash": F.when(F.col("__v").isNotNull(), F.sha2("__v", 256)).otherwise(F.col("content_hash")), "updated_at": F.coalesce("__t", "updated_at")}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns])


def delete_facts(facts: DataFrame, tombstones: DataFrame) -> DataFrame:
    return facts.join(tombstones.select("user_id", "id"), ["user_id", "id"], "left_anti")


def cascade(children: DataFrame, parents: DataFrame, *, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent still is there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def forget_user(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    """Every table with a user_id without that user's rows."""
    require(user_id=user_id)
    return {n: t.where(~F.coalesce(F.col("user_id") == user_id, F.lit(False))) for n, t in tables.items()}


def clean_session(facts: DataFrame, session_id: str) -> DataFrame:
    require(session_id=session_id)
    return facts.where(~((F.col("scope") == "session") & F.coalesce(F.col("session_id") == session_id, F.lit(False))))
