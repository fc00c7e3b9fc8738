"""Lexical scoring and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.text import tokens

K1, B = 1.2, 0.75
#: Most (query, term) rows that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 100_000


def inverted_index(docs: DataFrame, *, id_col: str, text: str) -> DataFrame:
    """id, term, tf, length: one row for each document and distinct term. Counted within the row, so building it shuffles nothing."""
    found = docs.select(F.col(id_col), tokens(F.col(text)).alias("t"))
    found = found.withColumn("length", F.size("t").cast("long"))
    # Sorted terms stand in runs; a run's length is the term's frequency. Runs are made before they are exploded, so that no row carries all terms.
    found = found.where("length > 0").withColumn("t", F.array_sort("t"))
    starts = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    found = found.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("t"))))
    runs = F.zip_with("starts", "ends", lambda i, j: F.struct(F.get("t", i).alias("term"), (j - i).cast("long").alias("tf")))
    return found.select(id_col, "length", F.explode(runs).alias("run")).select(id_col, "run.term", "run.tf", "length")


def term_frequencies(docs: DataFrame, *, id_col: str, text: str) -> DataFrame:
    return docs.select(id_col, F.explode(tokens(F.col(text))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame, *, text: str) -> DataFrame:
    """term, df, idf over all documents."""
    n = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # n is one row


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str, text: str, query_id: str, query: str) -> DataFrame:
    """query_id, id, bm25 (capped at 1 after division by 10) of the documents that share a term with a query.

    Terms that a query repeats count as often. Only terms of queries are looked
    up, and the statistics are one row. Up to BROADCAST_TERMS the terms of the
    queries go to the postings, which are dealt by document, so that no pair of
    a query and a document is shuffled; above it, postings are joined on the term.
    """
    sized = docs.select(id_col, tokens(F.col(text)).alias("t"))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    asked = queries.select(query_id, F.explode(tokens(F.col(query))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    few = asked.count() <= BROADCAST_TERMS
    sent = F.broadcast if few else lambda d: d
    postings = sized.select(id_col, F.size("t").alias("length"), F.explode("t").alias("term")).join(sent(asked.select("term").distinct()), "term", "left_semi").groupBy(id_col, "length", "term").agg(F.count("*").alias("tf"))
    # The sum over tf keeps both uses of the postings one exchange.
    seen = postings.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))
    dealt = postings.repartition(id_col) if few else postings
    hits = dealt.join(sent(asked.join(seen, "term")), "term").join(F.broadcast(stats))  # stats is one row
    norm = F.col("tf") + K1 * (1 - B + B * F.coalesce(F.try_divide(F.col("length"), F.col("avgdl")), F.lit(0.0)))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / norm
    return hits.groupBy(query_id, id_col).agg(F.least(F.lit(1.0), F.sum(part) / 10).alias("bm25"))


def memory_bm25(query: Column, text: Column) -> Column:
    """Score without statistics: words by white space, matched as parts of one another, k1 1.5, average length 50. The query is trimmed."""
    terms = F.split(F.lower(F.trim(query)), r"\s+")
    words = F.split(F.lower(text), r"\s+")
    length = F.size(words)

    def one(term: Column) -> Column:
        tf = F.size(F.filter(words, lambda w: F.contains(w, term) | F.contains(term, w))).cast("double")
        return tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / 50.0))

    return F.aggregate(terms, F.lit(0.0).cast("double"), lambda s, t: s + F.coalesce(one(t), F.lit(0.0)))


def search(docs: DataFrame, queries: DataFrame, *, id_col: str, text: str, query_id: str, query: str, k: int) -> DataFrame:
    """The k best documents of every query by BM25 (rounded to six places, ties to the smaller id), with rank from 1."""
    from pyspark.sql import Window

    scored = bm25(docs, queries, id_col=id_col, text=text, query_id=query_id, query=query).withColumn("score", F.round("bm25", 6))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id_col))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select(query_id, id_col, "score", "rank")


def prefilter(messages: DataFrame, query_terms: list[str], *, text: str, recent: Column, k_prefix: int = 4) -> DataFrame:
    """Messages that hold a keyword (words of four characters or more as prefixes, phrases as parts) or are recent; all of them if none holds one.

    The rule for no hits needs to know whether there is any: one row, joined.
    """
    words = tokens(F.col(text), 1)
    hit = F.lit(False)
    for t in query_terms:
        low = F.lit(t.lower())
        if " " in t:
            hit = hit | F.contains(F.lower(text), low)
        elif len(t) >= k_prefix:
            hit = hit | F.exists(words, lambda w: F.startswith(w, low))
        else:
            hit = hit | F.array_contains(words, low)
    marked = messages.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    any_hit = marked.agg(F.coalesce(F.max("__hit"), F.lit(False)).alias("__any"))
    return marked.join(F.broadcast(any_hit)).where(F.col("__hit") | recent | ~F.col("__any")).drop("__hit", "__any")  # one row
