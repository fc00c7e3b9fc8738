"""A training-data pipeline over documents: each stage calls one operator of ctxloom.llm.

The stages work on all that their predecessor kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.llm import bpe, mixing, near_dup, quality, secrets
from ctxloom.llm.common import fresh_path, own_name, remove_path, table
from ctxloom.llm.queries import vocabulary


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects. Null and empty texts are judged like others, repeated rows alike; columns stay as they are, whatever their names."""
    score, good = own_name(docs, "score"), own_name(docs, "good")
    return quality.classify(docs, table(spark, sf_dir, "labels"), to=score, predicted=good).where(F.col(good) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates (5 words, 0.8). Rows with a null id stay; of rows that repeat an id and are kept, all stay."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret becomes a mask; n_chars follows the text. No document goes; null and empty texts have no secrets."""
    spans = own_name(docs, "spans")
    clean = secrets.redact(secrets.scan(docs, to=spans), spans=spans)
    if "n_chars" in docs.columns:
        changed = F.size(spans) > 0
        clean = clean.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; copies are rows. Null sources are one source; texts without words cost nothing."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document; null and empty texts have none, and copies have theirs each."""
    return bpe.encode(docs.select("doc_id", "source", "lang", "text"), vocabulary()).select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", classify_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenize),
]

#: A trained classifier and a tokenizer have no SQL. tests/llm/test_llm_queries.py holds each stage, on what the one before kept, and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; a stage's table goes when the next one is written. Without documents the result is empty."""
    docs, done = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            remove_path(spark, done)
        done = path
    return docs
