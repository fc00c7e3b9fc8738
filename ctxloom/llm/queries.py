"""The registered queries of this subpackage, and their SQL where SQL can express them.

Each derives its digest columns from the real outputs of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, mixing, near_dup, neighbours, quality, secrets, sharding, token_counts, warc
from .common import fresh_path, materialise, table


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
    sized = materialise(sized, "sizes")  # texts are counted once
    mixed = mixing.mix(sized, size_col="words", tie_col="text_hash")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by line."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("lines", token_counts.lines(F.col("text")))
    out = token_counts.count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, sections="lines")
    return out.select("doc_id", "n_tokens", F.size("section_tokens").cast("long").alias("n_sections"), "section_tokens", "n_crossing")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, vocabulary(), decoded="decoded", joins="joins")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "joins",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, k=3, percent=85)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = fingerprints.with_next(docs, id_col="doc_id", cols=["text"], text="text", derived={"fp": fingerprints.fingerprint(F.col("text"))})
    pairs = pairs.withColumn("edited", fingerprints.edited_text(F.col("text"), F.col("next_text")))
    pairs = pairs.withColumn("efp", fingerprints.fingerprint(F.col("edited")))
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprints.fingerprint_text(F.col("efp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = sharding.write_shards(sharding.shard(docs, 40), fresh_path(spark, "shards"))
    return written.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + sharding.ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in base],
        F.sha2(secrets.spans_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_warc, op4_bpe, op5_quality, op6_near_dup, op7_fingerprints, op8_sharding, op9_secrets, op10_neighbours)}

#: Only where SQL gives every column of the result.
SQL: dict[str, str] = {}
