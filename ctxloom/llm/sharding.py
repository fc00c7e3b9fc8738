"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows uniformly into buckets of a size that fits in memory,
by a seeded hash of the row's identity (id and text); pass two permutes each
bucket by Fisher-Yates and lays the buckets end to end. A row's place in that
line decides its shard: shards are equal stretches, so their counts differ by
one at most, and a bucket writes to one or two shards only.

Rows that are equal in id and text would all meet in one bucket; where they
hold more than a quarter of one, a running number is hashed with them. Bucket and task are one and the same
number, so the permutation follows from the seed and the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name

#: Bytes of texts in a bucket: more for more data, so that buckets stay about MOST_BUCKETS, up to what a task can hold.
BUCKET_BYTES, LARGEST_BUCKET = 8_000_000, 256_000_000
MOST_BUCKETS = 100_000
ROW_BYTES = 16
#: Repeated identities that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def shard(df: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int | None = None) -> DataFrame:
    """df in random order with the columns shard (0 to shards - 1) and slot (gapless from 0 in a shard).

    Null texts have no bytes and null ids hash like any value; rows that
    repeat are spread like others. Of fewer rows than shards some shards are
    empty; an empty table gives an empty result. Columns of df named shard or
    slot are replaced. The same rows and seed give the same places, however
    the rows are partitioned; only where equal rows hold more than a quarter of
    a bucket do places follow the partitions of df too.
    """
    df = df.drop("shard", "slot")
    bucket, row, key = (own_name(df, x) for x in ("bucket", "row", "key"))
    identity = [F.col(id_col).cast("string"), F.col(id_col).isNull(), F.col(text), F.col(text).isNull()]
    size_of = F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES
    alike = df.select(F.xxhash64(F.lit(seed + 1), *identity).alias(key), size_of.cast("long").alias("b")).groupBy(key).agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    n, size, most = alike.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.max("b"), F.lit(0))).first()
    bucket_bytes = bucket_bytes or min(LARGEST_BUCKET, max(BUCKET_BYTES, size // MOST_BUCKETS))
    buckets = max(1, -(-size // bucket_bytes))
    rows = df.withColumn(key, F.xxhash64(F.lit(seed + 1), *identity))
    salt = F.lit(0)
    if buckets > 1 and most > bucket_bytes // 4:
        often = alike.where((F.col("b") > bucket_bytes // 4) & (F.col("n") > 1)).select(key, F.lit(True).alias(row))
        often = F.broadcast(often) if often.count() <= BROADCAST_KEYS else often
        rows = rows.withColumn(bucket, F.monotonically_increasing_id()).join(often, key, "left")
        salt = F.when(F.col(row), F.col(bucket)).otherwise(0)
    scattered = rows.select(F.pmod(F.xxhash64(F.lit(seed), F.col(key), salt), F.lit(buckets)).cast("int").alias(bucket), F.struct(*df.columns).alias(row), key)
    counts = scattered.groupBy(bucket).agg(F.count("*").alias("__n"))
    line = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(bucket, F.coalesce(F.sum("__n").over(line), F.lit(0)).alias("__begin"))
    # Task and bucket have the same number, of which and of the seed the random numbers of F.shuffle follow.
    dealt = scattered.repartitionById(buckets, F.col(bucket))
    held = dealt.groupBy(bucket).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(row).alias("r"))).alias("__rows"))
    # The permutation starts from an order that doesn't depend on how rows arrived; equal keys are equal rows.
    order = F.array_sort(F.transform("__rows", lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"))))
    mixed = held.withColumn("__order", F.shuffle(order, seed)).join(begins, bucket)
    one = mixed.select("__begin", "__rows", F.posexplode("__order").alias("__at", "__from"))
    place = one.select((F.col("__begin") + F.col("__at")).alias("__place"), F.get("__rows", F.col("__from.i")).alias("__one"))
    out = place.select("__place", "__one.r.*")
    named = out.withColumn("shard", F.expr(f"CAST((__place * {shards}L) DIV {max(n, 1)}L AS INT)"))
    return named.withColumn("slot", F.expr(f"__place - (shard * {n}L + {shards - 1}L) DIV {shards}L")).drop("__place")


def write_shards(df: DataFrame, path: str) -> DataFrame:
    """Write the rows of shard() below path, one folder a shard, and read them again.

    Every row is written once, nulls, empty texts and repeated rows included,
    with all its columns. An empty table gives an empty result.
    """
    df.write.partitionBy("shard").parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
