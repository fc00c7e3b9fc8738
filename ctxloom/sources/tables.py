"""Tables: reading by name, change logs with versions, indexes, routed logs.

Plain Parquet has no upsert. A Log is a folder of versions: a write makes a
new one beside the old and then moves a pointer, so readers see one version or
the other. All files go through Spark's and Hadoop's file systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.functions.text import blank, content_hash, tokens
from ctxloom.functions.vector import TEXT_CAP

INDEX_CAP, TOOL_CAP = 5000, 1000
# Log files by what an entry is about.
ROUTES = ("context", "memory", "extraction", "performance", "error")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Log:
    """A versioned table below a path."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        found = self.versions()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> DataFrame:
        """A new version; it counts from when it is complete."""
        df.write.parquet(f"{self.path}/v{(self.versions() or [0])[-1] + 1}")
        return self.read()

    def vacuum(self, keep: int = 2) -> None:
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/v{v}")
            fs.delete(p, True)


def upsert_embeddings(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest embedding of each content hash."""
    place = F.row_number().over(Window.partitionBy("content_hash").orderBy(F.desc("created_at")))
    return cache.unionByName(new).withColumn("__r", place).where("__r = 1").drop("__r")


def lookup_embeddings(texts: DataFrame, cache: DataFrame, *, text: str = "text") -> DataFrame:
    """texts with the embeddings that the cache has; the rows are also what to fold into accessed_at."""
    return texts.withColumn("content_hash", content_hash(F.col(text))).join(cache.select("content_hash", "embedding"), "content_hash")


def index_rows(messages: DataFrame, indexed: DataFrame | None = None, *, id_col: str, text: str, is_tool=None, least: int = 10) -> DataFrame:
    """id and content of messages that are to be indexed: those of `least` characters that aren't yet, cut at a cap that is lower for tool results."""
    cap = F.when(is_tool, TOOL_CAP).otherwise(INDEX_CAP) if is_tool is not None else F.lit(INDEX_CAP)
    body = F.when(F.length(text) > cap, F.concat(F.substring(F.col(text), F.lit(1), cap), F.lit("..."))).otherwise(F.col(text))
    rows = messages.where(~blank(F.col(text)) & (F.length(text) >= least)).select(F.col(id_col), body.alias("content"))
    return rows.join(indexed.select(id_col), id_col, "left_anti") if indexed is not None else rows


def write_index(rows: DataFrame, path: str, *, id_col: str, partitions: int = 32) -> None:
    """Postings (term, id, tf) dealt and sorted by term, so that a reader's filter on terms skips row groups."""
    posted = rows.select(id_col, F.explode(tokens(F.col("content"))).alias("term")).groupBy("term", id_col).agg(F.count("*").alias("tf"))
    posted.repartitionByRange(partitions, "term").sortWithinPartitions("term", id_col).write.mode("append").parquet(path)


def tool_index_rows(results: DataFrame, *, text: str = "text") -> DataFrame:
    body = F.when(F.length(text) > INDEX_CAP, F.concat(F.substring(text, 1, INDEX_CAP), F.lit("\n... [truncated]"))).otherwise(F.col(text))
    return results.withColumn("result_text", body).withColumn("embed_text", F.substring(text, 1, TEXT_CAP))


def route_logs(entries: DataFrame, path: str) -> None:
    """Log entries (kind, ...) below one folder for each route; errors also count as their own route."""
    kind = F.when(F.col("level") == "error", "error").when(F.col("kind").isin(*ROUTES), F.col("kind")).otherwise("context")
    entries.withColumn("route", kind).write.mode("append").partitionBy("route").json(path)
