"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in a line ordered by size; each has the
same number of expected copies, target / source size. The running sum of
expected copies, moved by one random offset a source, crosses an integer
boundary as often as the document is emitted, so every document's number of
copies is its expected one on average. The line is ordered by size so that the
words taken, and not the number of documents alone, come near the target: they
differ from it by less than the source's longest document has words.

Scale: no source is ever in one task. A document belongs to a cell (source,
size class, block), where the block is a hash of the row and the number of
blocks grows with rows and bytes. Running sums are taken over size classes,
over the blocks of a class, and then within each cell. One shuffle carries the
rows. Sources themselves are ranked in one task, a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, own_name, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
#: What a block of all rows holds at most; a cell holds a source's and a size class's part of it.
ROWS_PER_BLOCK, BYTES_PER_BLOCK = 20_000, 256_000_000


def targets(df: DataFrame, source: str, size: str, weights=WEIGHTS, budget: float = 1.0, cap: float = MOST_COPIES) -> DataFrame:
    """Per source: source, source_size, target.

    weights repeat along the sources in code-point order, null last. Targets
    share budget * all sizes by weight; none is over cap * its source's size,
    and the excess is shared again by weight among the others until none is
    above. That has a closed form: with sources in the order of cap / weight,
    the first so many are capped and the rest get level * weight.
    A source without size gets target 0. Rows here are sources, not documents.
    """
    per = df.groupBy(F.col(source).alias("__s")).agg(F.sum(size).alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("__i", F.row_number().over(everything.orderBy(F.col("__s").asc_nulls_last())) - 1)
    per = per.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int")))
    per = per.withColumn("__cap", cap * F.col("source_size").cast("double"))
    per = per.withColumn("__order", F.col("__cap") / F.col("__w"))
    before = everything.orderBy("__order", "__i").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    per = per.withColumn("__total", budget * F.sum(F.col("source_size")).over(everything).cast("double"))
    per = per.withColumn("__left", F.col("__total") - F.coalesce(F.sum("__cap").over(before), zero))
    per = per.withColumn("__rest", F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), zero))
    per = per.withColumn("__level", F.try_divide(F.col("__left"), F.col("__rest")))
    # The level is that of the first source, in this order, that stays under its cap.
    level = F.min_by("__level", F.when(F.col("__level") <= F.col("__order"), F.struct("__order", "__i"))).over(everything)
    target = F.least(F.col("__cap"), F.coalesce(level * F.col("__w"), F.col("__cap")))
    return per.select("__s", "source_size", F.greatest(target, zero).alias("target"))


def _mixed(df: DataFrame, source: str, id_col: str, text: str, weights, budget: float, cap: float, seed: int, size_col: str | None, tie_col: str | None) -> tuple[DataFrame, dict[str, str]]:
    """df with size, source_size, target and copies under names that df doesn't have; and those names."""
    name = {x: own_name(df, x) for x in ("size", "source_size", "target", "copies", "class", "block", "src", "at", "before", "n", "tie")}
    size, src = F.col(name["size"]), F.col(name["src"])
    cell = [name["src"], name["class"], name["block"]]
    whole = text in df.columns
    tie = F.col(tie_col) if tie_col else F.xxhash64(F.col(text)) if whole else F.lit(0)
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) if whole else F.lit(0)).first()
    blocks = max(1, -(-n // ROWS_PER_BLOCK), -(-held // BYTES_PER_BLOCK))
    rows = df.withColumn(name["size"], F.coalesce(F.col(size_col).cast("long"), F.lit(0).cast("long")) if size_col else word_count(F.col(text)))
    rows = rows.withColumn(name["class"], F.when(size > 0, F.floor(8 * F.log2(size.cast("double")))).otherwise(-1).cast("int"))
    rows = rows.withColumn(name["tie"], tie).withColumn(name["block"], F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(name["tie"])), F.lit(blocks)).cast("int"))
    rows = rows.withColumn(name["src"], F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null")))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("n"), F.sum(size).alias("words"), F.any_value(source).alias("source")).withColumnsRenamed(dict(zip(cell, ("src", "class", "block"))))
    cells = materialise(cells, "cells")
    rate = targets(cells, "source", "words", weights, budget, cap).select(F.coalesce(F.concat(F.lit("s"), F.col("__s").cast("string")), F.lit("null")).alias("src"), F.col("source_size").alias(name["source_size"]), F.col("target").alias(name["target"]))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    classes = cells.groupBy("src", "class").agg(F.sum("n").alias("n")).withColumn("low", sum_of("n", earlier("src").orderBy("class")))
    starts = cells.withColumn("in", sum_of("n", earlier("src", "class").orderBy("block"))).select("src", "class", "block", "in").join(classes.select("src", "class", "low"), ["src", "class"]).join(rate, "src")
    starts = starts.withColumn(name["before"], F.col("low") + F.col("in")).drop("low", "in").withColumnsRenamed(dict(zip(("src", "class", "block"), cell)))
    # Window and join deal rows by the same columns: one shuffle for both.
    out = rows.withColumn(name["at"], F.row_number().over(Window.partitionBy(*cell).orderBy(size, F.col(id_col), F.col(name["tie"])))).join(starts, cell, "left")
    rate_of = F.coalesce(F.try_divide(F.col(name["target"]), F.col(name["source_size"]).cast("double")), F.lit(0.0))
    at = F.col(name["before"]) + F.col(name["at"])
    offset = F.pmod(F.xxhash64(F.lit(seed), src), F.lit(1 << 30)).cast("double") / float(1 << 30)
    copies = F.floor(at * rate_of + offset) - F.floor((at - 1) * rate_of + offset)
    # Rounding in the running sum can add no copy beyond the next whole number.
    return out.withColumn(name["copies"], F.least(copies, F.ceil(rate_of)).cast("long")), name


def mix(df: DataFrame, *, source: str = "source", id_col: str = "doc_id", text: str = "text", weights=WEIGHTS, budget: float = 1.0, cap: float = MOST_COPIES, seed: int = 7, size_col: str | None = None, tie_col: str | None = None) -> DataFrame:
    """df with the columns size, source_size, target, copies.

    size is the number of words of text (or size_col, if given). Every row
    stays, with copies possibly 0; sample() repeats rows. Null sources form a
    source of their own. Null and empty texts have size 0 and may be emitted
    at no cost; null ids are ordered first. Rows that repeat, with equal ids,
    are ordered by tie_col (a hash of text, if none is given) and are each
    counted. An empty table gives an empty result. Columns of df named size,
    source_size, target or copies are replaced.
    """
    out, name = _mixed(df, source, id_col, text, weights, budget, cap, seed, size_col, tie_col)
    new = ("size", "source_size", "target", "copies")
    return out.select(*[c for c in df.columns if c not in new], *[F.col(name[c]).alias(c) for c in new])


def sample(df: DataFrame, *, source: str = "source", id_col: str = "doc_id", text: str = "text", weights=WEIGHTS, budget: float = 1.0, cap: float = MOST_COPIES, seed: int = 7, size_col: str | None = None, tie_col: str | None = None) -> DataFrame:
    """The mix itself: each row of df as often as mix() says, with df's columns, whatever their names.

    Nulls, empty texts and repeated rows as in mix(). Long texts count towards
    BYTES_PER_BLOCK. An empty table gives an empty result.
    """
    out, name = _mixed(df, source, id_col, text, weights, budget, cap, seed, size_col, tie_col)
    repeated = out.where(F.col(name["copies"]) > 0).withColumn(name["n"], F.explode(F.array_repeat(F.lit(0), F.col(name["copies"]).cast("int"))))
    return repeated.select(*df.columns)
