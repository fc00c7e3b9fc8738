"""Document fingerprints by SpotSigs, in DataFrame functions only.

A text is lower-cased and cut into words (runs of letters and digits). A
common word followed by a content word is an anchor; its chain is the anchor
and the next CHAIN content words, passing over one common word between two of
them. The fingerprint is the sorted set of 64-bit hashes of the chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import alternatives, materialise, own_name

#: Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be by for from has have he in is it its of on or she that the this to was were which will with "
    "als am an auch auf aus bei das dem den der des die durch ein eine für im ist mit nach nicht sich sie und von vor zu zum zur "
    "au aux avec ce dans de des du elle en est et il la le les par pas pour qui que se sur un une "
    "al con como del el ella en es esta este las lo los más no para por se su una y"
).split()
CHAIN = 2
#: Rows of a range of ids that stand in one task, and most ranges; beyond these, ranges grow and their sort spills.
ROWS_PER_RANGE, MOST_RANGES = 2_000, 65_536
#: Bounds of ranges that a row is compared with at once.
FAN = 256


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.transform(F.array(value), then)[0]


def chains(text: Column, anchors=tuple(ANCHORS)) -> Column:
    """The chains of a text as strings, in order, repeats included."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    marked = F.regexp_replace(words, f" (?={alternatives(anchors)} )", " #")
    # Of neighbouring common words the last one is the anchor.
    lone = F.regexp_replace(marked, " #[^ ]++(?= #)", "")
    chain = "#(?=([^ ]++" + " [^ #]++(?: #[^ ]++)?" * (CHAIN - 1) + " [^ #]++) )"
    found = F.regexp_extract_all(lone, F.lit(chain), F.lit(1))
    # At most one common word stands between two content words.
    return F.transform(found, lambda c: F.regexp_replace(c, " #[^ ]++", ""))


def fingerprint(text: Column) -> Column:
    """array<long>, sorted and distinct: the hashed chains of a text.

    Null counts as empty. A text without chains has one entry, its whole text
    hashed; an empty text has none. Equal texts have equal fingerprints.
    """
    text = F.coalesce(text, F.lit(""))
    hashed = F.array_distinct(F.transform(chains(text), lambda c: F.xxhash64(c)))
    none = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text)))
    return _let(F.sort_array(hashed), lambda found: F.when(F.size(found) > 0, found).otherwise(none))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints; 1 for two empty ones.

    Pruned: where the ratio of the sizes is 0 there is nothing to intersect.
    """
    ratio = _let(F.size(F.array_intersect(a, b)), lambda common: common / (F.size(a) + F.size(b) - common))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(ratio).cast("double")


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as hexadecimal words."""
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), " ")


def _placed(df: DataFrame, id_col: str, part: str) -> DataFrame:
    """df with the number of its range of ids; null ids are in one more. Bounds come from Spark's own range partitioning of the ids alone."""
    ranges = max(1, min(MOST_RANGES, df.count() // ROWS_PER_RANGE))
    if ranges == 1:
        return df.withColumn(part, F.lit(0))
    ids = df.select(F.col(id_col).alias("i")).where("i is not null").repartitionByRange(ranges, "i")
    highs = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.max("i").alias("h"))
    every = F.array_sort(F.collect_list("h"))  # at most MOST_RANGES
    coarse = F.transform(F.sequence(F.lit(1), F.greatest(F.size("b"), F.lit(1)), F.lit(FAN)), lambda i: F.get("b", i - 1))
    bounds = highs.agg(every.alias("b")).select("b", coarse.alias("c"))
    b, c, block = own_name(df, "bounds"), own_name(df, "coarse"), own_name(df, "block")
    placed = df.join(F.broadcast(bounds.select(F.col("b").alias(b), F.col("c").alias(c))))  # one row
    below = lambda bound: bound < F.col(id_col)
    placed = placed.withColumn(block, F.greatest(F.lit(0), F.size(F.filter(c, below)) - 1))
    place = F.col(block) * FAN + F.size(F.filter(F.slice(b, F.col(block) * FAN + 1, F.lit(FAN)), below))
    return placed.withColumn(part, F.when(F.col(id_col).isNull(), F.size(b)).otherwise(place)).drop(b, c, block)


def with_next(df: DataFrame, *, id_col: str, cols: list[str], text: str, derived: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """df with next_<col> of the row with the next id; after the last row comes the first. derived: columns made from cols, to be added to both, once a row.

    Rows of equal ids are ordered by text; null ids come last. Rows are dealt
    into ranges of ids, so that no task has all rows; each range hands its
    first row to the range before. An empty table gives an empty result, and a
    table of one row is its own next.
    """
    part = own_name(df, "range")
    rows = _placed(df, id_col, part)
    order = [F.col(id_col).asc_nulls_last(), F.col(text).asc_nulls_first()]
    line = Window.partitionBy(part).orderBy(*order)
    nexts = F.struct(*cols, *derived)
    led = rows.withColumns(derived) if derived else rows
    led = led.withColumn("__next", F.lead(nexts).over(line))
    first = rows.groupBy(part).agg(F.min(F.struct(F.col(id_col).isNull().alias("o"), F.col(id_col).alias("i"), F.col(text).isNotNull().alias("p"), F.col(text).alias("t"), F.struct(*cols).alias("v"))).alias("f"))
    # As many rows as ranges.
    ring = Window.partitionBy(F.lit(0)).orderBy(part)
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hand = first.select(part, F.coalesce(F.lead(F.col("f.v")).over(ring), F.first("f.v").over(whole)).alias("__v")).select(part, *[F.col(f"__v.{c}").alias(c) for c in cols])
    hand = (hand.withColumns(derived) if derived else hand).select(part, nexts.alias("__first"))
    led = led.join(hand, part, "left").withColumn("__next", F.coalesce("__next", "__first"))
    return led.select(*df.columns, *derived, *[F.col(f"__next.{c}").alias(f"next_{c}") for c in (*cols, *derived)])


def edited_text(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def similar_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """Of representatives (rep, fp) the pairs (a, b) whose likeness is at least percent / 100, each once.

    Fingerprints are partitioned by set length, so that a set meets only its
    own partition and the next longer one; within, they are matched on a
    prefix of their rarest signatures (a pair over the threshold shares one),
    and pairs whose lengths rule the threshold out are dropped before the
    sets are compared. All pairs that link come out, so in a family of distinct
    near copies they grow with its square. Empty fingerprints link with nothing.
    """
    t = percent / 100
    seen = reps.select("rep", F.explode("fp").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    ranked = reps.select("rep", F.size("fp").alias("n"), F.explode("fp").alias("sig")).join(seen, "sig")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "sig"))
    prefix = ranked.withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(t * F.col("n")) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / t)) + 1e-9).cast("int")
    prefix = prefix.withColumn("part", part)
    left = prefix.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select("sig", F.col("rep").alias("b"), F.col("n").alias("nb"), "part")
    near = (F.col("a") != F.col("b")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = left.join(right, ["sig", "part"]).where(near & (F.col("na") >= t * F.col("nb"))).select("a", "b").distinct()
    sets = reps.select("rep", "fp")
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("fp").alias("fa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("fp").alias("fb")), "b")
    common = F.size(F.array_intersect("fa", "fb"))
    return both.where(100 * common >= percent * (F.size("fa") + F.size("fb") - common)).select("a", "b")


def similar(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row for each row of df: id, class_id, n_links.

    Rows of one fingerprint form a class, represented by its smallest id;
    n_links is the number of representatives that it links with, of which
    similar_pairs() gives the pairs. Rows with empty fingerprints (null and
    empty texts) have class null and no links; null ids take no part; rows
    that repeat have a row each; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), fingerprint(F.col(text)).alias("fp")).where("id is not null")
    rows = materialise(rows, "spots")
    reps = materialise(rows.where(F.size("fp") > 0).groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    links = similar_pairs(reps, percent)
    counts = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    classes = reps.select("fp", F.col("rep").alias("class_id")).join(counts, "class_id", "left")
    return rows.join(classes, "fp", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
