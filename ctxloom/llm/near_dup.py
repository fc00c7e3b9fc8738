"""Near duplicates by MinHash: one-permutation hashing with optimal
densification, banded buckets and star-shaped candidate edges.

Steps, each a table in the shared folder where it is read more than once:

1. Every text gives its set of shingles (numpy over the Arrow buffer, no
   Python object a word), a signature of 256 bins from one hash a shingle,
   empty bins filled by optimal densification, and band keys.
2. Rows with equal sets collapse into one representative, so that copies
   cost one row from here on.
3. In each bucket (band, key) every member is paired with the bucket's
   smallest member only: a star. Candidate pairs grow with the rows, not
   with the square of a bucket. Links are confirmed on whole sets.
4. A star can miss a link between two members that don't link with its
   centre. Buckets whose other members still lie in several components (so of
   three members at least) are gone through again: members are compared across components by signature, in
   blocks, and only pairs whose estimate is within reach of the threshold go
   on to be confirmed. No bucket is capped.
5. Components by alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, remove, small_batches

BINS = 256
#: Chance that a pair at the threshold has no band in common, at most.
MISS = 1e-5
#: Bins of the finer signature by which members of different components are compared.
FINE = 2048
#: Members of a bucket that are compared in one step.
BLOCK = 512
#: Ids of documents that are broadcast, to read their texts without a shuffle of all texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Attempts of densification that are made by table; what is left takes the next filled bin.
ATTEMPTS = 64

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, over uint64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True



@lru_cache(maxsize=4)
def _probes(bins: int) -> np.ndarray:
    """Where an empty bin looks for a filled one, in order."""
    return (_mix(np.arange(bins * ATTEMPTS, dtype=np.uint64) + np.uint64(977)) % np.uint64(bins)).astype(np.int64).reshape(bins, ATTEMPTS)


@lru_cache(maxsize=8)
def band_rows(percent: int) -> int:
    """Bins of a band: as many as leave a pair at the threshold without a common band with a chance of MISS at most."""
    if not 0 < percent <= 100:
        raise ValueError("percent is between 1 and 100")
    p = percent / 100
    return max([r for r in range(1, 9) if (1 - p**r) ** (BINS // r) <= MISS], default=1)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    bands = BINS // rows
    weight = _mix(np.arange(rows, dtype=np.uint64) + np.uint64(31)) | np.uint64(1)
    which = _mix(np.arange(bands, dtype=np.uint64) + np.uint64(57))
    with np.errstate(over="ignore"):
        return _mix((_mix(values[: bands * rows].reshape(bands, rows)) * weight).sum(1) + which).view(np.int64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts as bytes in one buffer: a hash for every word, and for every text where its words begin (one entry more at the end)."""
    low = _LOWER[data]
    inside = ~_SPACE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(low)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    length = np.diff(begin, append=len(at))
    weight = _mix(np.arange(length.max(), dtype=np.uint64)) | np.uint64(1)
    position = np.arange(len(at)) - np.repeat(begin, length)
    with np.errstate(over="ignore"):
        value = _BYTE[low[at]] * weight[position]
        return _mix(np.add.reduceat(value, begin)), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text.

    A text of fewer than k words has its whole sequence as one shingle, a text
    without words (or null) none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    words, bounds = word_hashes(data, offsets - offsets[0])
    spread = _mix(np.arange(k, dtype=np.uint64) + np.uint64(101)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(n):
            w = words[bounds[i] : bounds[i + 1]]
            if len(w) >= k:
                h = w[: len(w) - k + 1] * spread[0]
                for j in range(1, k):
                    h = h + w[j : len(w) - k + 1 + j] * spread[j]
                h = _mix(h)
                h.sort()
                yield h[np.concatenate(([True], h[1:] != h[:-1]))]
            elif len(w):
                yield _mix(np.array([(w * spread[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
            else:
                yield w


def signature(shingles: np.ndarray, n_bins: int = BINS) -> np.ndarray:
    """One value for each bin, of which there are a power of two. shingles: sorted, so the first of a bin is its minimum."""
    bins = (shingles >> np.uint64(65 - n_bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    filled = bins[first]
    out = np.zeros(n_bins, np.uint64)
    out[filled] = shingles[first]
    if len(filled) < n_bins:
        probes = _probes(n_bins)
        has = np.zeros(n_bins, bool)
        has[filled] = True
        empty = np.flatnonzero(~has)
        hit = has[probes[empty]]
        source = probes[empty, hit.argmax(1)]
        left = ~hit.any(1)
        if left.any():
            after = np.searchsorted(filled, probes[empty[left], 0]) % len(filled)
            source[left] = filled[after]
        out[empty] = out[source]
    return out


def _sketches(k: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 512):
                part = batch.slice(start, 512)
                n, fp, keys = [], [], []
                for s in shingle_sets(part.column(1), k):
                    n.append(len(s))
                    if not len(s):
                        fp.append(None), keys.append(None)
                        continue
                    with np.errstate(over="ignore"):
                        fp.append(np.array([_mix(s).sum(), _mix(s ^ _M2).sum()], np.uint64).tobytes())
                    keys.append(band_keys(signature(s), rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "fp", "keys"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(start, 256)
                found = [s.view(np.int64) for s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "set"])

    return run


def _fine(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(start, 256)
                found = [_mix(signature(s, FINE)).astype(np.uint8).tobytes() if len(s) else None for s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "sig"])

    return run


def sketches(df: DataFrame, id_col: str, text: str, k: int, rows: int) -> DataFrame:
    """id, n (size of the set), fp (128 bits of the set), keys (of bands of `rows` bins). Without words n is 0 and fp and keys are null; repeated rows have a sketch each."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_sketches(k, rows), T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, of reps) those whose whole sets reach the threshold, by integers. No aggregate stands on the joins, so that Spark can split a task in which one centre has very many pairs; an id with several sets can give a pair twice."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return both.withColumn("c", common).where(100 * F.col("c") >= percent * (F.size("sa") + F.size("sb") - F.col("c"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): id, root (the smallest id reachable), for ids with a link.

    Alternates large-star and small-star until the links no longer change.
    Each round joins the links with the smallest neighbour of every node; no
    neighbour list is gathered, so a node of any degree is fine. Links that
    repeat count once, links of a node to itself not at all; without links
    there are no rows.
    """
    now = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small, "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(now)
        now = after
        if mark == sign:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        sign = mark


def _across(reach: int, percent: int):
    """Pairs of one block pair of a bucket: other component, sizes that allow the threshold, no bucket in common before this one, and signatures that agree in reach bins at least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, root, n, side = (pdf[c].to_numpy() for c in ("id", "root", "n", "side"))
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(ids), FINE)
        keys = np.array(pdf["keys"].tolist(), np.int64)
        band = int(np.flatnonzero((keys == pdf["key"].iloc[0]).all(0))[0])
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        one, two = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(side == pdf["i"].iloc[0]), np.flatnonzero(side == pdf["j"].iloc[0]))
        a, b = [], []
        for x in one:
            of = two[(root[two] != root[x]) & (100 * np.minimum(n[two], n[x]) >= percent * np.maximum(n[two], n[x]))]
            if same:
                of = of[of > x]
            if band and len(of):
                of = of[~(keys[of, :band] == keys[x, :band]).any(1)]
            if len(of):
                of = of[(sig[of] == sig[x]).sum(1) >= reach]
                a.append(np.full(len(of), ids[x])), b.append(ids[of])
        a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: doc_id (the id), n_shingles, component_id, kept.

    Two rows link when their sets of k-word shingles have a Jaccard similarity
    of at least percent / 100, by integers. component_id is the smallest id
    reachable; kept marks the row with that id. Rows without words (also null
    texts) link with nothing. Rows that repeat an id count as one document:
    all of them carry its smallest component; of rows that are equal in id
    and set all are kept. A null id takes no part: component_id null, kept
    true. An empty table gives an empty result; other columns are not read.

    Links are confirmed on whole sets, but found by chance: a pair at the
    threshold shares no bucket with a chance of MISS, and within an open bucket
    its fine signatures fall short by five standard deviations less often
    still. Pairs above the threshold are missed more rarely.
    """
    spark = df.sparkSession
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    docs = df.withColumn(id_col, F.col(id_col).cast("long"))
    sketch = sketches(docs, id_col, text, k, band_rows(percent))
    # Equal sets collapse; of a set, the smallest id stands for all.
    sketch = materialise(sketch, "sketch")
    full = sketch.select("id", "n", "fp")
    reps = materialise(sketch.where("id is not null and fp is not null").groupBy("fp").agg(F.min(F.struct("id", "n", "keys")).alias("r")).select("fp", "r.*"), "reps")
    buckets = reps.select("id", "n", F.explode("keys").alias("key"))
    centres = buckets.groupBy("key").agg(F.min("id").alias("b"), F.min_by("n", "id").alias("m"), F.count("*").alias("size")).where("size > 1")
    # Members of buckets that hold more than one: all that the rest reads.
    crowded = materialise(buckets.join(centres, "key"), "buckets")
    close = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & (F.col("id") != F.col("b"))
    star = materialise(crowded.where(close).select(F.col("id").alias("a"), "b").distinct(), "stars")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = ids.distinct()
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")

    def sets_of(pairs: DataFrame) -> DataFrame:
        return texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))).mapInArrow(_sets(k), "id long, set array<long>")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        sets = materialise(sets_of(pairs), "sets")
        found = materialise(_confirm(pairs, sets, percent), name)
        remove(sets)
        return found

    links = confirmed(star, "links")
    remove(star)
    found = components(links)
    # What the stars have left open: buckets with members in several components, the centre aside, all of whose pairs are decided.
    open_rows = crowded.where("id <> b").select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    unsolved = open_rows.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = materialise(open_rows.join(unsolved, "key"), "open")
    # Of an id that repeats with other texts one signature counts: such rows are one document.
    fine = materialise(texts_of(members.select("id")).mapInArrow(_fine(k), "id long, sig binary").where("sig is not null").groupBy("id").agg(F.min("sig").alias("sig")), "fine")
    dealt = members.join(reps.select("id", "n", "keys"), "id").join(fine, "id").withColumn("side", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    # Five standard deviations below the threshold.
    p = percent / 100
    reach = int(FINE * (p - 5 * (p * (1 - p) / FINE) ** 0.5))
    more = dealt.groupBy("key", "i", "j").applyInPandas(_across(reach, percent), "a long, b long").distinct()
    more = materialise(more, "pairs")
    rest = confirmed(more, "links")
    remove(more), remove(members), remove(fine)
    roots = components(links.unionByName(rest))
    remove(found), remove(links), remove(rest), remove(crowded)
    of_set = reps.select("fp", "id").join(roots, "id", "left").select("fp", F.col("id").alias("rep"), F.coalesce("root", "id").alias("root"))
    # Rows without words have no set to meet; copies of a set are joined by a join that Spark can split.
    out = full.where("fp is not null").join(of_set, "fp", "left").select("id", "n", "root").unionByName(full.where("fp is null").select("id", "n", F.lit(None).cast("long").alias("root")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
