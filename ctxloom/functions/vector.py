"""Vectors: cosine, and a hash embedding for where no model is at hand."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 384
TEXT_CAP = 2000
#: Rows and queries that are compared in one task at a time.
ROWS, QUERIES = 4096, 256
#: Most rows that are compared with them in one task at a time where every pair is returned.
PAIRED_ROWS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, different dimensions and zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0)))


def by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the vectors that are not null, by dimension: places, vectors, norms. A vector that holds a null has norm 0."""
    v = column.combine_chunks()
    v = v if isinstance(v, pa.Array) else v.chunk(0)
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        flat = v.take(pa.array(at)).flatten()
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(at), d).any(1)
        m = np.where(holes[:, None], 0.0, m)
        out[int(d)] = at, m, np.sqrt((m * m).sum(1))
    return out


def _compare(k: int | None, places: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        n, m = queries.num_rows, rows.num_rows
        score = np.zeros((n, m))
        if n and m:
            left, right = by_size(queries["qv"]), by_size(rows["v"])
            for d in left.keys() & right.keys():
                (qi, q, qn), (ri, r, rn) = left[d], right[d]
                norm = qn[:, None] * rn
                with np.errstate(invalid="ignore", divide="ignore"):
                    score[np.ix_(qi, ri)] = np.where(norm == 0, 0.0, (q @ r.T) / norm)
        np.round(score, places, out=score)
        score += 0.0
        if k is None:
            at, on = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
        else:
            ids = rows["id"].to_numpy()
            # NaN comes first, as in Spark.
            order = np.lexsort((np.broadcast_to(ids, score.shape), -np.nan_to_num(score, nan=np.inf)), axis=1)[:, : k + 1] if m else np.zeros((n, 0), int)
            at, on = np.repeat(np.arange(n), order.shape[1]), order.ravel()
            other = queries["query_id"].to_numpy()[at] != ids[on]
            at, on = at[other], on[other]
        return pa.table({"query_id": queries["query_id"].take(pa.array(at)), "id": rows["id"].take(pa.array(on)), "score": pa.array(score[at, on])})

    return run


def compare(rows: DataFrame, queries: DataFrame, *, k: int | None = None, places: int = 5) -> DataFrame:
    """query_id, id, score: the rounded cosine() of every query (query_id, v) with every row (id, v), ids long, vectors array<double>.

    With k: of each block of rows only the k nearest to a query, ties to the
    smaller id, itself and null ids left out; ids are taken to be unique. Both
    sides are dealt into blocks, and each pair of blocks is one group, so that
    memory follows from the blocks' sizes alone.
    """
    if k is not None:
        rows = rows.where("id is not null")
    lots, blocks = (max(1, -(-df.count() // size)) for df, size in ((rows, ROWS if k is not None else min(ROWS, PAIRED_ROWS)), (queries, QUERIES)))
    of = lambda c, n: F.pmod(F.xxhash64(c, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "v", of("id", lots).alias("lot")).withColumn("block", every(blocks))
    right = queries.select("query_id", F.col("v").alias("qv"), of("query_id", blocks).alias("block")).withColumn("lot", every(lots))
    return left.groupBy("lot", "block").cogroup(right.groupBy("lot", "block")).applyInArrow(_compare(k, places), "query_id long, id long, score double")


@functools.lru_cache(1 << 15)
def _word_parts(word: str, dim: int) -> tuple[tuple[int, int], ...]:
    """Three places with 5, 3 and 2, with signs, from a word's md5."""
    h = hashlib.md5(word.encode()).digest()
    return tuple((int.from_bytes(h[2 * i : 2 * i + 2], "little") % dim, weight if h[6 + i] & 1 else -weight) for i, weight in enumerate((5, 3, 2)))


def _sparse(text: str | None, dim: int = DIM) -> dict[int, int]:
    """What the words of three characters or more add, by place. Integers keep the sums exact."""
    out: dict[int, int] = {}
    for word in re.sub(r"[^\w\s]", " ", (text or "")[:TEXT_CAP].lower(), flags=re.ASCII).split():
        if len(word) > 2:
            for place, weight in _word_parts(word, dim):
                out[place] = out.get(place, 0) + weight
    return out


def hash_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """Every word of three characters or more adds 5, 3 and 2, with signs, at three places that its md5 gives; unit length, as the scale cancels."""
    out = np.zeros(dim)
    for place, weight in _sparse(text, dim).items():
        out[place] = weight
    norm = np.sqrt(out @ out)
    return out / norm if norm else out


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pa.Array) -> pa.Array:
        # One block of numbers a batch, which Arrow takes as it is.
        out = np.zeros((len(batch), dim))
        for i, t in enumerate(batch):
            out[i] = hash_vector(t.as_py(), dim)
        return pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), out.ravel())

    return embed(text)


@functools.lru_cache(256)
def _with_norm(text: str | None) -> tuple[dict[int, int], float]:
    v = _sparse(text)
    return v, math.sqrt(sum(w * w for w in v.values()))


def pair_similarity(a: Column, b: Column) -> Column:
    """Cosine of two texts' hash embeddings; 0 where one has no words. Vectors are made pair by pair, and only texts go in and numbers come out; b is remembered, for pairs that share it."""

    @F.arrow_udf(T.DoubleType())
    def like(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left))
        for i, (t, u) in enumerate(zip(left, right)):
            y, ny = _with_norm(u.as_py())
            if ny:
                x = _sparse(t.as_py())
                if nx := math.sqrt(sum(w * w for w in x.values())):
                    out[i] = sum(w * y.get(place, 0) for place, w in x.items()) / (nx * ny)
        return pa.array(out)

    cut = lambda t: F.substring(t, 1, TEXT_CAP)
    return like(cut(a), cut(b))


#: A batch of texts to their vectors, in order; models plug in here.
Embedder = Callable[[list[str]], list]


def patient(embedder: Embedder, tries: int = 2, wait_s: float = 0.5) -> Embedder:
    """An embedder that tries a batch again after a pause that doubles, and then its texts one by one; a text that fails alone has no vector."""

    def attempt(batch: list[str]) -> list | None:
        for n in range(tries):
            try:
                return list(embedder(batch))
            except Exception:  # whatever a plugged-in model raises
                time.sleep(wait_s * 2**n)
        return None

    def run(batch: list[str]) -> list:
        found = attempt(batch)
        return found if found is not None else [v[0] if (v := attempt([t])) else None for t in batch]

    return run


def embed_missing(texts: DataFrame, cache: DataFrame, embedder: Embedder, *, text: str = "text", least: int = 10, batch: int = 32) -> DataFrame:
    """content_hash and embedding of the different texts of at least `least` characters that the cache (content_hash) lacks, in batches of `batch`."""
    new = texts.where(F.length(text) >= least).select(F.sha2(text, 256).alias("content_hash"), F.substring(text, 1, TEXT_CAP).alias("text")).dropDuplicates(["content_hash"])
    new = new.join(cache.select("content_hash"), "content_hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"], "embedding": [None if v is None else np.asarray(v, np.float32) for v in embedder(part["text"].tolist())]})

    return new.mapInPandas(run, "content_hash string, embedding array<float>")
