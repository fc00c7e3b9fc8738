"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables projects unit vectors on orthogonal Gaussian directions
and cuts every projection into cells of WIDTH; a bucket is a tuple of cells. A
query visits the buckets in the order of their distance from its own
projections, which is the order of estimated success, and the candidates of
all tables are ranked by the exact cosine on the original vectors.

How many buckets are visited is measured: on a bounded sample, the smallest
number that finds TARGET of the exact neighbours. Where MOST_PROBES do not,
all queries are compared with all rows, in the same blocks. Equal vectors form a class
that is hashed and compared once.

Buckets are dealt into groups of about GROUP rows. A group that has more rows
or queries is dealt into blocks, so neither side is ever whole in one task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLES = 4
WIDTH = 2.5
GROUP = 4096
#: Rows and queries of the sample that sets the number of probes, and the recall it has to reach there.
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET = 8192, 200, 0.95
#: Most buckets of a table that a query visits.
MOST_PROBES = 512


class Hashes:
    def __init__(self, dim: int, hashes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hashes = hashes
        scale = np.sqrt(dim)
        blocks = [np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-hashes // dim))], 1)[:, :hashes] for _ in range(TABLES)]
        self.a = np.stack(blocks) * scale
        self.b = rng.uniform(0, WIDTH, (TABLES, hashes))
        self.code = rng.integers(1, 2**62, (TABLES, hashes)) | 1

    def project(self, unit: np.ndarray) -> np.ndarray:
        """(TABLES, rows, hashes), in cells."""
        return (np.einsum("rd,tdh->trh", unit, self.a) + self.b[:, None]) / WIDTH

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.code[table]).sum(-1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The cells of the n nearest buckets to one projected query, nearest first."""
        home = np.floor(x)
        into = x - home
        # Moving k cells down costs the way to that cell's edge, likewise up.
        steps = np.array([-3, -2, -1, 1, 2, 3])
        cost = np.where(steps < 0, into[:, None] - steps - 1, steps - into[:, None]) ** 2
        flat = np.argsort(cost, axis=None, kind="stable")
        price, coord, move = cost.ravel()[flat].tolist(), (flat // len(steps)).tolist(), steps[flat % len(steps)].tolist()
        found = [home]
        heap = [(price[0], (0,))]
        while heap and len(found) < n:
            c, own = heapq.heappop(heap)
            at = [coord[i] for i in own]
            if len(set(at)) == len(at):
                cell = home.copy()
                for i in own:
                    cell[coord[i]] += move[i]
                found.append(cell)
            last = own[-1]
            if last + 1 < len(flat):
                heapq.heappush(heap, (c - price[last] + price[last + 1], (*own[:-1], last + 1)))
                heapq.heappush(heap, (c + price[last + 1], (*own, last + 1)))
        return np.array(found)


def _matrix(column) -> np.ndarray:
    """Vectors as rows, each scaled by a power of two so that its largest component is near 1: exact, and neither norms nor products overflow or vanish."""
    m = np.array(list(column), np.float64)
    return np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def hashes_for(n: int) -> int:
    return int(np.clip(round(np.log2(max(n, 2)) / 2), 2, 16))


def measured_probes(sample: np.ndarray, hashes: Hashes, k: int, target: float = TARGET) -> int | None:
    """The smallest number of probes a table that finds `target` of the k exact neighbours of the sample's queries; None if MOST_PROBES do not. In a sample neighbours are farther than in all rows, so this is on the safe side."""
    n = len(sample)
    if n <= k + 1:
        return 1
    unit = _unit(sample)
    queries = np.arange(0, n, max(1, n // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    close = unit[queries] @ unit.T
    close[np.arange(len(queries)), queries] = -2
    exact = np.argpartition(-close, k, axis=1)[:, :k]
    projected = hashes.project(unit)
    keys = [hashes.keys(np.floor(projected[t]), t) for t in range(TABLES)]
    best = np.full((len(queries), k), 1 << 30)
    for i, q in enumerate(queries):
        for t in range(TABLES):
            visit = hashes.keys(hashes.probes(projected[t][q], MOST_PROBES), t)
            rank = {key: r for r, key in enumerate(visit.tolist())}
            best[i] = np.minimum(best[i], [rank.get(x, 1 << 30) for x in keys[t][exact[i]].tolist()])
    need = np.sort(best.ravel())[min(best.size - 1, int(np.ceil(target * best.size)) - 1)]
    return int(need + 1) if need < MOST_PROBES else None


def _search(k: int):
    """Exact cosines of a block of queries and a block of rows, for the pairs whose bucket the query visits; the k best of every query."""

    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = {"query": [], "cls": [], "score": []}
        if len(rows) and len(queries):
            v, ids, keys = _matrix(rows["v"]), rows["cls"].to_numpy(), rows["key"].to_numpy()
            norms = np.linalg.norm(v, axis=1)
            order = np.argsort(ids)
            v, ids, keys, norms = v[order], ids[order], keys[order], norms[order]
            for start in range(0, len(queries), 256):
                part = queries.iloc[start : start + 256]
                q = _matrix(part["v"])
                score = (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * norms)
                for i, (own, visit) in enumerate(zip(part["cls"], part["keys"])):
                    on = np.arange(len(ids)) if visit is None else np.flatnonzero(np.isin(keys, visit))
                    if len(on) > k:
                        s = score[i, on]
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        on = on[s >= edge]
                        on = on[np.argsort(-score[i, on], kind="stable")][:k]
                    found["query"] += [own] * len(on)
                    found["cls"] += ids[on].tolist()
                    found["score"] += score[i, on].tolist()
        return pd.DataFrame(found).astype({"query": "int64", "cls": "int64", "score": "float64"})

    return run


def _pass(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index: cls, v, table, key, grp. queries: cls, v, table, grp, keys. -> query, cls, score."""
    rows_of = index.groupBy("table", "grp").agg(F.ceil(F.count("*") / (2 * GROUP)).cast("int").alias("blocks"))
    asks_of = queries.groupBy("table", "grp").agg(F.ceil(F.count("*") / (2 * GROUP)).cast("int").alias("lots"))
    plan = rows_of.join(asks_of, ["table", "grp"])
    of = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(plan, ["table", "grp"]).withColumn("block", of("blocks")).withColumn("lot", every("lots")).select("table", "grp", "block", "lot", "cls", "key", "v")
    right = queries.join(plan, ["table", "grp"]).withColumn("lot", of("lots")).withColumn("block", every("blocks")).select("table", "grp", "block", "lot", "cls", "keys", "v")
    at = ["table", "grp", "block", "lot"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_search(k), "query long, cls long, score double")


def nearest(df: DataFrame, is_query, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 5, target: float = TARGET) -> DataFrame:
    """For every row of df that is_query holds for: query_id, rank (from 1), vec_id, score (cosine), the k nearest other rows found.

    Nearest first, ties to the smaller id. Vectors that are null, zero, or
    hold null or non-finite components take no part, nor do those of another
    dimension than most, nor rows with a null id; of rows that repeat an id
    and a vector one counts. A query for which fewer than k were found is
    compared with all rows, and so is every query where the sample's recall
    does not reach the target. An empty table gives an empty result.
    """
    spark = df.sparkSession
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["d"]
    rows = rows.where(F.size("v") == dim)
    classes = materialise(rows.groupBy("v").agg(F.min("id").alias("cls"), F.max("q").alias("q")), "classes")
    n = classes.count()
    members = rows.join(classes.select("v", "cls"), "v").select("id", "cls", "q").distinct()
    members = materialise(members, "classmembers")
    # A bounded sample, by a hash of the class.
    sample = [r["v"] for r in classes.orderBy(F.xxhash64("cls")).select("v").limit(SAMPLE_ROWS).collect()]
    hashes = Hashes(dim, hashes_for(n))
    probes = measured_probes(_matrix(sample), hashes, k, target)
    groups = max(1, round(n / GROUP))

    def bucket(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = hashes.project(_unit(_matrix(pdf["v"])))
            for t in range(TABLES):
                keys = hashes.keys(np.floor(x[t]), t)
                yield pd.DataFrame({"cls": pdf["cls"], "v": pdf["v"], "table": np.int32(t), "key": keys, "grp": (keys % groups).astype(np.int32)})

    def visit(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = hashes.project(_unit(_matrix(pdf["v"])))
            for t in range(TABLES):
                out = {"cls": [], "v": [], "table": [], "grp": [], "keys": []}
                for i, (cls, v) in enumerate(zip(pdf["cls"], pdf["v"])):
                    keys = hashes.keys(hashes.probes(x[t][i], probes), t)
                    grp = keys % groups
                    for g in np.unique(grp):
                        out["cls"].append(cls), out["v"].append(v), out["table"].append(t), out["grp"].append(g), out["keys"].append(keys[grp == g])
                yield pd.DataFrame(out).astype({"table": "int32", "grp": "int32"})

    index = classes.select("cls", "v").mapInPandas(bucket, "cls long, v array<double>, table int, key long, grp int")
    asked = classes.where("q").select("cls", "v")

    def best(found: DataFrame) -> DataFrame:
        once = found.groupBy("query", "cls").agg(F.max("score").alias("score"))
        return once.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))).where(F.col("r") <= k + 1).drop("r")

    if probes is None:
        found, short = None, asked
    else:
        first = _pass(index, asked.mapInPandas(visit, "cls long, v array<double>, table int, grp int, keys array<long>"), k + 1)
        found = materialise(best(first), "found")
        short = asked.join(found.groupBy("query").count().where(F.col("count") > k), F.col("cls") == F.col("query"), "left_anti")
    # Too few found, or no number of probes is enough: one table, all its groups, every bucket.
    again = short.select("cls", "v", F.lit(0).alias("table"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(None).cast("array<long>").alias("keys"))
    rest = materialise(best(_pass(index.where("table = 0"), again, k + 1)), "found")
    ranked = rest if found is None else found.join(rest.select("query").distinct(), "query", "left_anti").unionByName(rest)
    # Of a class no more than its k + 1 smallest ids can be among the k nearest.
    some = members.select("id", "cls").withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    pairs = members.where("q").select(F.col("id").alias("query_id"), F.col("cls").alias("query")).join(ranked, "query").join(some, "cls").where("id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
