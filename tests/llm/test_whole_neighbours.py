"""Neighbours where no allowed number of probes reaches the target."""

import numpy as np
from pyspark.sql import functions as F

from ctxloom.llm import neighbours


def test_all_rows_are_compared_where_probes_miss_the_target(spark):
    """Uniform vectors of many dimensions and as many hashes as a large table has: 512 probes find few of the neighbours."""
    rng = np.random.default_rng(6)
    n, k = 1500, 5
    v = np.float32(rng.normal(size=(n, 256)))
    v[700:720] = v[700]
    hashes = neighbours.Hashes(256, 16)
    assert neighbours.measured_probes(v.astype(float), hashes, k) is None

    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    kept = neighbours.hashes_for
    neighbours.hashes_for = lambda _: 16
    try:
        rows = neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=k).collect()
    finally:
        neighbours.hashes_for = kept
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert sorted(got) == list(range(0, n, 50))
    for q, found in got.items():
        s = np.round(u @ u[q], 12)
        s[q] = -9
        assert found == sorted(range(n), key=lambda i: (-s[i], i))[:k]
