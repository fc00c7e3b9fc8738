"""Registered queries over tables made here, against plain versions: every row of a query set, whole texts."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import vector
from ctxloom.operators import extraction, lexical, select
from ctxloom.plans import more, queries  # noqa: F401  (more registers its queries beside the others)


def words(text):
    return [w for w in re.sub(r"[^\w\s]", " ", (text or "").lower(), flags=re.ASCII).split() if len(w) >= 2]


LEAD = "words that no document of this small table has, said at length; "
TEXTS = {1: "alpha beta beta gamma", 2: "delta " * 9 + "alpha", 3: "epsilon zeta eta", 4: "", 5: None, 6: "beta gamma zeta " * 4}
ASKED = {3: "beta", 10: "alpha gamma", 250: LEAD + "zeta zeta delta", 251: "", 252: None}


def plain_bm25():
    docs = {i: words(t) for i, t in TEXTS.items()}
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for q, asked in ASKED.items():
        for i, d in docs.items():
            tf = Counter(d)
            if found := [w for w in words(asked) if w in tf]:
                parts = (math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / average)) for w in found)
                out[q, i] = min(1.0, sum(parts) / 10)
    return out


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_search_asks_every_whole_query(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", broadcast, raising=False)
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_bm25()
    got = {(r.item_id, r.doc_id): r.bm25 for r in queries.QUERIES["bm25_corpus"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    found = queries.QUERIES["fts_search_bm25"](spark, str(tmp_path)).collect()
    assert {(r.item_id, r.doc_id) for r in found} == set(want)
    for q in {q for q, _ in want}:
        order = sorted((-round(s, 6), d) for (x, d), s in want.items() if x == q)
        assert [r.doc_id for r in sorted(found, key=lambda r: r["rank"]) if r.item_id == q] == [d for _, d in order]


def test_vectors_ask_every_hundredth_row(spark, tmp_path, monkeypatch):
    for name, n in (("ROWS", 100), ("QUERIES", 2)):
        monkeypatch.setattr(vector, name, n, raising=False)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    vectors = {i: base[rng.integers(40)].tolist() for i in range(620)} | {1: None, 2: [0.0] * 8, 200: base[0].tolist(), 201: [1.0, 2.0], 7: [None] + [1.0] * 7, 300: None, 202: []}
    spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        a, b = np.array(a), np.array(b)
        norm = np.sqrt(a @ a) * np.sqrt(b @ b)
        return round(float(a @ b / norm), 5) if norm else 0.0

    want = {(q, i): cosine(vectors[q], v) for q in range(0, 620, 100) for i, v in vectors.items()}
    got = {(r.query_id, r.vec_id): r.score for r in queries.QUERIES["cosine_pairs"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1.1e-5)
    top = queries.QUERIES["cosine_topk_queries"](spark, str(tmp_path)).collect()
    assert len(top) == 70
    for q in range(0, 620, 100):
        order = sorted((-s, i) for (x, i), s in got.items() if x == q and i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == q] == order


def test_facts_are_scored_over_their_whole_text(spark, tmp_path):
    filler = "zzz " * 60
    texts = {1: filler + "the and the", 2: "the and", 3: filler, 4: None, 5: "", 6: "other the", 7: filler + "and " * 400}
    rows = [(i, t, "src1" if i == 6 else "src0", "en", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def score(text):
        ws = re.split(r"\s+", text.lower())
        hits = [sum(w in q or q in w for w in ws) for q in ("the", "and")]
        return sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / 50)) for tf in hits)

    scores = {i: score(t) for i, t in texts.items() if i != 6 and t is not None}
    want = {i: 0.8 * s for i, s in scores.items() if s > 0.5}
    got = {r.id: r.score for r in queries.QUERIES["fact_retrieve_topk"](spark, str(tmp_path)).collect()}
    assert {1, 7} <= set(want) and got == pytest.approx(want, abs=1e-6)


def test_every_document_is_indexed(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(i, w, n, len(words(t))) for i, t in TEXTS.items() for w, n in Counter(words(t)).items()}
    index = queries.QUERIES["inverted_index"](spark, str(tmp_path)).collect()
    assert len(index) == len(want) and {(r.doc_id, r.term, r.tf, r.length) for r in index} == want
    tf = queries.QUERIES["term_freq"](spark, str(tmp_path)).collect()
    assert len(tf) == len(want) and {(r.doc_id, r.term, r.tf) for r in tf} == {x[:3] for x in want}


def test_letters_beyond_ascii_bound_acronyms(spark, tmp_path):
    """As in SQL: only ASCII word characters go on with a word."""
    asked = {1: "düSSü der ERRü xAPIx", 2: "üEABü und ü404ü", 3: "éAPIé", 4: "SS_ abSS SSa 12345 éXMLa"}
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    for name in ("keyword_extract", "fts_query_builder", "needs_fts"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
    keywords = {r.id: r.keywords for r in queries.QUERIES["keyword_extract"](spark, str(tmp_path)).collect()}
    assert keywords["b1"].startswith("SS|ERR|")


def test_results_that_share_an_id_are_both_cut(spark, tmp_path):
    """The hashes of two of these texts begin with the same 32 bits."""
    texts = {1: "text 859", 2: "text 4460", 3: "text 859", 4: "", 5: None, 6: "other. " * 400}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES["saved_chunks"](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['saved_chunks']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) == len({r[-1] for r in want}) > len({r[:2] for r in want})


def test_pairs_of_texts_never_become_vectors_in_the_plan(spark):
    """No column of a selection or of pairs holds a vector, and values are those of the vectors."""
    texts = ["alpha beta gamma", "beta beta delta epsilon", "", None, "a b c", "the " * 900 + "tail", "Größe für alle", "alpha beta gamma"]
    d = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)], "i int, j int, a string, b string")
    pairs = d.select("i", "j", vector.pair_similarity(F.col("a"), F.col("b")).alias("s"))
    rows = spark.createDataFrame([(i % 3, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    for df in (pairs, select.score(rows, recent=1)):
        assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()
    v = [vector.hash_vector(t) for t in texts]
    assert all(r.s == pytest.approx(float(v[r.i] @ v[r.j]), abs=1e-12) for r in pairs.collect())
    made = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", vector.hash_embedding(F.col("t")).alias("v")).collect()
    assert all(np.array_equal(r.v, v[r.i]) for r in made)


def test_conflicts_are_the_first_of_all_pairs(spark, monkeypatch):
    """Against a plain version: texts within one another, empty and null ones, vectors of some, in several blocks; and no join of all pairs."""
    monkeypatch.setattr(extraction, "BLOCK", 7, raising=False)
    rng = np.random.default_rng(5)
    base = "the Quick brown fox jumps over a lazy dog"
    cut = lambda: None if rng.random() < 0.05 else base[(i := int(rng.integers(0, 38))) : i + int(rng.choice([0, 1, 2, 3, 4, 7, 8, 9, 20]))]
    kinds = [None, [0.0, 0.0], [1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [1.0, None], [1.0]]
    fact = lambda i: (f"u{rng.integers(2)}", i, "ab"[rng.integers(2)], cut(), 0.5, kinds[rng.integers(0, 2 if i % 2 else 7)])
    new, old = [fact(i) for i in range(120)], [fact(1000 + i) for i in range(120)]
    schema = "user_id string, id long, category string, value string, confidence double, embedding array<float>"

    def cosine(a, b):
        if len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = math.hypot(*a) * math.hypot(*b)
        return float(np.dot(a, b)) / norm if norm else 0.0

    def conflict(n, o):
        if n[5] is not None and o[5] is not None:
            return cosine(n[5], o[5]) >= 0.75
        a, b = n[3], o[3]
        return a is not None and b is not None and (a.lower() in b.lower() or b.lower() in a.lower())

    want = {(n[0], n[1]): min(found) for n in new if (found := [(o[1], o[3]) for o in old if o[0] == n[0] and o[2] == n[2] and conflict(n, o)])}
    n, o = spark.createDataFrame(new, schema), spark.createDataFrame(old, schema)
    got = extraction.conflicts(n, o, threshold=0.75)
    assert {(r.user_id, r.id): (r.old_id, r.old_value) for r in got.collect()} == want and 20 < len(want) < 120
    assert "Contains" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_pairs_are_small(spark, monkeypatch):
    """Where every pair is returned, no task holds more than a small block of them at a time."""
    seen = spark.sparkContext.accumulator(0)
    whole = vector._compare

    def watched(k, places):
        run = whole(k, places)

        def one(rows, queries):
            if rows.num_rows * queries.num_rows > 200_000:
                seen.add(1)
            return run(rows, queries)

        return one

    monkeypatch.setattr(vector, "_compare", watched)
    rows = spark.range(4000).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    queries_ = rows.where("id % 16 = 0").withColumnRenamed("id", "query_id")
    assert vector.compare(rows, queries_).count() == 4000 * 250 and seen.value == 0
