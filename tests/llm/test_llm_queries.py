"""Every registered query of the training-data operators, and every stage of the pipeline, against plain versions over a folder of small tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import SECRETS, edit, plain_components, plain_fingerprint, plain_spans, prose

from ctxloom.llm import fingerprints, mixing, queries, quality, secrets

P = pytest.importorskip("public_tokenizers")
R = random.Random(12)


@pytest.fixture(scope="module")
def rows():
    """doc_id, text, lang, source, n_chars, and columns whose names the operators use themselves."""
    base = [prose(R.choice([4, 30, 90, 700])) for _ in range(60)]
    texts = base + [edit(b, 0.004) for b in base[:25]] + base[:20] + [prose(40) + " " + s for s in SECRETS if s] * 2
    texts += [None, "", " \t", "one two", "é ñ ü " * 400, "<|endoftext|> and more", prose(15_000), "ab" * 9_000] + [base[3]] * 40
    texts += ["### $$$ %%% " * 30] * 12
    return [(i, t, "en", None if i % 11 == 0 else f"src{i % 4}", None if t is None else len(t), f"s{i}", i % 3, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, shard int, score double")
    docs.repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int("###" not in (r[1] or "###")), 0) for i, r in enumerate(rows)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    html = ["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\ny\nWARC/1.1\r\n", "é" * 50_000] + [prose(R.choice([5, 300])) for _ in range(30)]
    pages = [(i, f"http://h/{i} x" if i % 5 else None, html[i % len(html)] if i < 60 else "<p>hot</p>", "k") for i in R.sample(range(200), 200)]
    spark.createDataFrame(pages, "page_id long, url string, html string, uid string").repartition(3).write.parquet(f"{path}/pages.parquet")
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 24)) + rng.normal(size=(6, 24))[rng.integers(0, 6, 900)]
    v[250:550] = v[250]
    vectors = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    big = [(900 + i, [s] + [t] + [0.0] * 22, 1) for i, (s, t) in enumerate([(1e200, 0.0), (1e200, 1e200), (1e-200, 0.0), (-1e300, 1e299), (1e308, 1e308)])]
    odd = [(950, None, 1), (1000, [0.0] * 24, 1), (1050, [float("nan")] * 24, 1), (1100, [1.0, None] + [0.0] * 22, 1), (1150, [float("inf")] * 24, 1)]
    spark.createDataFrame(vectors + big + odd, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def found(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_targets(sizes, sources):
    per = Counter()
    for n, s in zip(sizes, sources):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = sum(per.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * per[s]]
        if not over:
            return per, target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * per[s]
            left -= 3 * per[s]
            free.remove(s)
    return per, target


def words(text):
    return len((text or "").replace("\x0b", " ").encode().split())


def test_op1(spark, folder, rows):
    out = found(spark, folder, "op1_mixing")
    assert len(out) == len(rows)
    per, target = plain_targets([words(r[1]) for r in rows], [r[3] for r in rows])
    taken, longest = Counter(), Counter()
    for r in out:
        text, source = rows[r.doc_id][1], rows[r.doc_id][3]
        assert r["size"] == words(text) and r.source_size == per[source] and abs(r.target - target[source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source] += r.taken
        longest[source] = max(longest[source], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in per)
    assert sorted(map(tuple, out)) == sorted(map(tuple, found(spark, folder, "op1_mixing")))


def test_op2(spark, folder, rows):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = found(spark, folder, "op2_token_counts")
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        assert r.n_tokens == len(encoder.encode_ordinary(text)) == sum(r.section_tokens)
        assert r.n_sections == len(r.section_tokens) == max(1, text.count("\n") + 1)


def test_op3(spark, folder):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first = {}
    for i, data in pages.items():
        first[data] = min(i, first.get(data, i))
    out = found(spark, folder, "op3_warc")
    assert len(out) == len(pages) == 200
    for r in out:
        data = pages[r.page_id]
        again = first[data] != r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", first[data]) if again else ("response", None))


def test_op4(spark, folder, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    whole.no_truncation(), whole.no_padding()
    out = found(spark, folder, "op4_bpe")
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        ids = whole.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(whole.decode(ids, skip_special_tokens=False)))
        assert (r.joins > 0) == (len(text) > 2048)


def test_op5(spark, folder, rows):
    out = found(spark, folder, "op5_quality")
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    by_text = {}
    for r in out:
        assert by_text.setdefault(rows[r.doc_id][1] or "", r.score) == r.score


def test_op6(spark, folder, rows):
    want = plain_components([(r[0], r[1]) for r in rows], 3, 85)
    out = found(spark, folder, "op6_near_dup")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_op7(spark, folder, rows):
    out = {r.doc_id: r for r in found(spark, folder, "op7_fingerprints")}
    assert len(out) == len(rows)
    prints = lambda t: plain_fingerprint(t) or ({t} if t else set())
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for i, row in enumerate(rows):
        text, after = row[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), digest(edited))
        assert abs(r.near_edited - like(prints(text), prints(edited))) < 1e-12 and abs(r.near_next - like(prints(text), prints(after))) < 1e-12
        assert len(r.fingerprint.split()) == len(prints(text)) and len(r.edited_fingerprint.split()) == len(prints(edited))


def test_op8(spark, folder, rows):
    out = found(spark, folder, "op8_sharding")
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    slots = {}
    for r in out:
        data = (rows[r.doc_id][1] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    assert max(map(len, slots.values())) - min(len(slots.get(s, ())) for s in range(40)) <= 1
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in found(spark, folder, "op8_sharding")}


def test_op9(spark, folder, rows):
    out = found(spark, folder, "op9_secrets")
    assert len(out) == len(rows)
    for r in out:
        want = plain_spans(rows[r.doc_id][1])
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == digest(text)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[3] == kind for s in want) for kind in ("assign", "access", "hex"))
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_op10(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    good = sorted((r.vec_id, r.embedding) for r in table if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding))
    ids = np.array([i for i, _ in good])
    v = np.array([x for _, x in good])
    v = v / np.abs(v).max(1, keepdims=True)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for r in sorted(found(spark, folder, "op10_neighbours"), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(out) == [i for i in ids if i % 50 == 0] and 900 in out and 950 not in out
    hit = 0
    for q, got in out.items():
        s = np.round(u @ u[np.flatnonzero(ids == q)[0]], 12)
        best = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:5]
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(s[np.flatnonzero(ids == i)[0]] - score) < 1e-9 for _, i, score in got)
        hit += len({ids[i] for i in best} & {i for _, i, _ in got})
    assert hit >= 0.9 * 5 * len(out)
    assert {i for _, i, _ in out[900]} >= {901, 902, 904}


def test_spread_equal_rows(spark):
    """Rows that are equal as a whole don't meet in one bucket."""
    from ctxloom.llm import sharding

    df = spark.createDataFrame([(1, "same " * 20)] * 4000 + [(i, prose(20)) for i in range(2, 800)], "doc_id long, text string").repartition(6)
    out = sharding.shard(df, 7, bucket_bytes=40_000).collect()
    assert Counter(r.shard for r in out).keys() == set(range(7)) and len(out) == 4798
    # Scattered, the equal rows stand among the others in every shard.
    share = [sum(r.doc_id == 1 for r in out if r.shard == s) / sum(r.shard == s for r in out) for s in range(7)]
    assert all(0.7 < x < 0.95 for x in share)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, prose(30), "x")] * 500 + [(i, "### $$$ " * 9, "x") for i in range(2, 40)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i == 1), 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality.fit
    quality.fit = lambda chunks, row, label, **more: seen.append(len(label)) or fit(chunks, row, label, **more)
    try:
        assert quality.classify(docs, labels, rows=20).count() == 538
    finally:
        quality.fit = fit
    assert seen[0] <= 20


def test_pipeline_stages(spark, folder, rows):
    """Each stage on what the one before kept, against a plain version; and run() as a whole."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    quality_stage, dedup, scan, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")

    one = quality_stage(spark, docs, folder).cache()
    scores = {r.doc_id: r.predicted for r in queries.quality.classify(docs.drop("score"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert Counter(r.doc_id for r in one.collect()) == Counter(i for i, p in scores.items() if p) and one.columns == docs.columns
    assert all(r.score == 0.5 and r.spans == f"s{rows[r.doc_id][0]}" for r in one.collect() if r.doc_id is not None)

    two = dedup(spark, one, folder).cache()
    have = [(r.doc_id, r.text) for r in one.collect() if r.doc_id is not None]
    keep = {i for i, (_, c) in plain_components(have, 5, 80).items() if i == c} | {None}
    assert {r.doc_id for r in two.collect()} == keep and two.columns == docs.columns

    three = scan(spark, two, folder).cache()
    assert three.columns == docs.columns and three.count() == two.count()
    before = {r.doc_id: r for r in two.collect()}
    for r in three.collect():
        old = before[r.doc_id]
        spans = [] if old.text is None else [s for s in secrets.scan(two.where(F.col("doc_id").eqNullSafe(r.doc_id)), to="f").first().f] if plain_spans(old.text) else []
        if not spans:
            assert r == old or not plain_spans(old.text)
            continue
        text, at = "", 0
        for s in spans:
            if s.start >= at:
                text += old.text[at : s.start] + secrets.MASK
            at = max(at, s.end)
        assert r.text == text + old.text[at:] and r.n_chars == len(r.text)

    four = mix(spark, three, folder).cache()
    copies = Counter({(r.doc_id): r.copies for r in mixing.mix(three).collect()})
    assert Counter(r.doc_id for r in four.collect()) == +copies and four.columns == docs.columns

    five = encode(spark, four, folder).collect()
    whole = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    got = Counter((r.doc_id, tuple(r.ids)) for r in five)
    assert got == Counter((r.doc_id, tuple(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in four.collect())
    assert all(r.n_tokens == len(r.ids) for r in five)

    plain_docs = spark.read.parquet(f"{folder}/documents.parquet")
    state = plain_docs
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, folder).cache()
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id, r.n_tokens) for r in state.collect())
    assert key(docs.first()) is not None


def test_empty_tables(spark, tmp_path):
    """Every query over tables without rows."""
    import corpus_pipeline

    path = str(tmp_path)
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, path).count() == 0, name


def test_ranges_of_ids(spark):
    """Null and repeated ids, and more ranges than one comparison holds."""
    df = spark.createDataFrame([(i * 7, str(i)) for i in range(5000)] + [(70, "b"), (70, "a"), (None, "z"), (None, "y")], "doc_id long, text string")
    kept, fan = fingerprints.ROWS_PER_RANGE, fingerprints.FAN
    fingerprints.ROWS_PER_RANGE, fingerprints.FAN = 40, 8
    try:
        out = fingerprints.with_next(df, id_col="doc_id", cols=["text"], text="text").collect()
    finally:
        fingerprints.ROWS_PER_RANGE, fingerprints.FAN = kept, fan
    line = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect()))
    want = Counter((a[2], b[2]) for a, b in zip(line, line[1:] + line[:1]))
    assert Counter((r.text, r.next_text) for r in out) == want
