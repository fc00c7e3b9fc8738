"""Every operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxloom.llm import bpe, fingerprints, mixing, near_dup, neighbours, quality, secrets, sharding, token_counts, warc

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string"
R = random.Random(4)
VOCAB = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(300)] + ["the", "and", "der", "la"] * 20


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def edit(text, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        words[R.randrange(len(words))] = R.choice(VOCAB)
    return " ".join(words)


def documents():
    base = [prose(R.choice([5, 20, 60, 200])) for _ in range(40)]
    texts = base + [R.choice(base) for _ in range(40)]
    family = prose(150)
    texts += [edit(family, R.choice([0.005, 0.01, 0.02, 0.04, 0.08])) for _ in range(80)]
    for b in base[:20]:
        texts += [edit(b, 0.01), edit(edit(b, 0.01), 0.01), b.upper(), b + " " + R.choice(VOCAB)]
    texts += [None, "", " \n\t", "one", "one two", "ONE  two", "a\x0bb c", prose(20_000), "x" * 30_000, "é" * 900 + " ñandú"] + [family] * 60
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, 2, "mine") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def plain_components(rows, k, percent):
    sets = [(r[0], shingles(r[1], k)) for r in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_all_links(docs, rows, k, percent):
    want = plain_components(rows, k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == want
    assert len({c for _, c in got.values()}) < len(rows) - 100


def test_near_duplicates_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, k=3, percent=85).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 85).items()}


def test_near_duplicates_odd_rows(spark, none):
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (5, None), (6, "A b c d"), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near_dup.near_duplicates(odd).collect())
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 5, 5, True), (False, 6, 3, False), (False, 7, 7, True), (True, 0, None, True)]
    assert near_dup.near_duplicates(none).count() == 0


def plain_spans(text):
    text = text or ""
    out = []
    for n, (kind, pattern, group, least, flags) in enumerate((("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0, 20, 0), ("hex", "[0-9a-f]+", 0, 24, 0))):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


SECRETS = ["token=token:abcdefg", 'API_KEY = "Zq9/abc+def=="', "password: 'x' passwd:=abcdefgh", "ſecret=abcdefgh secret:abc secret:abcdef.", "AKIA" + "A1" * 8, "AKIAAKIA AKIA" + "B" * 15, "f" * 24, "0" * 23 + "g" + "a" * 30, "é😀 apikey:abcdefé token token=" + "a" * 40, "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "", None, "tOkEn\n=abcdef", "token   =   abcdefgh" * 200]


def test_secrets(spark):
    rows = [(i, t, "mine", "k") for i, t in enumerate(SECRETS + ["words " * 50 + s for s in SECRETS if s] + SECRETS[:3] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, is_assign string").repartition(4)
    found = secrets.scan(df, to="found").collect()
    kinds = {r.kind for r in secrets.RULES if r.base}
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.found if s.kind in kinds] == plain_spans(r.text), r.text
    assert {s.kind for r in found for s in r.found} >= {"github", "pem"}
    clean = {r.doc_id: r.text for r in secrets.redact(secrets.scan(df, to="found"), spans="found").collect()}
    assert clean[0] == SECRETS[0] and clean[1] == '[SECRET]"'
    assert clean[12] is None and clean[11] == ""
    assert all(not secrets_left for secrets_left in (plain_spans(t) for t in clean.values() if t and "[SECRET]" in t and t.count("AKIA") == 0))
    assert secrets.scan(df.limit(0)).count() == 0


def test_trigram_queries_hold():
    for rule in secrets.RULES:
        for text in SECRETS:
            if text and re.search(rule.pattern, text, (re.I if rule.fold else 0) | re.A):
                low = text.lower()
                assert all(any(all(g in low for g in part) for part in group) for group in secrets.trigram_query(rule))
    assert secrets.trigram_query(next(r for r in secrets.RULES if r.kind == "hex")) == []


def test_mixing(docs, rows, none):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert all(r["size"] == size[r.doc_id] for r in mixed)
    per = Counter()
    for r in rows:
        per[r[3]] += size[r[0]]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = sum(per.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * per[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3 * per[s]
            left -= 3 * per[s]
            free.remove(s)
    taken, longest = Counter(), max(size.values())
    for r in mixed:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == per[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in order)
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {r.doc_id: r.copies for r in mixed}
    out = mixing.sample(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)
    assert mixing.mix(none).count() == 0


def test_sharding(docs, rows, none, tmp_path):
    out = sharding.write_shards(sharding.shard(docs, 40, bucket_bytes=20_000), str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 40
    place = {r.doc_id: (r.shard, r.slot) for r in out}
    again = sharding.shard(docs.repartition(7), 40, bucket_bytes=20_000).collect()
    assert place == {r.doc_id: (r.shard, r.slot) for r in again}
    assert sum(a < b for a, b in zip([place[i] for i in range(len(rows))], [place[i] for i in range(1, len(rows))])) < 0.7 * len(rows)
    assert sharding.shard(none, 4).count() == 0
    assert {r.shard for r in sharding.shard(docs.limit(3), 40).collect()} <= set(range(40))


def test_token_counts(docs, rows, spark, none):
    path = str(P.path("byte_bpe_50k.tiktoken"))
    df = docs.withColumn("lines", token_counts.lines(F.concat_ws("\n\n", F.col("text"), F.lit("é b\nc"), F.col("source")))).withColumn("text", F.concat_ws("\n\n", F.col("text"), F.lit("é b\nc"), F.col("source")))
    encoder, size = token_counts._encoder(path, P.PATTERN)
    for r in token_counts.count_tokens(df, path, P.PATTERN, sections="lines").collect():
        ids = encoder.encode_ordinary(r.text)
        parts = re.split("(?<=\n)", r.text)
        ends = np.cumsum([len(p.encode()) for p in parts])
        want, at = [0] * len(parts), 0
        for i in ids:
            held = Counter()
            for b in range(at, at + size[i]):
                held[int(np.searchsorted(ends, b, side="right"))] += 1
            at += size[i]
            want[max(sorted(held), key=lambda s: held[s])] += 1
        assert r.section_tokens == want and r.n_tokens == len(ids) == sum(want)
    odd = spark.createDataFrame([(1, None, None), (2, "", []), (3, "ab", None)], "doc_id long, text string, lines array<int>")
    assert [r.n_tokens for r in token_counts.count_tokens(odd, path, P.PATTERN, sections="lines").orderBy("doc_id").collect()] == [0, 0, 1]
    assert list(token_counts.allot(np.array([2, 3]), np.array([1, 3, 5]), "start")[0]) == [1, 1, 0]


ALPHABET = ["abcdefgh", "the", "ing", "'s", "'re", "'", "!!!", "12", "é", "Éß", "日本", "́", "İ", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "-", "tion", " ", " ", "'v", "l", "ſ", "ǰ", "J̌", "\n", "</w>", "\u3000", "e\u0301", "123"]


def test_bpe_is_exact(spark, none):
    from tokenizers import Tokenizer

    path = str(P.path("word_bpe_49k.json"))
    whole = Tokenizer.from_file(path)
    texts = ["".join(R.choice(ALPHABET) for _ in range(n)) for n in [3] * 40 + [300] * 30 + [3000] * 6] + ["a" * 5000, "'s" * 2000, "日本語" * 1000, "thing" * 2000, "", None]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == whole.decode(ids, skip_special_tokens=False)
    for leaf, window in ((4, 1), (7, 2), (64, 8)):
        ids, joins = bpe.Codec(path, long=8, leaf=leaf, window=window).encode([t or "" for t in texts])
        assert [i.tolist() for i in ids] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert sum(j > 0 for j in joins) > 30
    assert bpe.encode(none, path).count() == 0


def test_quality_learns_and_holds_out(spark, none):
    good = [prose(80) for _ in range(300)]
    bad = [prose(80).replace(" ", " | ") if i % 2 else "### $$$ %%% " * 40 for i in range(100)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (901, "", "y"), (None, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(400)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).withColumn("held_out", quality.held_out("doc_id")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    right = [(r.predicted == 1) == (r.doc_id < 300) for r in out if r.held_out and r.doc_id < 400]
    assert np.mean(right) > 0.9
    assert quality.classify(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert quality.classify(none, labels).count() == 0


def test_classifier_sees_the_whole_text():
    rng = np.random.default_rng(0)
    net = quality.Network(rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)), np.zeros(quality.FILTERS), rng.normal(size=2 * quality.FILTERS + 2), 0.0)
    pairs = net.pairs()
    for n in (0, 1, 5, 6, 511, 512, 513, 767, 768, 769, 70_000):
        text = rng.integers(32, 127, n).astype(np.uint8).tobytes()
        data = quality._padded(text)
        starts = quality.chunk_starts(len(data))
        act = quality._activations(data, pairs)
        want = np.mean([np.maximum(act[s : min(s + quality.CHUNK, len(data)) - quality.WIDTH + 1].max(0), 0) for s in starts], 0)
        assert np.allclose(quality.features(text, pairs, net.bias), want, atol=1e-4), n
        covered = np.zeros(len(data), bool)
        for s in starts:
            covered[s : s + quality.CHUNK] = True
        assert covered.all()


def plain_fingerprint(text):
    words = re.findall(r"[^\W_]+", text.lower())
    anchors, out = set(fingerprints.ANCHORS), set()
    for i, w in enumerate(words[:-1]):
        if w in anchors and words[i + 1] not in anchors:
            chain, j = [], i + 1
            while j < len(words) and len(chain) < fingerprints.CHAIN:
                if words[j] not in anchors:
                    chain.append(words[j])
                j += 1
            if len(chain) == fingerprints.CHAIN:
                out.add((w, *chain))
    return out


def test_fingerprints(docs, rows, none):
    got = {r.doc_id: r for r in docs.select("doc_id", "text", F.array_distinct(fingerprints.chains(F.coalesce("text", F.lit("")))).alias("c"), fingerprints.fingerprint(F.col("text")).alias("fp")).collect()}
    for r in got.values():
        text = r.text or ""
        want = plain_fingerprint(text)
        # Between two content words a chain passes over the run of common words, of which the last is marked.
        assert {tuple(c[0:].lstrip("#").split(" ")) for c in r.c} == want, text[:80]
        assert len(r.fp) == (len(want) or int(bool(text)))
    nexts = fingerprints.with_next(docs, id_col="doc_id", cols=["text"], text="text").collect()
    ordered = sorted(rows)
    want = {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    assert {r.doc_id: r.next_text for r in nexts} == want
    assert fingerprints.with_next(none, id_col="doc_id", cols=["text"], text="text").count() == 0


def test_next_over_many_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 9)
    monkeypatch.setattr(fingerprints, "FAN", 4)
    nexts = fingerprints.with_next(docs, id_col="doc_id", cols=["text"], text="text").collect()
    ordered = sorted(rows)
    assert {r.doc_id: r.next_text for r in nexts} == {a[0]: b[1] for a, b in zip(ordered, ordered[1:] + ordered[:1])}


def test_edited_text(spark):
    df = spark.createDataFrame([("abcde", "xyz"), ("ab", ""), ("", "x"), ("😀éab", "q")], "a string, b string")
    assert [r[0] for r in df.select(fingerprints.edited_text(F.col("a"), F.col("b"))).collect()] == ["abcxy", "a", "", "😀éq"]


def test_similar_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.similar(docs, percent=50).collect()}
    fps = {r.doc_id: frozenset(r.fp) for r in docs.select("doc_id", fingerprints.fingerprint(F.col("text")).alias("fp")).collect()}
    rep = {}
    for i in sorted(fps):
        rep.setdefault(fps[i], i)
    for i, fp in fps.items():
        assert got[i].class_id == (rep[fp] if fp else None)
        want = sorted(j for other, j in rep.items() if fp and other and other != fp and 2 * len(fp & other) >= len(fp | other))
        assert got[i].n_links == len(want)


def test_warc(spark):
    pages = [(i, f"http://h/{i % 3}" if i % 4 else None, t) for i, t in enumerate(["<p>a</p>", "", None, "<p>a</p>", "x\r\n\r\ny\nWARC/1.1\r\n", "é" * 5000, "b b", "<p>a</p>"] * 150)]
    pages += [(None, "a b\nc", "<p>a</p>"), (7, "u", "<p>a</p>")]
    out = warc.convert(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()
    assert len(out) == len(pages)
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in out) == Counter((p, len((h or "").encode()), digest(h or "")) for p, _, h in pages)
    by_digest = {digest(t): p for t, p in first.items()}
    assert all(r.refers_to == by_digest[r.payload_digest] if r.record_type == "revisit" else r.refers_to is None for r in out)
    assert Counter(r.page_id for r in out if r.record_type == "response") == Counter(first.values())
    assert warc.convert(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_arc_versions_and_errors():
    name = "f.arc"
    for version in (1, 2):
        data = warc.version_block(version, name) + b"\n" + warc.arc_record(version, name, 4, "http://a b", b"hi\n") + b"\n"
        (record,) = warc.parse_arc(data)
        assert record["url"] == "http://a%20b" and record["block"].endswith(b"hi\n")
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(10, 16))[rng.integers(0, 10, 3000)]
    v[100:1100] = v[100]  # a third are one vector
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(v)] + [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [1.0, None] + [0.0] * 14), (3200, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    u = np.float32(v).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and q not in [i for _, i, _ in found]
        s = u @ u[q]
        s[q] = -9
        s = np.round(s, 12)
        best = sorted(range(3000), key=lambda i: (-s[i], i))[:5]
        hit += len(set(best) & {i for _, i, _ in found})
        assert all(abs(s[i] - score) < 1e-9 for _, i, score in found)
        assert [(-round(x, 12), i) for _, i, x in found] == sorted((-round(x, 12), i) for _, i, x in found)
    assert hit >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert {(r.query_id, r.rank) for r in neighbours.nearest(few, F.col("vec_id") == 0).collect()} == {(0, 1), (0, 2)}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
