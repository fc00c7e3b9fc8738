"""Operators that SQL can't express, against plain versions, and their edges."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom import config
from ctxloom.errors import MemoryError_, check_scope, require
from ctxloom.functions import extraction, previews, text, vector
from ctxloom.operators import fusion, lexical, memory, messages, results, select, threads
from ctxloom.operators import extraction as extract
from ctxloom.plans import fixtures
from ctxloom.sources import tables
from ctxloom.streaming import triggers

QUICK = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def plain_chunks(t, size, overlap, marks):
    out, at = [], 0
    while t:
        cut = t[at : at + size]
        if at + size < len(t):
            best = max(cut.rfind(m) for m in marks)
            if best > size // 2:
                cut = cut[: best + 1]
        out.append((at, at + len(cut)))
        if at + len(cut) >= len(t):
            return out
        at += len(cut) - overlap
    return out


def test_bounded_chunks(spark):
    r = random.Random(1)
    texts = ["", None, "a", "x" * 199, "x" * 200, "x" * 201, "y" * 2000, "y" * 2001, "a. " * 1500, ("b" * 700 + "\n\n") * 9, "z" * 6000, "é. " * 3000]
    texts += ["".join(r.choice("abc .\n") for _ in range(r.randint(0, 9000))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for row in results.bounded_chunks(df, keys=["id"]).orderBy("id", "chunk_idx").collect():
        got.setdefault(row.id, []).append((row.start_offset, row.end_offset))
        assert row.chunk_text == texts[row.id][row.start_offset : row.end_offset]
    for i, t in enumerate(texts):
        assert got.get(i, []) == plain_chunks(t or "", 2000, 200, [". ", "\n\n"]), i


def test_chunk_overlap_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(MemoryError_):
        results.bounded_chunks(df, keys=["id"], size=100, overlap=50)
    with pytest.raises(MemoryError_):
        results.fixed_chunks(F.col("text"), 10, 10)


def plain_exec(t, tokens=400):
    most, lines = 4 * tokens, t.split("\n")
    head, used = 0, 0
    for x in lines:
        if used + len(x) > int(most * 0.6):
            break
        used += len(x) + 1
        head += 1
    tail, used = 0, 0
    for x in reversed(lines[head:]):
        if used + len(x) > int(most * 0.4):
            break
        used += len(x) + 1
        tail += 1
    left = len(lines) - head - tail
    if left <= 0:
        return t[:most]
    first = "".join(x + "\n" for x in lines[:head])
    return f"{first}\n... [{left} lines omitted] ...\n\n" + "".join(x + "\n" for x in (lines[-tail:] if tail else []))


def test_exec_preview(spark):
    r = random.Random(2)
    texts = ["", "one", "a\n" * 3000, "x" * 5000, "\n".join("l" * r.randint(0, 90) for _ in range(300)), "y" * 2000 + "\nend", "end\n" + "y" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for row in df.select("id", previews.exec_preview(F.col("t")).alias("p")).collect():
        assert row.p == plain_exec(texts[row.id]), row.id


def test_threads_follow_topics(spark):
    a, b = "alpha beta gamma delta", "wheel motor brake engine"
    rows = [(1, i, "user", t) for i, t in enumerate([a, a, b, b, b, a, None, "short", a])]
    got = [r.thread_id for r in threads.detect(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()]
    assert got == [0, 0, 1, 1, 1, 0, None, None, 0]
    found = threads.fold([a] + [""] * 6 + [a], [vector.hash_vector(a)] * 8)
    assert [t for t, _ in found] == [0, None, None, None, None, None, None, 1]
    found = threads.fold([a, a, b, a], [vector.hash_vector(x) for x in (a, a, b, a)])
    assert [t for t, _ in found] == [0, 0, 0, 0]  # a message alone joins the thread before
    scored = threads.score_threads(threads.detect(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), vector.hash_vector(a).tolist())
    assert {r.thread_id: round(r.score) for r in scored.collect()} == {0: 1, 1: 0}


def test_thread_ids_follow_time():
    r = random.Random(3)
    vectors = [vector.hash_vector(r.choice(["a b c d alpha beta", "wheel motor", "tea milk sugar"])) for _ in range(60)]
    ids = [t for t, _ in threads.fold(["long enough text"] * 60, vectors)]
    assert all(t is not None for t in ids)
    first = [ids.index(t) for t in sorted(set(ids))]
    assert first == sorted(first)


def test_hash_vectors():
    v = vector.hash_vector("the quick brown fox")
    assert abs(v @ v - 1) < 1e-12 and not vector.hash_vector("a b").any() and not vector.hash_vector(None).any()


@QUICK
@given(st.lists(st.tuples(*[st.lists(st.floats(-10, 10), min_size=3, max_size=3)] * 2), min_size=1, max_size=60))
def test_cosine(spark, pairs):
    d = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    for r in d.select(vector.cosine(F.col("a"), F.col("b")).alias("x"), vector.cosine(F.col("b"), F.col("a")).alias("y")).collect():
        assert -1 - 1e-9 <= r.x <= 1 + 1e-9 and abs(r.x - r.y) < 1e-9


def test_cosine_edges(spark):
    d = spark.createDataFrame([(None, [1.0]), ([1.0, 2.0], [1.0]), ([0.0], [1.0]), ([2.0], [-1.0])], "a array<double>, b array<double>")
    assert [r.v for r in d.select(vector.cosine(F.col("a"), F.col("b")).alias("v")).collect()] == [0.0, 0.0, 0.0, -1.0]


def test_embed_missing(spark):
    t = spark.createDataFrame([("long enough one",), ("long enough one",), ("short",), ("already known text",), (None,)], "text string")
    cache = t.where("text like 'already%'").select(F.sha2("text", 256).alias("content_hash"))
    got = vector.embed_missing(t, cache, lambda b: [vector.hash_vector(x, 8) for x in b], batch=2).collect()
    assert len(got) == 1 and len(got[0].embedding) == 8


def plain_variants(query, count=3):
    """Synonyms, a related term, the query without fillers and its longer words: each once, the query first."""
    low, found = query.lower(), [query]
    for word, others in fusion.SYNONYMS.items():
        if word in low:
            found += [low.replace(word, o, 1) for o in others[:2]]
    found += [f"{low} {others[0]}" for word, others in fusion.RELATED.items() if word in low]
    fillers = {*fusion.QUESTION_WORDS, *fusion.FILLERS}
    found.append(" ".join(w for w in low.split() if w not in fillers) or query)
    found.append(" ".join(w for w in low.split() if len(w) > 3 or w in fusion.SYNONYMS or w in fusion.RELATED) or query)
    return list(dict.fromkeys(found))[: count + 1]


def test_expansion_column_is_the_rule(spark):
    r = random.Random(4)
    words = [*fusion.SYNONYMS, *fusion.FILLERS, *fusion.QUESTION_WORDS, "data", "x", "Testing", "apis"]
    asked = [" ".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(80)]
    e = fusion.Expander()
    for row in spark.createDataFrame([(q,) for q in asked], "q string").select("q", e.column(F.col("q")).alias("v")).collect():
        assert row.v == plain_variants(row.q), row.q


def test_fusion_ignores_the_order_of_lists(spark):
    rows = [(l, i, float((i * 7 + len(l)) % 11)) for l in ("a", "bb", "ccc") for i in range(20)]
    d = spark.createDataFrame(rows, "l string, id long, s double")
    flip = spark.createDataFrame([(l[::-1] + "z", i, s) for l, i, s in reversed(rows)], "l string, id long, s double")
    score = lambda x: {r.id: round(r.rrf, 12) for r in fusion.rrf(x, list_col="l", id_col="id", score="s").collect()}
    assert score(d) == score(flip)


def test_search_and_prefilter(spark):
    d = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, ""), (4, None), (5, "cats and dogs")], "id long, t string")
    q = spark.createDataFrame([(1, "cat cat dog")], "qid long, q string")
    got = lexical.search(d, q, id_col="id", text="t", query_id="qid", query="q", k=5).collect()
    assert {r.id for r in got} == {1, 2} and all(0 <= r.score <= 1 for r in got)
    assert {r.id for r in lexical.prefilter(d, ["cats"], text="t", recent=F.col("id") == 3).collect()} == {3, 5}
    assert lexical.prefilter(d, ["absent"], text="t", recent=F.lit(False)).count() == 5


def test_selection_keeps_system_and_recent(spark):
    rows = [(1, i, "system" if i == 0 else "user", f"message number {i} about tea") for i in range(30)]
    out = select.select_context(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), k=5, recent=3, least=0.0)
    turns = {r.turn for r in out.collect()}
    assert {0, 27, 28, 29} <= turns and len(turns) == 9
    assert select.select_context(spark.createDataFrame(rows[:8], "conv_id long, turn long, role string, text string"), k=5, recent=3).count() == 8


def test_sanitise_twice_is_once(spark):
    first = messages.sanitise(fixtures.messages(spark))
    assert messages.sanitise(first).collect() == first.collect()


def test_upsert_twice_is_once(spark):
    first = memory.upsert_facts(fixtures.facts(spark))
    assert sorted(memory.upsert_facts(first).collect()) == sorted(first.collect())


def test_users_see_their_own(spark):
    f = fixtures.facts(spark)
    seen = memory.retrieve_facts(f, None, user_id="u2", query="editing", least=0.0).collect()
    assert {r.id for r in seen} == {9}
    for bad in ({"user_id": "", "query": "x"}, {"user_id": "u1", "query": None}):
        with pytest.raises(MemoryError_):
            memory.retrieve_facts(f, None, **bad)
    with pytest.raises(MemoryError_):
        check_scope("team")
    with pytest.raises(MemoryError_):
        check_scope("agent")
    require(user_id="u")


def test_summaries_merge_into_the_newest_similar(spark):
    old = spark.createDataFrame([("u", 1, [1.0, 0.0], datetime(2024, 1, 1)), ("u", 2, [0.95, 0.1], datetime(2024, 1, 2)), ("u", 3, [0.0, 1.0], datetime(2024, 1, 3)), ("v", 4, [1.0, 0.0], datetime(2024, 1, 4))], "user_id string, id long, embedding array<double>, updated_at timestamp")
    new = spark.createDataFrame([("u", 9, [1.0, 0.0])], "user_id string, id long, embedding array<double>")
    assert [(r.new_id, r.old_id) for r in memory.same_summary(new, old).collect()] == [(9, 2)]


def test_conflict_strategies(spark):
    for strategy, want in {"keep_latest": ("update", "n", 0.5), "keep_highest_confidence": ("keep", "o", 0.9), "merge": ("update", "o; n", 0.9), "ask_user": ("defer", "o", 0.9), "other": ("keep", "o", 0.9)}.items():
        r = one(spark, extract.resolution(F.lit(strategy), F.lit("o"), F.lit(0.9), F.lit("n"), F.lit(0.5)))
        assert (r.action, r.value, r.confidence) == want
    assert one(spark, extract.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def test_conflict_answers(spark):
    good = '```json\n{"conflicts": true, "reason": "r", "resolution": "merge"}\n```'
    assert one(spark, extraction.parse_conflict(F.lit(good))).resolution == "merge"
    for bad in ("", "{}", '{"conflicts": true}', '{"conflicts": false, "resolution": "x"}'):
        assert one(spark, extraction.parse_conflict(F.lit(bad))) is None


@QUICK
@given(st.lists(st.text(max_size=60), min_size=1, max_size=80))
def test_parsing_never_fails(spark, texts):
    d = spark.createDataFrame([(t.replace("\x00", ""),) for t in texts], "t string")
    assert all(r.n >= 0 for r in d.select(F.size(extraction.valid_facts(extraction.parse(F.col("t"))["facts"])).alias("n")).collect())


def test_retrieve_modes(spark):
    body = "\n".join(f"line {i} {'Hit' if i in (3, 4, 9) else ''}" for i in range(1, 12))
    store = spark.createDataFrame([("tr_1", body)], "result_id string, full_result string")
    assert results.retrieve(store, "tr_1").first().content == body
    assert [r.line for r in results.retrieve(store, "tr_1", "search", query="hit", context_lines=1).orderBy("line").collect()] == [2, 3, 4, 5, 8, 9, 10]
    assert results.retrieve(store, "tr_1", "lines", start_line=2, end_line=3).first().content == "2: line 2 \n3: line 3 Hit"
    assert results.retrieve(store, "tr_1", "lines", start_line=5, end_line=3).first().content == ""
    assert [r.line for r in results.retrieve(store, "tr_1", "around", line=1, context_lines=1).collect()] == [1, 2]
    assert "truncated" in results.retrieve(store, "tr_1", "lines", start_line=1, end_line=11, max_tokens=5).first().content
    for bad in ({"mode": "x"}, {"mode": "search"}, {"mode": "around"}):
        with pytest.raises(MemoryError_):
            results.retrieve(store, "tr_1", **bad)


def test_change_log(spark, tmp_path):
    log = tables.Log(spark, str(tmp_path / "facts"), "id long, value string")
    assert log.read().count() == 0
    log.replace(spark.createDataFrame([(1, "a")], "id long, value string"))
    log.replace(log.read().unionByName(spark.createDataFrame([(2, "b")], "id long, value string")))
    log.replace(log.read().where("id = 2"))
    assert log.versions() == [1, 2, 3] and [r.id for r in log.read().collect()] == [2]
    log.vacuum()
    assert log.versions() == [2, 3]


def test_index_and_logs_on_disk(spark, tmp_path):
    d = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta")], "id long, content string")
    tables.write_index(d, str(tmp_path / "i"), id_col="id", partitions=2)
    assert {(r.id, r.tf) for r in spark.read.parquet(str(tmp_path / "i")).where("term = 'alpha'").collect()} == {(1, 2)}
    tables.route_logs(spark.createDataFrame([("memory", "info", "m"), ("x", "error", "e")], "kind string, level string, m string"), str(tmp_path / "l"))
    assert {r.route for r in spark.read.json(str(tmp_path / "l")).collect()} == {"memory", "error"}


def test_triggers():
    assert [triggers.should_flush(n, w) for n, w in ((4, 0), (5, 0), (1, 29_999), (1, 30_000), (0, 99_999))] == [None, "count", None, "interval", None]


def test_trigger_stream(spark, tmp_path):
    rows = [(1, i, "user", "x") for i in range(12)] + [(2, i, "user", "x") for i in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers ask for batches without end
    q = triggers.extraction_batches(stream).writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r.conv_id, r.n, r.first_turn, r.last_turn, r.reason) for r in spark.sql("SELECT * FROM due").collect())
    assert got == [(1, 5, 0, 4, "count"), (1, 5, 5, 9, "count")]


def test_config():
    assert config.load({}, {}).top_k == 10
    assert config.load({"top_k": 7}, {}, "kimi-2").top_k == 7
    assert config.load({"top_k": 7}, {"CTXLOOM_TOP_K": "9", "CTXLOOM_RERANK": "true"}).rerank is True
    assert config.load({"recent_n": 0}, {}).recent_n == 0
    assert config.load({}, {}, "claude-x").min_score == 0.45
    with pytest.raises(MemoryError_):
        config.load({"bm25_weight": 0.9}, {})
    assert len(config.Config(top_k=0, fusion="x", rrf_k=0).problems()) == 3


def test_text_edges(spark):
    assert one(spark, text.ellipsis(F.lit("a" * 201), 200)) == "a" * 197 + "..."
    assert one(spark, text.keywords(F.lit(None).cast("string"))) == []
    assert one(spark, text.full_within(F.lit("ab\n" * 30), 20)).endswith("ranges]")
    assert one(spark, text.tokens(F.lit("Crème brûlée a_b 42"))) == ["cr", "me", "br", "a_b", "42"]
    assert np.isclose(one(spark, lexical.memory_bm25(F.lit(" tea "), F.lit("tea time"))), 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 50)))
