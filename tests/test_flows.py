"""The flows as a whole, where SQL alone doesn't show their branches."""

import pytest
from pyspark.sql import functions as F

from ctxloom.config import Config
from ctxloom.functions import render, vector
from ctxloom.operators import extraction, flow, memory, messages, results, threads
from ctxloom.operators.messages import BLOCK
from ctxloom.sources.tables import Log

FACTS = "user_id string, id long, value string, category string, confidence double, embedding array<float>"


def block(kind, **more):
    return tuple({"type": kind, **more}.get(f) for f in ("type", "text", "id", "tool_use_id", "name", "content"))


def say(text):
    return [block("text", text=text)]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(1, 0, "system", say("be brief and kind"))]
    rows += [(1, t, "user" if t % 2 else "assistant", say(f"message number {t} about topic{t % 7} and the database")) for t in range(1, 60)]
    rows += [(1, 60, "assistant", [block("text", text="looking at topic3"), block("tool_use", id="a", name="exec")]), (1, 61, "user", [block("tool_result", tool_use_id="a", content="topic3 topic3 database")]), (1, 62, "assistant", say("here is topic3 in the database"))]
    rows += [(1, t, "user", say(f"closing words {t} topic3")) for t in range(63, 66)]
    rows += [(2, 0, "user", say("short one")), (2, 1, "assistant", [block("tool_use", id="bad id!", name="x")])]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{BLOCK}>")


@pytest.mark.parametrize("rerank", [False, True])
def test_selection_keeps_chains_whole(talk, rerank):
    config = Config(top_k=4, recent_n=2, min_score=0.05, rerank=rerank)
    out = flow.select_messages(talk, config, "topic3 database").collect()
    kept = {(r.conv_id, r.turn): r for r in out}
    assert {t for c, t in kept if c == 2} == {0}  # the invalid block went
    assert kept[1, 0].keep == "system" and kept[1, 64].keep == kept[1, 65].keep == "recent"
    chain = [t for t in (60, 61, 62) if (1, t) in kept]
    assert chain in ([], [60, 61, 62])
    groups = {r.group_id for r in out if r.keep == "relevant"}
    assert len(groups) == 4
    assert all(0.05 <= r.score for r in out if r.keep == "relevant" and not rerank)


def test_window_of_a_model_sets_k(talk):
    few = flow.select_messages(talk, Config(min_top_k=1, max_top_k=2, recent_n=1, min_score=0.0), "x", window=100_000, whole_chains=False).where("keep = 'relevant'").count()
    assert few == 2


def answers(prompt):
    who = F.regexp_extract(prompt, r"USER: (\w+)", 1)
    return F.concat(F.lit('{"facts":[{"fact":"likes '), who, F.lit('","category":"preference","confidence":'), F.when(who == "tea", "0.9").otherwise("0.2"), F.lit("}]}"))


def chat(spark, words):
    return spark.createDataFrame([(i, 0, "user", f"{w} is what I like most", "u1") for i, w in enumerate(words)], "conv_id long, turn long, role string, text string, user_id string")


def test_flush_twice_stores_once(spark):
    none = spark.createDataFrame([], FACTS)
    batch = chat(spark, ["tea", "tea", "rum"])
    one = flow.flush(batch, none, answers)
    assert one.counters().first().asDict() == {"extracted": 2, "stored": 1, "updated": 0, "skipped": 1, "not_stored": 0, "embeddings_stored": 1}
    again = flow.flush(batch, one.facts, answers)
    assert [r.value for r in again.facts.collect()] == ["likes tea"]
    assert {r.outcome for r in again.outcomes.collect()} == {"kept", "skipped"}


def test_flush_stream(spark, tmp_path):
    source, log = str(tmp_path / "in"), Log(spark, str(tmp_path / "facts"), FACTS)
    chat(spark, ["tea", "rum"]).write.parquet(source)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string, user_id string").parquet(source)
    flow.flush_stream(stream, log, answers, checkpoint=str(tmp_path / "check"), once=True).awaitTermination(120)
    assert [r.value for r in log.read().collect()] == ["likes tea"]


def test_storage_modes(spark):
    batch = chat(spark, ["tea"])
    assert [flow.extract(batch, answers, Config(storage_mode=m))[0].count() for m in ("facts", "semantic", "hybrid")] == [1, 0, 1]


def test_summaries_merge(spark):
    schema = "user_id string, id long, topic string, content string, entities array<string>, projects array<string>, source_messages int, updated_at timestamp, embedding array<double>"
    at = lambda n: __import__("datetime").datetime(2024, 1, n)
    old = spark.createDataFrame([("u", 1, "a", "one", ["x"], None, 2, at(1), [1.0, 0.0]), ("u", 2, "b", "two", [], [], 1, at(2), [0.0, 1.0])], schema)
    new = spark.createDataFrame([("u", 3, "a", "one", ["y", "x"], ["p"], 1, at(3), None), ("u", 4, "z", "more", None, None, 1, at(4), [0.1, 1.0]), ("u", 5, "q", "own", [], [], 1, at(5), [-1.0, -1.0]), ("u", 6, "q", "again", [], [], 1, at(6), None), ("v", 7, "a", "other user", [], [], 1, at(7), [1.0, 0.0])], schema)
    got = {(r.user_id, r.topic): r for r in flow.merge_summaries(new, old).collect()}
    assert got["u", "a"].content == "one" and got["u", "a"].entities == ["x", "y"] and got["u", "a"].source_messages == 3
    assert got["u", "b"].content == "two\n\nUpdate: more" and got["u", "q"].content == "own\n\nUpdate: again"
    assert len(got) == 4 and got["v", "a"].id == 7
    assert max(len(r.content) for r in flow.merge_summaries(new.withColumn("content", F.repeat("content", 400)), old, cap=50).where("id < 3").collect()) <= 50


def test_history_is_transformed_once(spark):
    big = "line of output\n" * 900
    rows = [(0, "user", [block("tool_result", tool_use_id="t", name="exec", content=big), block("text", text="ok")]), (1, "assistant", [block("tool_result", tool_use_id="t", content=big)]), (2, "user", [block("tool_result", tool_use_id="t", content="small")]), (3, "user", None)]
    df = spark.createDataFrame(rows, f"turn long, role string, content array<{BLOCK}>")
    once = results.shown_history(df, clock=F.lit("now"))
    got = {r.turn: r for r in once.collect()}
    assert got[0].results_stored == 1 and got[0].tokens_saved > 2500 and got[0].content[0].content.startswith("[STORED: tr_") and "lines omitted" in got[0].content[0].content
    assert got[1].content[0].content == big and got[2].results_stored == 0
    twice = results.shown_history(once.drop("results_stored", "tokens_saved"), clock=F.lit("later"))
    assert {r.turn: r.content for r in twice.collect()} == {t: r.content for t, r in got.items()}


def test_patient_embedder():
    calls = []

    def model(batch):
        calls.append(len(batch))
        if len(batch) > 1 or batch[0] == "bad":
            raise RuntimeError("no")
        return [[1.0]]

    assert vector.patient(model, tries=2, wait_s=0)(["a", "bad", "c"]) == [[1.0], None, [1.0]]
    assert calls == [3, 3, 1, 1, 1, 1]


def test_interactions_are_appended(spark, tmp_path):
    from datetime import datetime

    rows = memory.touches(spark.createDataFrame([(1,), (2,)], "id long"), datetime(2024, 2, 1))
    path = str(tmp_path / "log")
    memory.append_interactions(rows, path), memory.append_interactions(rows, path)
    assert spark.read.parquet(path).groupBy("fact_id").count().collect().__len__() == 2 and spark.read.parquet(path).count() == 4


def test_small_things(spark):
    assert spark.range(1).select(render.tool_error(F.lit("no"), F.lit("try")), render.grouped(F.lit(1234567))).first()[:] == ("❌ no\n💡 try", "1,234,567")
    assert spark.range(1).select(vector.pair_similarity(F.lit("same words here"), F.lit("same words here"))).first()[0] == pytest.approx(1)
    t = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, None)], "conv_id long, turn long, thread_id long")
    assert threads.thread_sizes(t).first()[:] == (1, 2, 1.5)
    f = spark.createDataFrame([("u", 1, "c", "abc", 0.5, None)], "user_id string, id long, category string, value string, confidence double, embedding array<float>")
    n = spark.createDataFrame([("u", 9, "c", "abc def", 0.4, None), ("u", 8, "d", "abc", 0.4, None), ("w", 7, "c", "abc", 0.4, None)], f.schema)
    assert [(r.id, r.old_id) for r in extraction.batch_conflicts(n, f).collect()] == [(9, 1)]
    assert memory.format_results(spark.createDataFrame([], "source string, id long, category string, text string, score double, topic string, entities array<string>")).first()[0] == ""
    whole = spark.createDataFrame([(1, "toolResult", say("out"), "k"), (2, "user", say("no"), None), (3, "user", [block("toolResult", id="z")], None)], f"turn long, role string, content array<{BLOCK}>, call string")
    assert [tuple(r) for r in messages.tool_results(whole, keys=["turn"], call_id="call").orderBy("turn").collect()] == [(1, "k", "out"), (3, "z", "")]
