"""Small literal tables for what the test tables don't hold, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxloom.operators.messages import BLOCK

_FIELDS = ("type", "text", "id", "tool_use_id", "name", "content")


def _b(type_: str, **more) -> tuple:
    return tuple({"type": type_, **more}.get(f) for f in _FIELDS)


def _use(i, name="exec"):
    return _b("tool_use", id=i, name=name)


def _result(i, content="ok"):
    return _b("tool_result", tool_use_id=i, content=content)


def _say(text):
    return _b("text", text=text)


#: conv_id, turn, role, content. 1: chain, answer. 2: two calls, one unanswered. 3: a result without a call. 4: invalid blocks. 5: nothing valid, no role.
MESSAGES = [
    (1, 0, "system", [_say("be brief")]),
    (1, 1, "user", [_say("list the files please")]),
    (1, 2, "assistant", [_say("looking"), _use("a-1")]),
    (1, 3, "tool", [_result("a-1", "x" * 700)]),
    (1, 4, "assistant", [_say("there are two files")]),
    (1, 5, "user", [_say("thanks a lot")]),
    (2, 0, "assistant", [_use("b1"), _use("b2")]),
    (2, 1, "tool", [_result("b1")]),
    (2, 2, "user", [_say("what about the other one")]),
    (2, 3, "tool", [_result("b2")]),
    (2, 4, "assistant", [_use("b3")]),
    (2, 5, "assistant", [_use("b4")]),
    (2, 6, "tool", [_result("b4", "")]),
    (3, 0, "tool", [_result("zz")]),
    (3, 1, "assistant", [_say("odd"), _say("two lines")]),
    (4, 0, "assistant", [_use("bad id!"), _say("kept")]),
    (4, 1, "assistant", [_use("c1", None), _use("c2", "")]),
    (4, 2, "tool", [_result("c 1"), _result("c1", None), _result("c2")]),
    (5, 0, None, [_say("no role")]),
    (5, 1, "user", [_use(None)]),
]
#: id, response of an extraction.
RESPONSES = [
    (1, '{"facts":[{"fact":"likes tea","category":"preference","confidence":0.9,"source_context":"said so"}],"summary":{"topic":"tea","content":"about tea","entities":["cup"],"projects":"kitchen"}}'),
    (2, '```json\n{"facts":[{"fact":"uses vim","category":"Tools","confidence":"0.8"}],"summary":null}\n```'),
    (3, 'Here you are: [{"fact":"bare","category":"goal","confidence":7}]'),
    (4, '{"facts":[{"fact":"one","category":"bug","confidence":0.5,"source_context":"c"},{"fact":"two","category":"x","confidence":0.25,"source_con'),
    (5, "nothing at all"),
    (6, None),
    (7, "```json\n" + '{"facts":[{"fact":"' + "l" * 210 + '","category":"decision","confidence":-1}]}'),
    (8, '{"facts":[{"fact":"","category":"decision","confidence":1},{"category":"project"}],"summary":{"topic":"t","content":""}}'),
]
#: user, id, key, scope, agent, session, category, value, confidence, minutes since the start.
FACTS = [
    ("u1", 1, "editor", "user", None, None, "preference", "prefers vim for editing", 0.9, 1),
    ("u1", 2, "editor", "user", None, None, "preference", "prefers emacs for editing", 0.6, 5),
    ("u1", 3, None, "user", None, None, "project", "builds a search engine", 0.8, 2),
    ("u1", 4, None, "user", None, None, "project", "builds a search engine in spark", 0.7, 3),
    ("u1", 5, "db", "agent", "a1", None, "system", "database is postgres", 0.7, 4),
    ("u1", 6, "db", "agent", "a2", None, "system", "database is sqlite", 0.7, 6),
    ("u1", 7, "", "session", "a1", "s1", None, "session note about the search", 0.5, 7),
    ("u1", 8, "", "session", "a1", "s2", "workflow", "another session note", 0.4, 8),
    ("u2", 9, "editor", "user", None, None, "preference", "prefers nano for editing", 0.9, 9),
]


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join("{" + ", ".join(f"'{f}': {_sql(x)}::VARCHAR" for f, x in zip(_FIELDS, b)) + "}" for b in v) + "]"
    return str(v)


def values(rows: list[tuple], columns: str) -> str:
    """(VALUES ...) AS t(columns)."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + f") AS t({columns})"


def messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MESSAGES, f"conv_id long, turn long, role string, content array<{BLOCK}>")


def responses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESPONSES, "id long, response string")


def facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "user_id string, id long, key string, scope string, agent_id string, session_id string, category string, value string, confidence double, minute int").selectExpr("*", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute) AS updated_at").selectExpr("*", "updated_at AS created_at", "updated_at AS last_accessed_at", "sha2(value, 256) AS content_hash")


MESSAGES_SQL = values(MESSAGES, "conv_id, turn, role, content")
RESPONSES_SQL = values(RESPONSES, "id, response")
FACTS_SQL = values(FACTS, "user_id, id, key, scope, agent_id, session_id, category, value, confidence, minute")
