"""More queries over whole tables, each with the same in SQL: the flows, the store of results, memory with vectors, and what a prompt shows.

Messages with content blocks, facts and summaries are made from rows of the
tables by expressions, in Spark and in SQL alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxloom.config import Config
from ctxloom.functions import extraction, previews, render, text, vector
from ctxloom.operators import extraction as extract
from ctxloom.operators import flow, lexical, memory, messages, results, select, threads
from ctxloom.sources import tables
from ctxloom.sources.tables import table

from .queries import _hashed, _stored_sql, _tok, query

CLOCK = "2024-01-20T00:00:00.000Z"
NL = "chr(10)"
BLANKS = "' ' || chr(10) || chr(9) || chr(13)"


def _block(**more) -> F.Column:
    fields = ("type", "text", "id", "tool_use_id", "name", "content")
    return F.struct(*[more.get(f, F.lit(None)).cast("string").alias(f) for f in fields])


# ---- selection


def _with_tools(spark, sf_dir) -> DataFrame:
    """conversations as messages with blocks: an assistant's message at turns 1, 5, 9 ... calls a tool, and the message after it is the result."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    use = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    call = F.concat(F.lit("c"), F.col("turn").cast("string"))
    before = F.lag(F.when(use, call)).over(w)
    rows = c.select("conv_id", "turn", "role", "text", use.alias("use"), call.alias("call"), before.alias("answers"))
    say = _block(type=F.lit("text"), text=F.col("text"))
    content = F.when(F.col("use"), F.array(say, _block(type=F.lit("tool_use"), id=F.col("call"), name=F.lit("exec")))).when(F.col("answers").isNotNull(), F.array(_block(type=F.lit("tool_result"), tool_use_id=F.col("answers"), content=F.col("text")))).otherwise(F.array(say))
    return rows.select("conv_id", "turn", "role", content.alias("content"))


_CHAINS = """c AS (SELECT *, role = 'assistant' AND turn % 4 = 1 AS use FROM conversations),
l AS (SELECT *, coalesce(lag(use) OVER w, false) AS res, coalesce(lag(use, 2) OVER w, false) AS use2, lag(turn) OVER w AS p1, lag(turn, 2) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, turn, role, CASE WHEN res THEN '[Tool result: ' || substr(text, 1, 500) || '...]' ELSE text END AS t,
  CASE WHEN use THEN turn WHEN res THEN p1 WHEN use2 AND role = 'assistant' THEN p2 ELSE turn END AS gid, use OR res OR (use2 AND role = 'assistant') AS chained,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM l)"""


@query(f"WITH {_CHAINS} SELECT conv_id, turn, gid AS group_id, CASE WHEN chained THEN 'tool-chain' ELSE 'single' END AS kind FROM m")
def tool_chain_table(spark, sf_dir):
    return messages.tool_chains(_with_tools(spark, sf_dir))


_FULL = f"""WITH {_CHAINS},
items AS (SELECT conv_id, gid, string_agg(t, chr(10) ORDER BY turn) AS t, arg_min(role, turn) AS role, arg_min(r, turn) AS r, any_value(n) AS n FROM m GROUP BY ALL),
u AS (SELECT conv_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS t FROM (SELECT * FROM m WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1) GROUP BY conv_id),
docs AS (SELECT conv_id, gid, t FROM items UNION ALL SELECT conv_id, -1, t FROM u),
{_hashed('docs', 'conv_id, gid')},
norms AS (SELECT conv_id, gid, sqrt(sum(w * w)) AS n FROM b GROUP BY ALL),
dots AS (SELECT b.conv_id, b.gid, sum(b.w * z.w) AS d FROM b JOIN b z ON z.conv_id = b.conv_id AND z.gid = -1 AND z.bkt = b.bkt WHERE b.gid >= 0 GROUP BY ALL),
tk AS (SELECT conv_id, gid, {_tok('t')} AS tk FROM items), st AS (SELECT conv_id, count(*) AS n, avg(len(tk)) AS avgdl FROM tk GROUP BY conv_id),
qt AS (SELECT conv_id, term, count(*) AS qtf FROM (SELECT conv_id, unnest({_tok('t')}) AS term FROM u) GROUP BY ALL),
tf AS (SELECT conv_id, gid, length, term, count(*) AS tf FROM (SELECT conv_id, gid, len(tk) AS length, unnest(tk) AS term FROM tk) GROUP BY ALL),
hit AS (SELECT *, count(*) OVER (PARTITION BY conv_id, term) AS df FROM tf JOIN qt USING (conv_id, term)),
bm AS (SELECT conv_id, gid, least(1.0::DOUBLE, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) / 10) AS bm25 FROM hit JOIN st USING (conv_id) GROUP BY ALL),
s AS (SELECT i.*, CASE WHEN i.n <= 3 THEN 'short' WHEN role IN ('system', 'developer') THEN 'system' WHEN r <= 1 THEN 'recent' END AS kept, 0.4::DOUBLE * coalesce(bm25, 0) + 0.6::DOUBLE * coalesce(d / (n1.n * n2.n), 0) AS v
  FROM items i LEFT JOIN bm USING (conv_id, gid) LEFT JOIN dots USING (conv_id, gid) LEFT JOIN norms n1 USING (conv_id, gid) LEFT JOIN norms n2 ON n2.conv_id = i.conv_id AND n2.gid = -1),
sc AS (SELECT *, round(CASE WHEN kept IS NOT NULL THEN 1.0::DOUBLE WHEN length(t) < 10 THEN 0.0::DOUBLE ELSE v END, 6) AS score FROM s),
pl AS (SELECT *, row_number() OVER (PARTITION BY conv_id, (kept IS NULL AND score >= 0) ORDER BY score DESC, gid) AS place FROM sc),
ch AS (SELECT conv_id, gid, coalesce(kept, CASE WHEN score >= 0 AND place <= 2 THEN 'relevant' END) AS keep, score FROM pl)
"""


@query(_FULL + "SELECT m.conv_id, m.turn, m.role, m.gid AS group_id, keep, score FROM m JOIN ch USING (conv_id, gid) WHERE keep IS NOT NULL")
def select_context_full(spark, sf_dir):
    """The whole selection flow: validation, chains, BM25 and cosine, the best items with their chains whole."""
    config = Config(top_k=2, recent_n=1, min_score=0.0)
    return flow.select_messages(_with_tools(spark, sf_dir), config).select("conv_id", "turn", "role", "group_id", "keep", "score")


@query(_FULL + "SELECT keep, round(avg(score), 6) AS mean, round(min(score), 6) AS least, round(max(score), 6) AS most, count(score) AS n FROM ch WHERE keep IS NOT NULL GROUP BY keep")
def rerank_stats(spark, sf_dir):
    """Scores of the chosen items by why they stay."""
    chosen = flow.select_messages(_with_tools(spark, sf_dir), Config(top_k=2, recent_n=1, min_score=0.0))
    return select.score_stats(chosen.select("conv_id", "group_id", "keep", "score").distinct(), by=["keep"])


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS hits, round(100.0::DOUBLE * count(*) FILTER (value > 50) / count(*), 4) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(spark, sf_dir):
    return select.hit_rate(table(spark, sf_dir, "events"), F.col("value") > 50, by=["event_type"])


@query(f"""WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS z FROM conversations), docs AS (SELECT conv_id, turn, 0 AS side, a AS t FROM p UNION ALL SELECT conv_id, turn, 1, z FROM p WHERE z IS NOT NULL),
{_hashed('docs', 'conv_id, turn, side')}, n AS (SELECT conv_id, turn, side, sqrt(sum(w * w)) AS n FROM b GROUP BY ALL),
d AS (SELECT x.conv_id, x.turn, sum(x.w * y.w) AS d FROM b x JOIN b y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.bkt = y.bkt AND x.side = 0 AND y.side = 1 GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(d / (n0.n * n1.n), 0), 6) AS score FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN n n0 ON n0.conv_id = p.conv_id AND n0.turn = p.turn AND n0.side = 0 LEFT JOIN n n1 ON n1.conv_id = p.conv_id AND n1.turn = p.turn AND n1.side = 1 WHERE z IS NOT NULL""")
def pair_similarity(spark, sf_dir):
    """Each message with the next one of its conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("z", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("z is not null")
    return c.select("conv_id", "turn", F.round(vector.pair_similarity(F.col("text"), F.col("z")), 6).alias("score"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d') AS day FROM events")
def iso_dates(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", render.iso(ts).alias("at"), F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd").alias("day"))


@query("SELECT conv_id, count(DISTINCT t) AS threads, round(count(*) / count(DISTINCT t)::DOUBLE, 4) AS avg_size FROM (SELECT conv_id, turn // 3 AS t FROM conversations WHERE role <> 'system') GROUP BY conv_id")
def thread_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return threads.thread_sizes(c.withColumn("thread_id", F.when(F.col("role") != "system", F.floor(F.col("turn") / 3))))


# ---- the store of results

_CUT = lambda size, marks, least: f"CASE WHEN s + {size} < n THEN CASE WHEN greatest({', '.join(marks)}, -1) > {least} THEN s + greatest({', '.join(marks)}, -1) + 1 ELSE s + {size} END ELSE n END"


def _chunk_sql(key: str, source: str, size: int, overlap: int, marks: tuple[str, ...], least: int) -> str:
    """Chunks by recursion; the greedy pattern ends where the last mark begins."""
    last = [f"CASE WHEN contains(substr(t, s + 1, {size}), {sql}) THEN length(regexp_extract(substr(t, s + 1, {size}), '(?s)^(.*){pattern}', 1)) ELSE -1 END" for sql, pattern in marks]
    cut = _CUT(size, last, least)
    return f"""WITH RECURSIVE d AS (SELECT {key} AS k, t, length(t)::BIGINT AS n FROM ({source}) WHERE length(t) > 0),
c AS (SELECT k, t, n, 0::BIGINT AS i, s, ({cut})::BIGINT AS e FROM (SELECT *, 0::BIGINT AS s FROM d)
 UNION ALL SELECT k, t, n, i, s, ({cut})::BIGINT FROM (SELECT k, t, n, i + 1 AS i, e - {overlap} AS s FROM c WHERE e < n))"""


_SENTENCE = (("'. '", "\\. "), ("chr(10) || chr(10)", "\\n\\n"))


@query(_chunk_sql("doc_id", "SELECT doc_id, text AS t FROM documents", 2000, 200, _SENTENCE, 1000) + " SELECT k AS doc_id, i::INT AS chunk_idx, s::INT AS start_offset, e::INT AS end_offset FROM c")
def chunk_boundary(spark, sf_dir):
    c = results.bounded_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), keys=["doc_id"])
    return c.select("doc_id", "chunk_idx", "start_offset", "end_offset")


@query(_chunk_sql("doc_id", "SELECT doc_id, text AS t FROM documents", 8000, 800, (("chr(10)", "\\n"),), 7800) + " SELECT k AS doc_id, i::INT AS chunk_idx, s::INT AS start_offset, e::INT AS end_offset, sha256(substr(t, s + 1, e - s)) AS hash FROM c")
def chunk_newline(spark, sf_dir):
    c = results.bounded_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), keys=["doc_id"], size=8000, overlap=800, marks=("\n",), within=200)
    return c.select("doc_id", "chunk_idx", "start_offset", "end_offset", F.sha2("chunk_text", 256).alias("hash"))


_STORED_CHUNKS = _chunk_sql("'tr_' || sha256(t)[:8]", "SELECT DISTINCT text AS t FROM documents", 2000, 200, _SENTENCE, 1000)


@query(_STORED_CHUNKS + " SELECT k AS result_id, i::INT AS chunk_idx, 'ch_' || sha256(k || ':' || i)[:12] AS chunk_id, ceil((e - s) / 4.0)::BIGINT AS token_count, sha256(substr(t, s + 1, e - s)) AS hash FROM c")
def saved_chunks(spark, sf_dir):
    """Results stored once each, cut and embedded."""
    _, chunks = results.save_with_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), order="doc_id")
    return chunks.where("embedding is not null").select("result_id", "chunk_idx", "chunk_id", "token_count", F.sha2("chunk_text", 256).alias("hash"))


@query(_STORED_CHUNKS + " SELECT i::INT AS chunk_idx, substr(t, s + 1, e - s) AS chunk_text FROM c WHERE k = (SELECT 'tr_' || sha256(text)[:8] FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1)")
def chunks_of_result(spark, sf_dir):
    """The chunks of the longest document, in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    one = d.orderBy(F.desc(F.length("text")), "doc_id").limit(1)
    _, chunks = results.save_with_chunks(one, order="doc_id")
    return results.chunks_of(chunks, one.select(text.result_id(F.col("text"))).first()[0]).select("chunk_idx", "chunk_text")


def _chunk_vectors(spark, sf_dir):
    """Chunks with the vectors of embeddings, their results, and the vector of row 0 as the one query."""
    e = table(spark, sf_dir, "embeddings")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    chunks = e.select(F.col("vec_id").alias("chunk_id"), s("tr_", "label").alias("result_id"), (F.col("vec_id") % 10).cast("int").alias("chunk_idx"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string"), F.lit("\nof more")).alias("chunk_text"), "embedding")
    day = F.timestamp_add("DAY", F.col("label"), F.lit(datetime(2024, 1, 1)))
    stored = e.groupBy("label").agg(F.count("*").alias("n")).select(s("tr_", "label").alias("result_id"), F.when(F.col("label") % 2 == 0, "exec").otherwise("Read").alias("tool_name"), s("s", "label").alias("session_id"), day.alias("created_at"))
    return chunks, stored, e.where("vec_id = 0").first()["embedding"]


def _cos(a: str, z: str) -> str:
    d = lambda x, y: f"list_dot_product({x}::DOUBLE[], {y}::DOUBLE[])"
    return f"({d(a, z)} / (sqrt({d(a, a)}) * sqrt({d(z, z)})))"


_NEAR = f"round({_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 6)"


@query(f"SELECT vec_id AS chunk_id, 'tr_' || label AS result_id, 'exec' AS tool_name, 's' || label AS session_id, {_NEAR} AS score FROM embeddings WHERE label % 2 = 0 AND {_NEAR} >= 0.1 ORDER BY score DESC, chunk_id LIMIT 15")
def chunk_search(spark, sf_dir):
    """The chunks of one tool's results that are most similar, with what is known of those results."""
    chunks, stored, q = _chunk_vectors(spark, sf_dir)
    return results.top_chunks(chunks, q, k=15, least=0.1, results=stored, tool="exec").select("chunk_id", "result_id", "tool_name", "session_id", "score")


@query(f"""WITH f AS (SELECT *, {_NEAR} AS score FROM embeddings WHERE {_NEAR} >= 0.1 ORDER BY score DESC, vec_id LIMIT 5),
b AS (SELECT score, label, vec_id % 10 AS i, '┌─ [' || CASE WHEN label % 2 = 0 THEN 'exec' ELSE 'Read' END || '] ' || strftime(TIMESTAMP '2024-01-01' + to_days(label), '%Y-%m-%d') || ' (relevance: ' || floor(score * 100 + 0.5)::BIGINT || '%)' || {NL} || '│  Result ID: tr_' || label || {NL} || '│  Chunk ' || (vec_id % 10 + 1) || {NL}
 || '├{"─" * 41}' || {NL} || '│  chunk ' || vec_id || {NL} || '│  of more' || {NL} || '└{"─" * 41}' || {NL} || {NL} AS t FROM f)
SELECT '📚 RELEVANT TOOL RESULTS FROM PAST:' || {NL} || {NL} || string_agg(t, '' ORDER BY score DESC, 'tr_' || label, i) AS context FROM b""")
def rag_context(spark, sf_dir):
    chunks, stored, q = _chunk_vectors(spark, sf_dir)
    return results.rag_context(results.top_chunks(chunks, q, k=5, least=0.1, results=stored))


@query(f"WITH n AS (SELECT * FROM embeddings WHERE label % 2 = 0 ORDER BY vec_id DESC LIMIT 100) SELECT vec_id AS id, {_NEAR} AS score FROM n ORDER BY score DESC, id LIMIT 10")
def tool_result_topk(spark, sf_dir):
    """Among the newest 100 results of a tool, the cap of the store."""
    e = table(spark, sf_dir, "embeddings")
    index = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("created_at"), F.when(F.col("label") % 2 == 0, "exec").otherwise("Read").alias("tool_name"), "embedding")
    return results.newest_similar(index, e.where("vec_id = 0").first()["embedding"], k=10, scan=100, tool="exec").select("id", "score")


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN length(substr(text, 1, 5000)) + 16 ELSE length(text) END::BIGINT AS length, sha256(substr(text, 1, 2000)) AS embed_hash FROM documents")
def tool_index(spark, sf_dir):
    rows = tables.tool_index_rows(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.length("result_text").cast("long").alias("length"), F.sha2("embed_text", 256).alias("embed_hash"))


@query("SELECT d.doc_id, e.doc_id AS source FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS doc_id FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) e ON e.h = sha256(d.text)")
def embedding_lookup(spark, sf_dir):
    """Texts with what a cache by their hash has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = d.where("doc_id % 3 = 0").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("embedding"))
    return tables.lookup_embeddings(d, cache).select("doc_id", F.col("embedding").alias("source"))


# ---- what a prompt shows


@query(f"""WITH s AS (SELECT doc_id, text, doc_id % 5 <> 0 AND ceil(length(text) / 4.0)::BIGINT > 2000 AS large, {_stored_sql('text', f"'{CLOCK}'")} AS shown FROM documents)
SELECT doc_id, large::BIGINT AS results_stored, CASE WHEN large THEN ceil(length(text) / 4.0)::BIGINT - ceil(length(shown) / 4.0)::BIGINT ELSE 0 END::BIGINT AS tokens_saved, sha256(CASE WHEN large THEN shown ELSE text END) AS hash FROM s""")
def history_previews(spark, sf_dir):
    """Messages that hold a document as a tool's result, the large ones shown as stored."""
    content = F.array(_block(type=F.lit("text"), text=F.lit("see")), _block(type=F.lit("tool_result"), tool_use_id=F.lit("t1"), content=F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "assistant").otherwise("user").alias("role"), content.alias("content"))
    out = results.shown_history(rows, clock=F.lit(CLOCK))
    return out.select("doc_id", "results_stored", "tokens_saved", F.sha2(F.col("content")[1]["content"], 256).alias("hash"))


def _fit_sql(source: str, head: int, tail: int) -> str:
    """Of texts (id, t): ht(id, n, skip, head, tail), the lines at both ends that fit."""
    return f"""ln AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS x, len(l) AS n FROM (SELECT id, string_split(t, {NL}) AS l FROM {source})),
hs AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY i) AS s FROM ln),
hd AS (SELECT id, any_value(n) AS n, count(*) FILTER (s - 1 <= {head}) AS h FROM hs GROUP BY id),
ts AS (SELECT ln.id, ln.i, ln.x, h, sum(length(x) + 1) OVER (PARTITION BY ln.id ORDER BY i DESC) AS s FROM ln JOIN hd USING (id) WHERE i > h),
tl AS (SELECT id, count(*) FILTER (s - 1 <= {tail}) AS k FROM ts GROUP BY id),
hx AS (SELECT ln.id, string_agg(x || {NL}, '' ORDER BY i) AS head FROM ln JOIN hd USING (id) WHERE i <= h GROUP BY ln.id),
tx AS (SELECT ts.id, string_agg(x || {NL}, '' ORDER BY i) FILTER (s - 1 <= {tail}) AS tail FROM ts GROUP BY ts.id),
ht AS (SELECT hd.id, n, n - h - coalesce(k, 0) AS skip, coalesce(head, '') || {NL} || '... [' || (n - h - coalesce(k, 0)) || ' lines omitted] ...' || {NL} || {NL} || coalesce(tail, '') AS ends FROM hd LEFT JOIN tl USING (id) LEFT JOIN hx USING (id) LEFT JOIN tx USING (id))"""


_ERRORS = "regexp_matches(t, '(?i)error|ERR!|failed|exception{more}')"


@query(f"WITH src AS (SELECT page_id AS id, html AS t FROM pages), {_fit_sql('src', 960, 640)} SELECT id AS page_id, n::BIGINT AS lines, sha256(CASE WHEN skip > 0 THEN ends ELSE substr(t, 1, 1600) END) AS hash, {_ERRORS.format(more='')} AS has_errors FROM src JOIN ht USING (id)")
def preview_exec_head_tail(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", previews.line_count(F.col("html")).alias("lines"), F.sha2(previews.exec_preview(F.col("html")), 256).alias("hash"), previews.has_errors(F.col("html")).alias("has_errors"))


def _kind_sql(t: str) -> str:
    return f"CASE WHEN starts_with({t}, '{{') OR starts_with({t}, '[') THEN 'json' WHEN contains({t}, '<!DOCTYPE') OR contains({t}, '<html') THEN 'html' WHEN contains({t}, 'import ') OR contains({t}, 'export ') THEN 'javascript' WHEN contains({t}, 'def ') THEN 'python' WHEN contains({t}, 'package ') OR contains({t}, 'func ') THEN 'go' ELSE 'text' END"


@query(f"""WITH src AS (SELECT page_id AS id, html AS t FROM pages), {_fit_sql('src', 960, 640)}
SELECT id AS page_id, sha256(CASE id % 4 WHEN 0 THEN {_stored_sql('t', f"'{CLOCK}'", 'exec', f"n || ' lines' || CASE WHEN {_ERRORS.format(more='')} THEN ' | ⚠️ Output may contain errors' ELSE '' END", "CASE WHEN skip > 0 THEN ends ELSE substr(t, 1, 1600) END")}
 WHEN 1 THEN {_stored_sql('t', f"'{CLOCK}'", 'Read', f"n || ' lines | ' || {_kind_sql('t')}")}
 WHEN 2 THEN {_stored_sql('t', f"'{CLOCK}'", 'web_fetch', "coalesce(nullif(substr(regexp_extract(t, '(?m)^#[ \\t]+(.+)$', 1), 1, 60), ''), 'Article/page content')")}
 ELSE {_stored_sql('t', f"'{CLOCK}'", 'process')} END) AS hash FROM src JOIN ht USING (id)""")
def previews_by_tool(spark, sf_dir):
    tool = F.element_at(F.array(*map(F.lit, ("exec", "Read", "web_fetch", "process"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(render.stored_result(tool, F.col("html"), F.lit(CLOCK)), 256).alias("hash"))


_TITLE = r"(?i)(?:title|heading)[:\s]+[\"'']?([^\"''\n]+)"


@query(f"""WITH src AS (SELECT doc_id AS id, '- heading "' || lang || '"' || {NL} || '  - link a' || {NL} || '- Link b' || {NL} || '- ' || source || {NL} || text AS t FROM documents), e AS (SELECT id, t, list_transform(regexp_extract_all(t, '(?m)(?:^|\\n)\\s*-\\s*(\\w+)', 1), lambda x: lower(x)) AS l FROM src),
c AS (SELECT id, x, count(*) AS n, min(i) AS i FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM e) GROUP BY id, x),
s AS (SELECT id, array_to_string(list(x || ':' || n ORDER BY n DESC, i)[1:8], ' ') AS s FROM c GROUP BY id)
SELECT id AS doc_id, sha256({_stored_sql('t', f"'{CLOCK}'", 'browser', f"'\"' || substr(regexp_extract(t, '{_TITLE}', 1), 1, 50) || '\" | ' || s")}) AS hash FROM src JOIN s USING (id)""")
def preview_browser(spark, sf_dir):
    """Documents below a short accessibility snapshot."""
    t = F.concat(F.lit('- heading "'), F.col("lang"), F.lit('"\n  - link a\n- Link b\n- '), F.col("source"), F.lit("\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(render.stored_result(F.lit("browser"), t, F.lit(CLOCK)), 256).alias("hash"))


@query(f"""WITH src AS (SELECT doc_id AS id, text AS t, substr(text, 1, ((doc_id % 4) * 200)::BIGINT) AS y FROM documents WHERE length(text) > 0), {_fit_sql('src', 960, 640)},
p AS (SELECT *, 'tr_' || sha256(t)[:8] AS rid, '📄 Tool Output | ~' || format('{{:,}}', ceil(length(t) / 4.0)::BIGINT) || ' tokens | {CLOCK}' AS facts, substr(t, 1, 1600) AS cut FROM src JOIN ht USING (id)),
z AS (SELECT *, CASE WHEN contains(cut, {NL}) THEN length(regexp_extract(cut, '(?s)^(.*)\\n', 1)) ELSE -1 END AS last, {NL} || {NL} || '💡 Retrieve full: retrieve_tool_result(result_id="' || rid || '")' || {NL} || '   Options: mode="search", query="' AS m1, '" | mode="lines", start_line=N, end_line=M' AS m2 FROM p)
SELECT id AS doc_id, sha256(CASE WHEN length(y) >= 150 THEN '[STORED: ' || rid || ']' || {NL} || facts || {NL} || {NL} || CASE WHEN length(y) > 500 THEN substr(y, 1, 497) || '...' ELSE y END || m1 || '...' || m2
 ELSE '[STORED: ' || rid || '] ⚠️ Summarization unavailable' || {NL} || facts || CASE WHEN {_ERRORS.format(more='|fatal')} THEN {NL} || '⚠️ Output may contain errors' ELSE '' END || {NL} || {NL} || '--- PREVIEW ---' || {NL}
 || trim(CASE WHEN n > 20 THEN ends WHEN length(t) > 1600 THEN CASE WHEN last > 1280 THEN substr(cut, 1, last) ELSE cut END || {NL} || '... [truncated]' ELSE t END, {BLANKS}) || {NL} || '--- END PREVIEW ---' || m1 || 'error' || m2 END) AS hash FROM z""")
def summary_or_preview(spark, sf_dir):
    """Summaries of four lengths, too short ones replaced by a preview."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    y = F.substring(F.col("text"), F.lit(1), ((F.col("doc_id") % 4) * 200).cast("int"))
    return d.select("doc_id", F.sha2(render.summarised(F.lit("other"), F.col("text"), y, F.lit(CLOCK)), 256).alias("hash"))


@query(f"""WITH ln AS (SELECT doc_id AS id, generate_subscripts(l, 1) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents)), mt AS (SELECT id, i, row_number() OVER (PARTITION BY id ORDER BY i) AS r, count(*) OVER (PARTITION BY id) AS c FROM ln WHERE contains(lower(x), 'license')),
bl AS (SELECT m.id, m.r, any_value(c) AS c, '--- Line ' || m.i || ' ---' || {NL} || string_agg(CASE WHEN l.i = m.i THEN '> ' ELSE '  ' END || l.i || ': ' || l.x || {NL}, '' ORDER BY l.i) || {NL} AS b FROM mt m JOIN ln l ON l.id = m.id AND l.i BETWEEN m.i - 2 AND m.i + 2 GROUP BY m.id, m.r, m.i),
rn AS (SELECT *, 'Found ' || c || CASE WHEN c > 1 THEN ' matches' ELSE ' match' END || ' for "License":' || {NL} || {NL} AS head FROM bl),
bf AS (SELECT *, length(head) + coalesce(sum(length(b)) OVER (PARTITION BY id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rn),
g AS (SELECT id, any_value(head) || coalesce(string_agg(b, '' ORDER BY r) FILTER (before <= 180.0::DOUBLE), '') || CASE WHEN max(before) > 180.0::DOUBLE THEN {NL} || '... and ' || (any_value(c) - min(r) FILTER (before > 180.0::DOUBLE) + 1) || ' more matches' ELSE '' END AS t FROM bf GROUP BY id)
SELECT doc_id, coalesce(trim(t, {BLANKS}), 'No matches found for "License"') AS shown FROM documents LEFT JOIN g ON g.id = doc_id""")
def search_rendering(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", render.search_result(F.col("text"), "License", context=2, max_tokens=50).alias("shown"))


@query(f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '❌ No result ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN {NL} || '💡 Ask again' ELSE '' END ELSE sha256('📄 Retrieved from: tr_' || sha256(text)[:8] || {NL} || 'Tool: exec | Mode: full | Total: ' || len(string_split(text, {NL})) || ' lines (~' || ceil(length(text) / 4.0)::BIGINT || ' tokens)' || {NL} || {NL} || '---' || {NL} || text) END AS answer FROM documents""")
def tool_answers(spark, sf_dir):
    t = F.col("text")
    good = F.sha2(render.tool_answer(text.result_id(t), "exec", "full", previews.line_count(t), t, text.estimate_tokens(t)), 256)
    bad = render.tool_error(F.concat(F.lit("No result "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, "Ask again"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, bad).otherwise(good).alias("answer"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'b' || turn ELSE 'm' || turn END AS tool_call_id, CASE WHEN turn % 3 = 1 THEN coalesce(text, '') ELSE text END AS text FROM conversations WHERE turn % 3 <> 0""")
def tool_results_both_forms(spark, sf_dir):
    """Results as blocks of a user's message, and messages that are one as a whole."""
    c = table(spark, sf_dir, "conversations")
    at = lambda p: F.concat(F.lit(p), F.col("turn").cast("string"))
    say = _block(type=F.lit("text"), text=F.col("text"))
    content = F.when(F.col("turn") % 3 == 1, F.array(say, _block(type=F.lit("tool_result"), tool_use_id=at("b"), content=F.col("text")))).otherwise(F.array(say))
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "toolResult").otherwise("user").alias("role"), content.alias("content"), at("m").alias("call"))
    return messages.tool_results(rows, keys=["conv_id", "turn"], call_id="call")


# ---- prompts


def _prompt_sql(cap: int, before: str, after: str) -> str:
    return f"""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM l WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 10)
SELECT conv_id, '{before}' || {NL} || {NL} || string_agg('[' || i || '] ' || upper(role) || ': ' || substr(text, 1, {cap}) || CASE WHEN length(text) > {cap} THEN '...' ELSE '' END, {NL} || {NL} ORDER BY turn) || {after} AS prompt FROM e GROUP BY conv_id HAVING bool_or(role = 'user')"""


@query(_prompt_sql(500, "Which lasting facts does this conversation give?", f"{NL} || {NL} || 'Answer with a JSON array of facts, or [].'"))
def prompts_for_facts(spark, sf_dir):
    return extract.fact_prompts(table(spark, sf_dir, "conversations"))


@query(_prompt_sql(1000, "What of this conversation is worth remembering?", f"""{NL} || {NL} || 'Projects: a, b. Tools: spark.' || {NL} || {NL} || 'Answer with JSON: "facts", an array, and "summary", an object or null.'"""))
def prompts_for_memory(spark, sf_dir):
    return extract.memory_prompts(table(spark, sf_dir, "conversations"), projects=["a", "b"], stack="spark")


@query(f"""SELECT event_id, 'Category: ' || event_type || {NL} || 'Old fact: ' || event_type || {NL} || 'Confidence: ' || CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE '0.5' END || {NL} || {NL} || 'New fact: ' || props || {NL} || 'Confidence: 0.75' || {NL} || 'Said: user ' || user_id || {NL} || {NL} || 'Do they contradict? Answer with JSON: conflicts, reason, resolution.' AS prompt FROM events""")
def prompts_for_conflicts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    p = extract.conflict_prompt(F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.lit(0.5)), F.col("props"), F.col("event_type"), F.lit(0.75), said)
    return e.select("event_id", p.alias("prompt"))


@query("SELECT conv_id, turn, role = 'system' OR use OR res AS is_tool FROM (SELECT *, coalesce(lag(use) OVER (PARTITION BY conv_id ORDER BY turn), false) AS res FROM (SELECT *, role = 'assistant' AND turn % 4 = 1 AS use FROM conversations))")
def tool_messages(spark, sf_dir):
    return _with_tools(spark, sf_dir).select("conv_id", "turn", extract.is_tool_message(F.col("role"), F.col("content")).alias("is_tool"))


# ---- memory

_RULES = ("keep_latest", "keep_highest_confidence", "merge", "ask_user")


def _event_facts(spark, sf_dir, rest: int) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_id") % 6 == rest)
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.concat(F.lit("item "), (F.floor(F.col("event_id") / 6) % 13).cast("string"))
    return e.select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("category"), value.alias("value"), ((F.col("event_id") % 10) / 10).alias("confidence"), F.lit(None).cast("array<float>").alias("embedding"), rule.alias("rule"))


_EVENT_FACTS = "(SELECT user_id, event_id AS {id}, event_type AS category, 'item ' || ((event_id // 6) % 13) AS {value}, (event_id % 10) / 10.0::DOUBLE AS {conf}, event_id % 4 AS rule FROM events WHERE event_id % 6 = {rest})"
_N, _O = _EVENT_FACTS.format(id="id", value="value", conf="conf", rest=1), _EVENT_FACTS.format(id="old_id", value="old_value", conf="old_conf", rest=0)


@query(f"""WITH c AS (SELECT n.id, o.old_id, o.old_value, o.old_conf FROM {_N} n JOIN {_O} o USING (user_id, category) WHERE contains(value, old_value) OR contains(old_value, value) QUALIFY row_number() OVER (PARTITION BY user_id, n.id ORDER BY o.old_id) = 1)
SELECT id, old_id, CASE WHEN old_id IS NULL THEN 'add' WHEN rule = 0 OR rule = 2 OR (rule = 1 AND conf > old_conf) THEN 'update' WHEN rule = 3 THEN 'defer' ELSE 'keep' END AS action,
CASE WHEN old_id IS NULL OR rule = 0 OR (rule = 1 AND conf > old_conf) THEN value WHEN rule = 2 THEN old_value || '; ' || value ELSE old_value END AS value,
CASE WHEN old_id IS NULL OR rule = 0 OR (rule = 1 AND conf > old_conf) THEN conf WHEN rule = 2 THEN greatest(conf, old_conf) ELSE old_conf END AS confidence FROM {_N} n LEFT JOIN c USING (id)""")
def conflict_strategies(spark, sf_dir):
    """Facts made from events, each with one of the four strategies."""
    return extract.resolve(_event_facts(spark, sf_dir, 1), _event_facts(spark, sf_dir, 0), strategy=F.col("rule")).select("id", "old_id", "action", "value", "confidence")


@query(f"""SELECT n.vec_id AS id, min(o.vec_id) AS old_id FROM embeddings n JOIN embeddings o USING (label) WHERE n.vec_id % 10 = 1 AND o.vec_id % 10 = 0 AND {_cos('n.embedding', 'o.embedding')} >= 0.3 GROUP BY n.vec_id""")
def conflict_vectors(spark, sf_dir):
    """Facts with vectors contradict where these are similar."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("user_id"), F.col("vec_id").alias("id"), F.lit("c").alias("category"), F.lit("v").alias("value"), F.lit(0.5).alias("confidence"), "embedding")
    return extract.conflicts(e.where("id % 10 = 1"), e.where("id % 10 = 0"), threshold=0.3).select("id", "old_id")


def _words_score(q: str, ws: str) -> str:
    """The memory's BM25 of two columns in SQL: lists of words."""
    tf = f"len(list_filter({ws}, lambda w: contains(w, q) OR contains(q, w)))"
    return f"list_sum(list_transform({q}, lambda q: CASE WHEN {tf} = 0 THEN 0.0::DOUBLE ELSE {tf} * 2.5::DOUBLE / ({tf} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len({ws}) / 50.0::DOUBLE)) END))"


@query(f"""WITH b AS (SELECT n.user_id, n.id, n.category AS nc, o.category AS oc, n.value, o.old_id, o.old_value, round(0.8::DOUBLE * {_words_score("string_split(n.value, ' ')", "string_split(o.old_value, ' ')")}, 6) AS s FROM {_N} n JOIN {_O} o USING (user_id)),
k AS (SELECT * FROM b WHERE s >= 0.6 QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY s DESC, old_id) <= 20)
SELECT id, min(old_id) AS old_id FROM k WHERE nc = oc AND (contains(value, old_value) OR contains(old_value, value)) GROUP BY id""")
def batch_conflicts(spark, sf_dir):
    return extract.batch_conflicts(_event_facts(spark, sf_dir, 1), _event_facts(spark, sf_dir, 0)).select("id", "old_id")


@query("SELECT event_id AS id, (event_id % 10) / 10.0::DOUBLE AS confidence, ((event_id % 10) / 10.0::DOUBLE)::VARCHAR AS noted, event_type AS context FROM events WHERE event_id % 10 >= 5")
def confidence_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), ((F.col("event_id") % 10) / 10).alias("confidence"), F.col("event_type").alias("source_context"))
    g = extract.gate(e, 0.5)
    return g.select("id", "confidence", F.col("metadata")["confidence"].alias("noted"), F.col("metadata")["source_context"].alias("context"))


def _answers(prompt):
    """Stands in for a model: one fact and one summary that follow from the prompt's beginning."""
    fact = F.regexp_replace(F.substring(prompt, 1, 40), "[^A-Za-z ]", " ")
    sure = ((F.length(prompt) % 10) / 10).cast("string")
    return F.concat(F.lit('{"facts":[{"fact":"'), fact, F.lit('","category":"project","confidence":'), sure, F.lit(',"source_context":"c"}],"summary":{"topic":"t","content":"'), fact, F.lit('","entities":[],"projects":[]}}'))


def _flushed(spark, sf_dir, **more) -> flow.Flushed:
    c = table(spark, sf_dir, "conversations").withColumn("user_id", F.concat(F.lit("u"), (F.col("conv_id") % 10).cast("string")))
    part = F.regexp_replace(F.substring(F.concat(F.lit("[1] USER: "), F.col("text")), 1, 25), "[^A-Za-z ]", " ")
    old = c.where("role = 'user' and conv_id % 3 = 0 and turn <= 2")
    stored = old.select("user_id", (F.col("conv_id") * 100 + F.col("turn")).alias("id"), part.alias("value"), F.lit("project").alias("category"), F.lit(0.45).alias("confidence"), F.lit(None).cast("array<float>").alias("embedding"))
    return flow.flush(c, stored, _answers, Config(**more))


_FLUSH = """WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM l WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 10),
p AS (SELECT conv_id, string_agg('[' || i || '] ' || upper(role) || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS prompt FROM e GROUP BY conv_id HAVING bool_or(role = 'user')),
f AS (SELECT 'u' || (conv_id % 10) AS user_id, conv_id, regexp_replace(substr(prompt, 1, 40), '[^A-Za-z ]', ' ', 'g') AS value, (length(prompt) % 10) / 10.0::DOUBLE AS conf FROM p QUALIFY row_number() OVER (PARTITION BY user_id, value ORDER BY conf DESC, conv_id) = 1),
o AS (SELECT 'u' || (conv_id % 10) AS user_id, conv_id * 100 + turn AS old_id, regexp_replace(substr('[1] USER: ' || text, 1, 25), '[^A-Za-z ]', ' ', 'g') AS old_value FROM conversations WHERE role = 'user' AND conv_id % 3 = 0 AND turn <= 2),
c AS (SELECT f.user_id, value, old_id FROM f JOIN o USING (user_id) WHERE contains(lower(value), lower(old_value)) OR contains(lower(old_value), lower(value)) QUALIFY row_number() OVER (PARTITION BY f.user_id, value ORDER BY old_id) = 1),
x AS (SELECT f.user_id, f.conv_id, f.value, old_id, CASE WHEN old_id IS NOT NULL AND conf > 0.45::DOUBLE THEN 'updated' WHEN old_id IS NOT NULL THEN 'kept' WHEN conf < 0.5::DOUBLE THEN 'skipped' ELSE 'stored' END AS outcome FROM f LEFT JOIN c USING (user_id, value))"""


@query(_FLUSH + " SELECT user_id, value, outcome FROM x")
def flush_outcomes(spark, sf_dir):
    """A batch of conversations extracted, resolved against what is stored, and gated."""
    return _flushed(spark, sf_dir).outcomes.select("user_id", "value", "outcome")


@query(_FLUSH + " SELECT count(*) AS extracted, count(*) FILTER (outcome = 'stored') AS stored, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'kept') AS not_stored, count(*) FILTER (outcome = 'stored') AS embeddings_stored FROM x")
def flush_counters(spark, sf_dir):
    return _flushed(spark, sf_dir).counters()


@query(_FLUSH + ", n AS (SELECT (SELECT count(*) FROM o) + (SELECT count(*) FROM x WHERE outcome = 'stored') AS facts, (SELECT count(*) FROM o) AS old, (SELECT count(*) FROM p) AS answers) SELECT 'facts' AS mode, facts, 0::BIGINT AS summaries FROM n UNION ALL SELECT 'hybrid', facts, answers FROM n UNION ALL SELECT 'semantic', old, answers FROM n")
def storage_modes(spark, sf_dir):
    """What each storage mode leaves: facts in the store, and summaries to merge."""
    out = None
    for mode in ("facts", "hybrid", "semantic"):
        done = _flushed(spark, sf_dir, storage_mode=mode)
        one = done.facts.agg(F.count("*").alias("facts")).select(F.lit(mode).alias("mode"), "facts").join(F.broadcast(done.summaries.agg(F.count("*").alias("summaries"))))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(_FLUSH + ", w AS (SELECT conv_id, count(*) AS buffered FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) >= 10 GROUP BY conv_id), d AS (SELECT conv_id, count(*) AS extracted, count(*) FILTER (outcome = 'stored') AS stored FROM x GROUP BY conv_id) SELECT conv_id, coalesce(extracted, 0) AS extracted, coalesce(stored, 0) AS stored, coalesce(buffered, 0) AS buffered FROM w FULL JOIN d USING (conv_id)")
def session_stats(spark, sf_dir):
    return flow.session_stats(_flushed(spark, sf_dir).outcomes, table(spark, sf_dir, "conversations"))


_SUMS = "SELECT event_id AS id, 'u' || (user_id % 10) AS user_id, event_type || (event_id % 7) AS topic, props || ' #' || event_id AS content, ['e' || (event_id % 3), event_type] AS entities, ['p' || (event_id % 2)] AS projects, 1 AS source_messages, ts AS updated_at, embedding FROM events JOIN embeddings ON vec_id = event_id % 500"


def _vector_summaries(spark, sf_dir):
    e, v = table(spark, sf_dir, "events"), table(spark, sf_dir, "embeddings")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    j = e.join(v.select("vec_id", "embedding"), F.col("event_id") % 500 == F.col("vec_id"))
    return j.select(F.col("event_id").alias("id"), s("u", F.col("user_id") % 10).alias("user_id"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("topic"), F.concat("props", F.lit(" #"), F.col("event_id").cast("string")).alias("content"), F.array(s("e", F.col("event_id") % 3), F.col("event_type")).alias("entities"), F.array(s("p", F.col("event_id") % 2)).alias("projects"), F.lit(1).alias("source_messages"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("ts").cast("timestamp").alias("last_accessed_at"), "embedding", s("h", F.col("event_id")).alias("content_hash"))


@query(f"""WITH s AS ({_SUMS}), o AS (SELECT * FROM s WHERE id % 4 = 0), nw AS (SELECT * FROM s WHERE id % 40 = 1),
ex AS (SELECT user_id, topic, arg_max(id, (updated_at, -id)) AS ex FROM o GROUP BY ALL), rc AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id) AS r FROM o QUALIFY r <= 50),
al AS (SELECT n.id, arg_min(rc.id, rc.r) AS al FROM nw n JOIN rc USING (user_id) WHERE {_cos('n.embedding', 'rc.embedding')} >= 0.3 GROUP BY n.id),
a AS (SELECT o.*, o.id::VARCHAR AS k, 0 AS rank FROM o UNION ALL SELECT n.*, coalesce(ex, al)::VARCHAR AS k, 1 FROM nw n LEFT JOIN ex USING (user_id, topic) LEFT JOIN al ON al.id = n.id),
g AS (SELECT *, coalesce(k, 'topic:' || topic) AS key FROM a)
SELECT user_id, arg_min(id, (rank, updated_at, id)) AS id, arg_min(topic, (rank, updated_at, id)) AS topic, substr(string_agg(content, chr(10) || chr(10) || 'Update: ' ORDER BY rank, updated_at, id), 1, 1000) AS content, len(list_distinct(flatten(list(entities))))::BIGINT AS n_entities, sum(source_messages)::BIGINT AS source_messages FROM g GROUP BY user_id, key""")
def summary_merge(spark, sf_dir):
    """New summaries folded into those of the same topic, else of a similar vector."""
    s = _vector_summaries(spark, sf_dir)
    out = flow.merge_summaries(s.where("id % 40 = 1"), s.where("id % 4 = 0"), threshold=0.3)
    return out.select("user_id", "id", "topic", "content", F.size("entities").cast("long").alias("n_entities"), F.col("source_messages").cast("long").alias("source_messages"))


_NEWEST = f"(SELECT * FROM ({_SUMS}) WHERE user_id = 'u3' AND list_contains(projects, 'p1') ORDER BY updated_at DESC, id LIMIT 200)"


@query(f"""WITH b AS (SELECT *, {_words_score("['purchase1', 'p1']", "ws")} AS bm FROM (SELECT *, string_split_regex(lower(topic || ' ' || content), '\\s+') AS ws FROM {_NEWEST})),
s AS (SELECT id, topic, round(CASE WHEN id % 5 = 0 THEN 0.4::DOUBLE ELSE 0 END + 0.3::DOUBLE * bm + 0.5::DOUBLE * CASE WHEN id % 2 = 1 THEN {_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')} ELSE 0 END
 + CASE WHEN len(list_filter(entities, lambda e: contains('purchase1 p1', e) OR contains(e, 'purchase1 p1'))) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(projects, lambda e: contains('purchase1 p1', e) OR contains(e, 'purchase1 p1'))) > 0 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score FROM b)
SELECT * FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 8""")
def summary_retrieve_vectors(spark, sf_dir):
    """Summaries of some projects by full-text matches, vectors and names."""
    s = _vector_summaries(spark, sf_dir)
    q = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    vectors = s.where("id % 2 = 1").select("content_hash", "embedding")
    return memory.retrieve_summaries(s.drop("embedding"), vectors, s.where("id % 5 = 0").select("id"), user_id="u3", query="purchase1 p1", query_vector=q, projects=["p1"], k=8).select("id", "topic", "score")


@query(f"""WITH f AS (SELECT vec_id AS id, string_split('fact ' || vec_id || ' the', ' ') AS ws, CASE WHEN vec_id % 2 = 0 THEN embedding END AS embedding FROM embeddings WHERE label = 3 ORDER BY vec_id DESC LIMIT 1000),
b AS (SELECT id, {_words_score("['the', 'fact']", "ws")} AS bm, coalesce({_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 0)')}, 0) AS cos, embedding IS NOT NULL AS has FROM f),
h AS (SELECT *, CASE WHEN has THEN 0.6::DOUBLE * cos + 0.4::DOUBLE * bm ELSE 0.8::DOUBLE * bm END AS hy FROM b)
SELECT id, round(greatest(hy, 0.8::DOUBLE * bm), 6) AS score, round(cos, 6) AS cos, has AS has_embedding FROM h WHERE hy >= 0.75 OR bm > 0.5 ORDER BY score DESC, id LIMIT 12""")
def fact_retrieve_vectors(spark, sf_dir):
    """Facts of a user, half of them with vectors by the hash of their text."""
    e = table(spark, sf_dir, "embeddings")
    h = F.concat(F.lit("h"), F.col("vec_id").cast("string"))
    facts = e.select(F.concat(F.lit("u"), F.col("label").cast("string")).alias("user_id"), F.col("vec_id").alias("id"), F.concat(F.lit("fact "), F.col("vec_id").cast("string"), F.lit(" the")).alias("value"), F.lit("user").alias("scope"), F.lit("project").alias("category"), F.lit(None).cast("string").alias("key"), F.col("vec_id").alias("last_accessed_at"), h.alias("content_hash"))
    q = e.where("vec_id = 0").first()["embedding"]
    vectors = e.where("vec_id % 2 = 0").select(h.alias("content_hash"), "embedding")
    return memory.retrieve_facts(facts, vectors, user_id="u3", query="the fact", query_vector=q, k=12).select("id", "score", "cos", "has_embedding")


@query("SELECT event_id AS id, CASE WHEN event_id IN (SELECT event_id FROM events WHERE user_id = 3 ORDER BY value DESC, event_id LIMIT 10) THEN TIMESTAMP '2024-02-01' ELSE ts END AS last_accessed_at FROM events")
def retrieval_touches(spark, sf_dir):
    """The rows that a retrieval returned are noted, and the notes move their last access."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "value", F.col("ts").cast("timestamp").alias("last_accessed_at"))
    found = e.where("user_id = 3").orderBy(F.desc("value"), "id").limit(10)
    return memory.fold_touches(e, memory.touches(found, datetime(2024, 2, 1))).select("id", "last_accessed_at")


@query("SELECT (SELECT count(DISTINCT event_type) FROM events WHERE user_id = 3)::BIGINT AS patterns, (SELECT count(*) FROM events WHERE user_id = 3 AND event_type = 'click')::BIGINT AS summaries")
def user_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return memory.user_counts(e.select("user_id", "event_type").distinct(), e.where("event_type = 'click'"), user_id=3)


@query("SELECT 'conversations' AS table_name, count(*) AS n FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'nothing', 0")
def table_counts(spark, sf_dir):
    names = ("conversations", "documents", "embeddings")
    return memory.table_counts({n: table(spark, sf_dir, n) for n in names} | {"nothing": table(spark, sf_dir, "labels").where("false")})


@query(f"""WITH f AS (SELECT event_id AS id, event_type AS category, props AS t, (event_id % 100) / 100.0::DOUBLE AS s FROM events WHERE user_id = 3 AND event_id % 2 = 0 ORDER BY s DESC, id LIMIT 6), s AS (SELECT event_id AS id, event_type AS topic, props AS t, (event_id % 100) / 100.0::DOUBLE AS s FROM events WHERE user_id = 3 AND event_id % 2 = 1 ORDER BY s DESC, id LIMIT 4)
SELECT coalesce((SELECT '🧠 REMEMBERED FACTS:' || {NL} || string_agg('  • [' || category || '] ' || t || ' (' || floor(s * 100 + 0.5)::BIGINT || '%)' || {NL}, '' ORDER BY s DESC, id) || {NL} FROM f), '')
|| coalesce((SELECT '📝 CONVERSATION SUMMARIES:' || {NL} || string_agg('  ┌─ ' || topic || ' (' || floor(s * 100 + 0.5)::BIGINT || '%)' || {NL} || '  │  ' || t || {NL} || CASE WHEN id % 3 = 0 THEN '  │  Entities: a, ' || topic || {NL} ELSE '' END || '  └──' || {NL}, '' ORDER BY s DESC, id) || {NL} FROM s), '') AS context""")
def memory_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id = 3").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.col("event_type").alias("topic"), F.col("props").alias("text"), ((F.col("event_id") % 100) / 100).alias("score"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("a"), F.col("event_type"))).alias("entities"))
    top = lambda kind, rest, k: e.where(F.col("id") % 2 == rest).orderBy(F.desc("score"), "id").limit(k).withColumn("source", F.lit(kind))
    return memory.format_results(top("fact", 0, 6).unionByName(top("summary", 1, 4)))


@query("SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY i), ',') AS entities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS i FROM orders GROUP BY ALL) GROUP BY o_custkey")
def names_in_first_order(spark, sf_dir):
    """Names united in the order in which they are first seen."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    return o.select("o_custkey", F.array_join(F.array_distinct(F.transform("x", lambda x: x["o_orderpriority"])), ",").alias("entities"))


@query(f"""WITH d AS (SELECT doc_id, {_tok('text')} AS t FROM documents), p AS (SELECT doc_id, unnest(t) AS term FROM d) SELECT term, doc_id, count(*) AS tf FROM p WHERE term IN ('error', 'license', 'token') GROUP BY ALL""")
def posting_lookup(spark, sf_dir):
    """Postings of three terms."""
    index = lexical.inverted_index(table(spark, sf_dir, "documents"), id_col="doc_id", text="text")
    return index.where(F.col("term").isin("error", "license", "token")).select("term", "doc_id", "tf")


# ---- answers and blocks made from every row


def _answer_rows(spark, sf_dir) -> DataFrame:
    """For every message an answer of a model in one of five forms: an object, in a fence, a bare array, broken off after a fact, broken off within one."""
    c = table(spark, sf_dir, "conversations")
    fact = F.concat(F.regexp_replace(F.substring("text", 1, 30), "[^A-Za-z ]", " "), F.lit(" "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    kind = F.when(F.col("role") == "user", "preference").when(F.col("role") == "assistant", "Tools").otherwise("odd")
    sure = F.when(F.col("turn") % 2 == 0, F.lit("0.25")).otherwise(F.lit("7"))
    one = F.concat(F.lit('{"fact":"'), fact, F.lit('","category":"'), kind, F.lit('","confidence":'), sure)
    whole = F.concat(one, F.lit(',"source_context":"said"}'))
    summary = F.concat(F.lit('{"topic":"'), kind, F.lit('","content":"'), fact, F.lit('","entities":["e"],"projects":"p"}'))
    both = F.concat(F.lit('{"facts":['), whole, F.lit('],"summary":'), summary, F.lit("}"))
    form = F.col("turn") % 5
    answer = F.when(form == 0, both).when(form == 1, F.concat(F.lit("```json\n"), both, F.lit("\n```"))).when(form == 2, F.concat(F.lit("Here: ["), whole, F.lit("]"))).when(form == 3, F.concat(F.lit('{"facts":['), whole, F.lit(',{"fact":"cut o'))).otherwise(F.concat(F.lit('{"facts":['), one, F.lit(',"source_con')))
    return c.select("conv_id", "turn", answer.alias("answer"))


_ANSWER = "regexp_replace(substr(text, 1, 30), '[^A-Za-z ]', ' ', 'g') || ' ' || conv_id || '-' || turn"


@query(f"""SELECT conv_id, turn, {_ANSWER} AS fact, CASE role WHEN 'user' THEN 'preference' WHEN 'assistant' THEN 'system' ELSE 'project' END AS category, CASE WHEN turn % 2 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN turn % 5 = 4 THEN 'Extracted from conversation' ELSE 'said' END AS source_context FROM conversations""")
def answers_to_facts(spark, sf_dir):
    p = _answer_rows(spark, sf_dir).select("conv_id", "turn", extraction.parse(F.col("answer")).alias("p"))
    return p.select("conv_id", "turn", F.inline(extraction.valid_facts(F.col("p")["facts"])))


@query(f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'preference' WHEN 'assistant' THEN 'Tools' ELSE 'odd' END AS topic, {_ANSWER} AS content, 'e' AS entities, 'p' AS projects FROM conversations WHERE turn % 5 < 2""")
def answers_to_summaries(spark, sf_dir):
    p = _answer_rows(spark, sf_dir).select("conv_id", "turn", extraction.valid_summary(extraction.parse(F.col("answer"))["summary"]).alias("s")).where("s is not null")
    return p.select("conv_id", "turn", "s.topic", "s.content", F.array_join("s.entities", ",").alias("entities"), F.array_join("s.projects", ",").alias("projects"))


@query("""SELECT event_id, event_id % 4 < 3 AS readable, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS conflicts, CASE event_id % 4 WHEN 0 THEN 'merge' END AS resolution FROM events""")
def answers_to_conflicts(spark, sf_dir):
    answers = ['{"conflicts":true,"reason":"r","resolution":"merge"}', '```json\n{"conflicts":false}\n```', '{"conflicts":true,"reason":"r"}', '{"conflicts":true,"reason":"r","resolution":"guess"}']
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, answers)), (F.col("event_id") % 4 + 1).cast("int")).alias("a"))
    p = e.select("event_id", extraction.parse_conflict(F.col("a")).alias("p"))
    return p.select("event_id", F.col("p").isNotNull().alias("readable"), F.col("p.conflicts").alias("conflicts"), F.col("p.resolution").alias("resolution"))


def _odd_blocks(spark, sf_dir) -> DataFrame:
    """Messages of two blocks, a text and by turn another text, a call, a call with a bad id, a result without content, a result."""
    c = table(spark, sf_dir, "conversations")
    at = F.concat(F.lit("c-"), F.col("turn").cast("string"))
    form = F.col("turn") % 5
    other = F.when(form == 0, _block(type=F.lit("text"), text=F.lit("more"))).when(form == 1, _block(type=F.lit("tool_use"), id=at, name=F.lit("exec"))).when(form == 2, _block(type=F.lit("tool_use"), id=F.lit("bad id"), name=F.lit("exec"))).when(form == 3, _block(type=F.lit("tool_result"), tool_use_id=at)).otherwise(_block(type=F.lit("tool_result"), tool_use_id=at, content=F.col("text")))
    return c.select("conv_id", "turn", "role", F.array(_block(type=F.lit("text"), text=F.col("text")), other).alias("content"))


@query("""SELECT conv_id, turn, turn % 5 NOT IN (2, 3) AS valid, CASE WHEN turn % 5 IN (2, 3) THEN 1 ELSE 2 END::BIGINT AS kept, turn % 5 <> 0 AS has_tools, CASE WHEN turn % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS spoken,
text || CASE turn % 5 WHEN 0 THEN chr(10) || 'more' WHEN 3 THEN chr(10) || '[Tool result: ...]' WHEN 4 THEN chr(10) || '[Tool result: ' || substr(text, 1, 500) || '...]' ELSE '' END AS shown FROM conversations WHERE coalesce(text, '') <> ''""")
def message_checks(spark, sf_dir):
    """What validation, stripping and texts make of every message."""
    m = _odd_blocks(spark, sf_dir).where("coalesce(content[0].text, '') <> ''")
    kept = messages.sanitise(m).select("conv_id", "turn", F.size("content").cast("long").alias("kept"))
    spoken = messages.strip_tools(m).select("conv_id", "turn", F.size("content").cast("long").alias("spoken"))
    rows = m.select("conv_id", "turn", messages.valid_message(F.col("role"), F.col("content")).alias("valid"), messages.has_tool_calls(F.col("content")).alias("has_tools"), messages.message_text(F.col("content")).alias("shown"))
    return rows.join(kept, ["conv_id", "turn"]).join(spoken, ["conv_id", "turn"])


@query("SELECT 0::BIGINT AS tool_use_missing_name, count(*) FILTER (turn % 5 = 2) AS tool_use_invalid_id, 0::BIGINT AS tool_result_invalid_id, count(*) FILTER (turn % 5 = 3) AS tool_result_missing_content, count(*) FILTER (turn % 5 IN (2, 3)) AS total FROM conversations")
def invalid_block_totals(spark, sf_dir):
    return messages.invalid_blocks(_odd_blocks(spark, sf_dir))


@query("SELECT type, count(*) AS n FROM (SELECT 'text' AS type FROM conversations UNION ALL SELECT CASE WHEN turn % 5 = 0 THEN 'text' WHEN turn % 5 < 3 THEN 'tool_use' ELSE 'tool_result' END FROM conversations) GROUP BY type")
def block_type_totals(spark, sf_dir):
    return messages.block_types(_odd_blocks(spark, sf_dir))


def _scoped_facts(spark, sf_dir) -> DataFrame:
    """A fact for every event: scope, agent, session and key follow from its id."""
    e = table(spark, sf_dir, "events")
    s = lambda p, n: F.concat(F.lit(p), (F.col("event_id") % n).cast("string"))
    scope = F.element_at(F.array(F.lit("user"), F.lit("agent"), F.lit("session")), (F.col("event_id") % 3 + 1).cast("int"))
    key = F.when(F.col("event_id") % 7 == 1, "").when(F.col("event_id") % 7 > 1, s("k", 11))
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("id"), "user_id", scope.alias("scope"), s("a", 2).alias("agent_id"), s("s", 4).alias("session_id"), key.alias("key"), F.col("event_type").alias("category"), F.col("props").alias("value"), F.sha2("props", 256).alias("content_hash"), ts.alias("created_at"), ts.alias("updated_at"))


_SCOPED = "(SELECT event_id AS id, user_id, ['user', 'agent', 'session'][event_id % 3 + 1] AS scope, 'a' || (event_id % 2) AS agent_id, 's' || (event_id % 4) AS session_id, CASE WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 > 1 THEN 'k' || (event_id % 11) END AS key, event_type AS category, props AS value, ts FROM events)"


@query(f"""WITH f AS (SELECT *, coalesce(nullif('k' || key, 'k'), '#' || id) AS k FROM {_SCOPED})
SELECT user_id, scope, min(id) AS id, arg_max(value, (ts, id)) AS value, min(ts) AS created_at, max(ts) AS updated_at FROM f GROUP BY user_id, scope, k""")
def facts_by_key(spark, sf_dir):
    """The newest values of each key, under its first id."""
    return memory.upsert_facts(_scoped_facts(spark, sf_dir)).select("user_id", "scope", "id", "value", "created_at", "updated_at")


@query(f"SELECT id FROM {_SCOPED} WHERE scope IN ('user', 'session') AND (scope = 'user' OR agent_id = 'a1') AND (scope <> 'session' OR session_id = 's1') AND category IN ('click', 'view')")
def facts_visible(spark, sf_dir):
    seen = memory.visible(scopes=["user", "session"], agent_id="a1", session_id="s1", categories=["click", "view"])
    return _scoped_facts(spark, sf_dir).where(seen).select("id")


@query(f"""WITH c AS (SELECT user_id, id, CASE WHEN id % 5 = 0 THEN 'new ' || id END AS v, CASE WHEN id % 10 < 2 THEN 'moved' END AS g FROM {_SCOPED} WHERE id % 5 < 2)
SELECT id, coalesce(v, value) AS value, coalesce(g, category) AS category, sha256(coalesce(v, value)) AS content_hash FROM {_SCOPED} LEFT JOIN c USING (user_id, id) WHERE id % 9 <> 0""")
def facts_changed(spark, sf_dir):
    """Updates of values and categories, of which the newest count, and deletions."""
    f = _scoped_facts(spark, sf_dir)
    value, moved = F.when(F.col("id") % 5 == 0, F.concat(F.lit("new "), F.col("id").cast("string"))), F.when(F.col("id") % 10 < 2, F.lit("moved"))
    some = f.where("id % 5 < 2")
    first = some.select("user_id", "id", F.lit("old").alias("value"), F.lit("old").alias("category"), F.timestamp_add("DAY", F.lit(1), F.col("updated_at")).alias("ts")).where("id % 10 = 0")
    changes = first.unionByName(some.select("user_id", "id", value.alias("value"), moved.alias("category"), F.timestamp_add("DAY", F.lit(2), F.col("updated_at")).alias("ts")))
    return memory.delete_facts(memory.update_facts(f, changes), f.where("id % 9 = 0")).select("id", "value", "category", "content_hash")


@query(f"SELECT id FROM {_SCOPED} WHERE NOT (scope = 'session' AND session_id = 's2')")
def facts_after_session(spark, sf_dir):
    return memory.clean_session(_scoped_facts(spark, sf_dir), "s2").select("id")
