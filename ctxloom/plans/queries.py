"""A query for each operator, over whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxloom.functions import extraction, previews, render, text, vector
from ctxloom.operators import extraction as extract
from ctxloom.operators import fusion, lexical, memory, messages, results, select, threads
from ctxloom.sources import tables
from ctxloom.sources.tables import table
from ctxloom.streaming import triggers

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _tok(t: str, least: int = 2) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower(coalesce({t}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= {least})"


def _hashed(docs: str, ids: str, dim: int = 384) -> str:
    """CTE b(ids, bkt, w) of docs(ids, t)."""
    part = " UNION ALL ".join(f"SELECT {ids}, ('0x' || substr(h, {4 * i + 3}, 2) || substr(h, {4 * i + 1}, 2))::INT % {dim} AS bkt, CASE WHEN ('0x' || substr(h, {13 + 2 * i}, 2))::INT & 1 = 1 THEN {w} ELSE -{w} END AS wt FROM words" for i, w in enumerate((5, 3, 2)))
    return f"words AS (SELECT {ids}, md5(x) AS h FROM (SELECT {ids}, unnest({_tok('substr(t, 1, 2000)', 3)}) AS x FROM {docs})), b AS (SELECT {ids}, bkt, sum(wt)::DOUBLE AS w FROM ({part}) GROUP BY ALL)"


PROMPT = "How did the API connection error happen in the database?"
QUERY = "the and error token database"
AS_OF = datetime(2024, 1, 20)
CONTEXT_SQL = f"""
WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'),
q AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM u WHERE r <= 1 GROUP BY conv_id),
docs AS (SELECT conv_id, turn, text AS t FROM conversations UNION ALL SELECT conv_id, -1, t FROM q),
{_hashed('docs', 'conv_id, turn')},
norms AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS n FROM b GROUP BY ALL),
dots AS (SELECT b.conv_id, b.turn, sum(b.w * z.w) AS d FROM b JOIN b z ON z.conv_id = b.conv_id AND z.turn = -1 AND z.bkt = b.bkt WHERE b.turn >= 0 GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations),
s AS (SELECT m.*, CASE WHEN role IN ('system', 'developer') THEN 'system' WHEN r <= 1 THEN 'recent' END AS keep, length(coalesce(text, '')) < 10 AS empty, coalesce(d / (n1.n * n2.n), 0) AS cos
  FROM m LEFT JOIN dots USING (conv_id, turn) LEFT JOIN norms n1 USING (conv_id, turn) LEFT JOIN norms n2 ON n2.conv_id = m.conv_id AND n2.turn = -1),
scored AS (SELECT *, round(CASE WHEN keep IS NOT NULL THEN 1.0::DOUBLE WHEN empty THEN 0.0::DOUBLE ELSE cos END, 6) AS score FROM s),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, (keep IS NULL AND score >= {{least}}) ORDER BY score DESC, turn) AS place FROM scored),
chosen AS (SELECT *, (keep IS NOT NULL OR (score >= {{least}} AND place <= 2)) AS selected FROM ranked)
"""


def _scored(spark, sf_dir):
    return select.score(table(spark, sf_dir, "conversations"), recent=1)


@query(CONTEXT_SQL.format(least="0.0") + "SELECT conv_id, turn, role, score, keep FROM chosen WHERE selected OR size <= 3")
def select_context_topk(spark, sf_dir):
    return select.select_context(table(spark, sf_dir, "conversations"), k=2, recent=1, least=0.0).select("conv_id", "turn", "role", "score", "keep")


@query(CONTEXT_SQL.format(least="0.1") + "SELECT coalesce(keep, CASE WHEN empty THEN 'empty' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.1 THEN 'medium' ELSE 'low' END) AS bucket, count(*) AS n FROM chosen GROUP BY 1")
def score_distribution(spark, sf_dir):
    return select.distribution(_scored(spark, sf_dir), least=0.1)


@query(CONTEXT_SQL.format(least="0.1") + """, t AS (SELECT ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS k, selected FROM chosen),
a AS (SELECT sum(k)::BIGINT AS tokens_in, sum(CASE WHEN selected THEN k ELSE 0 END)::BIGINT AS tokens_out FROM t)
SELECT *, tokens_in - tokens_out AS tokens_saved, round(100.0::DOUBLE * (tokens_in - tokens_out) / tokens_in, 4) AS reduction_pct FROM a""")
def token_savings(spark, sf_dir):
    return select.savings(select.top(_scored(spark, sf_dir), k=2, least=0.1))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_window(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("r", messages.recent("turn", 3)).where("r").select("conv_id", "turn", "role")


@query(f"""WITH u AS (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '{PROMPT}' AS query_text FROM u WHERE coalesce(text, '') <> '' GROUP BY conv_id""")
def query_text(spark, sf_dir):
    return select.query_texts(table(spark, sf_dir, "conversations"), PROMPT)


@query("""WITH t AS (SELECT item_id, floor((100000 - (ceil(length(text) / 4.0)::BIGINT + 4000)) * 0.3::DOUBLE / 500.0::DOUBLE) AS room, length(text) - length(replace(text, '?', '')) AS q FROM benchmark)
SELECT item_id, greatest(5, least(50, floor(room * (CASE WHEN q > 2 THEN 1.3::DOUBLE WHEN q < 1 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END))))::BIGINT AS k FROM t""")
def dynamic_k(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.dynamic_k(F.lit(100000), F.col("text")).alias("k"))


@query(f"SELECT conv_id, turn, len({_tok('text')})::BIGINT AS n_tokens, len(list_distinct({_tok('text')}))::BIGINT AS n_unique, ceil(length(text) / 4.0)::BIGINT AS estimate FROM conversations")
def tokenize_stats(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_unique"), text.estimate_tokens(F.col("text")).alias("estimate"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL")
def term_freq(spark, sf_dir):
    return lexical.term_frequencies(table(spark, sf_dir, "documents"), id_col="doc_id", text="text")


@query(f"""WITH d AS (SELECT doc_id, {_tok('text')} AS t FROM documents), p AS (SELECT doc_id, len(t)::BIGINT AS length, unnest(t) AS term FROM d)
SELECT doc_id, term, count(*) AS tf, length FROM p GROUP BY doc_id, term, length""")
def inverted_index(spark, sf_dir):
    return lexical.inverted_index(table(spark, sf_dir, "documents"), id_col="doc_id", text="text")


@query(f"""WITH d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_tok('text')})) AS term FROM documents) GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
SELECT term, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS idf FROM d, n""")
def doc_freq_idf(spark, sf_dir):
    return lexical.document_frequencies(table(spark, sf_dir, "documents"), text="text").withColumn("idf", F.round("idf", 6))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_QUOTED = """["'']([^"'']+)["'']"""
_KEYWORDS = f"""list_concat(list_concat(list_filter(list_transform(regexp_extract_all(t, '{_QUOTED}', 1), lambda p: trim(p)), lambda p: p <> ''),
 (SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(u) AS x, generate_subscripts(u, 1) AS i FROM (SELECT list_concat(regexp_extract_all(rest, '\\b[A-Z]{{2,}}\\b'), regexp_extract_all(rest, '\\bE[A-Z]+\\b')) AS u)) GROUP BY x))),
 list_filter(string_split_regex(regexp_replace(lower(rest), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: (length(w) >= 3 AND w NOT IN ({_STOPS})) OR regexp_full_match(w, '\\d+')))"""
_TEXTS = f"""(SELECT 'b' || item_id AS id, text AS t FROM benchmark UNION ALL SELECT 'f' || id, t FROM (VALUES (1, 'open "src main" ENOENT read_file 404 the API'), (2, 'every easy word'), (3, ''), (4, 'the of and'), (5, 'getUserName fails on E404 at ~/x.txt')) AS v(id, t))"""


def _texts(spark, sf_dir):
    own = spark.createDataFrame([("f1", 'open "src main" ENOENT read_file 404 the API'), ("f2", "every easy word"), ("f3", ""), ("f4", "the of and"), ("f5", "getUserName fails on E404 at ~/x.txt")], "id string, t string")
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("t")).unionByName(own)


@query(f"SELECT id, array_to_string({_KEYWORDS}, '|') AS keywords FROM (SELECT id, t, regexp_replace(t, '{_QUOTED}', ' ', 'g') AS rest FROM {_TEXTS})")
def keyword_extract(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", F.array_join(text.keywords(F.col("t")), "|").alias("keywords"))


_NEEDS = r"""(regexp_matches(t, '["''].*?["'']') OR regexp_matches({code}, '\bE[A-Z]+\b') OR regexp_matches(t, '\w+_\w+') OR regexp_matches(t, '[a-z][A-Z]') OR regexp_matches(t, '[~/\\.]') OR regexp_matches(t, '(?i)\b(API|HTTP|SQL|JSON|XML|CSV|PDF|URL|URI)\b') OR regexp_matches(t, '\b\d{{3,4}}\b'))"""


@query(f"SELECT id, {_NEEDS.format(code='t')} AS needs, {_NEEDS.format(code='upper(t)')} AS needs_compat FROM {_TEXTS}")
def needs_fts(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", text.needs_search(F.col("t")).alias("needs"), text.needs_search(F.col("t"), compat=True).alias("needs_compat"))


@query(f"SELECT id, array_to_string(list_transform({_KEYWORDS}, lambda k: CASE WHEN contains(k, ' ') THEN '\"' || k || '\"' WHEN length(k) >= 4 THEN k || '*' ELSE k END), ' OR ') AS fts FROM (SELECT id, t, regexp_replace(t, '{_QUOTED}', ' ', 'g') AS rest FROM {_TEXTS})")
def fts_query_builder(spark, sf_dir):
    return _texts(spark, sf_dir).select("id", text.search_query(text.keywords(F.col("t"))).alias("fts"))


_BM25 = f"""WITH d AS (SELECT doc_id, {_tok('text')} AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d), tf AS (SELECT doc_id, length, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tok("text")}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, least(1.0::DOUBLE, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avgdl))) / 10) AS bm25
  FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("q"))


@query(_BM25 + "SELECT item_id, doc_id, round(bm25, 6) AS bm25 FROM s")
def bm25_corpus(spark, sf_dir):
    return lexical.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), id_col="doc_id", text="text", query_id="item_id", query="q").withColumn("bm25", F.round("bm25", 6))


@query(_BM25 + "SELECT item_id, doc_id, round(bm25, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM s QUALIFY rank <= 20")
def fts_search_bm25(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), id_col="doc_id", text="text", query_id="item_id", query="q", k=20)


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 1 AS recent, list_filter({_tok('text', 1)}, lambda w: starts_with(w, 'ention') OR w = 'the') AS hits FROM conversations)
SELECT conv_id, turn FROM m WHERE len(hits) > 0 OR recent OR (SELECT max(len(hits)) FROM m) = 0""")
def fts_prefilter(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").withColumn("recent", messages.recent("turn", 1))
    return lexical.prefilter(m, ["ention", "the"], text="text", recent=F.col("recent")).select("conv_id", "turn")


_MB = """list_sum(list_transform(string_split_regex(lower(trim('{q}')), '\\s+'), lambda q: (CASE WHEN len(list_filter(ws, lambda w: contains(w, q) OR contains(q, w))) = 0 THEN 0.0::DOUBLE ELSE
 len(list_filter(ws, lambda w: contains(w, q) OR contains(q, w))) * 2.5::DOUBLE / (len(list_filter(ws, lambda w: contains(w, q) OR contains(q, w))) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(ws) / 50.0::DOUBLE)) END)))"""


@query(f"SELECT conv_id, turn, round({_MB.format(q=QUERY)}, 6) AS score FROM (SELECT conv_id, turn, string_split_regex(lower(text), '\\s+') AS ws FROM conversations)")
def bm25_memory(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(lexical.memory_bm25(F.lit(QUERY), F.col("text")), 6).alias("score"))


@query(f"WITH docs AS (SELECT item_id, text AS t FROM benchmark), {_hashed('docs', 'item_id')}, n AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM b GROUP BY item_id) SELECT item_id, bkt::BIGINT AS place, round(w / n, 5) AS value FROM b JOIN n USING (item_id) WHERE w <> 0")
def hash_embedding(spark, sf_dir):
    v = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(vector.hash_embedding(F.col("text"))).alias("p", "x"))
    return v.where("x <> 0").select("item_id", F.col("p").cast("long").alias("place"), F.round("x", 5).alias("value"))


def _vectors(spark, sf_dir):
    """All rows, and the queries: those whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e, e.where("id % 100 = 0").withColumnRenamed("id", "query_id")


_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5)"


@query(f"SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def cosine_pairs(spark, sf_dir):
    return vector.compare(*_vectors(spark, sf_dir)).withColumnRenamed("id", "vec_id")


@query(f"SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10")
def cosine_topk_queries(spark, sf_dir):
    s = vector.compare(*_vectors(spark, sf_dir), k=10).withColumnRenamed("id", "vec_id")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 10").withColumn("rank", F.col("rank").cast("long"))


@query(CONTEXT_SQL.format(least="0.0") + f", h AS (SELECT *, {_MB.format(q=QUERY)} AS mb FROM (SELECT conv_id, turn, score, string_split_regex(lower(text), '\\s+') AS ws FROM chosen WHERE keep IS NULL)) SELECT conv_id, turn, round(0.4::DOUBLE * least(1.0::DOUBLE, mb / 10) + 0.6::DOUBLE * score, 5) AS hybrid FROM h")
def hybrid_score(spark, sf_dir):
    s = _scored(spark, sf_dir).where("keep is null")
    lex = F.least(F.lit(1.0), lexical.memory_bm25(F.lit(QUERY), F.col("text")) / 10)
    return s.select("conv_id", "turn", F.round(0.4 * lex + 0.6 * F.col("score"), 5).alias("hybrid"))


_LISTS = """l AS (SELECT 'price' AS list, p_partkey AS id, p_retailprice AS s FROM part UNION ALL SELECT 'size', p_partkey, p_size::DOUBLE FROM part UNION ALL SELECT 'sold', l_partkey, sum(l_quantity) FROM lineitem GROUP BY l_partkey)"""


def _lists(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("s")).select(F.lit("sold").alias("list"), "id", "s")
    one = lambda n, c: part.select(F.lit(n).alias("list"), F.col("p_partkey").alias("id"), F.col(c).cast("double").alias("s"))
    return one("price", "p_retailprice").unionByName(one("size", "p_size")).unionByName(sold)


@query(f"WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY s DESC, id) - 1 AS r FROM l) SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM r GROUP BY id")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(_lists(spark, sf_dir), list_col="list", id_col="id", score="s").withColumn("rrf", F.round("rrf", 9))


@query(f"""WITH {_LISTS}, r AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY s DESC, id) AS r FROM l), f AS (SELECT id, min(r * 10 + CASE list WHEN 'price' THEN 0 WHEN 'size' THEN 1 ELSE 2 END) AS f FROM r GROUP BY id)
SELECT id, row_number() OVER (ORDER BY f, id) AS place FROM f QUALIFY place <= 50""")
def round_robin_fusion(spark, sf_dir):
    return fusion.round_robin(_lists(spark, sf_dir), list_col="list", id_col="id", score="s", top=50).select("id", "place")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, round(0.7::DOUBLE * (o_totalprice / 1000000) + (1 - 0.7::DOUBLE) * ((o_orderkey % 100) / 100.0::DOUBLE), 6) AS final_score FROM orders)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY final_score DESC, o_orderkey) AS place FROM s QUALIFY place <= 3""")
def rerank_weighted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000000).alias("cross"), ((F.col("o_orderkey") % 100) / F.lit(100)).alias("bi"))
    return fusion.rerank(o, by=["o_custkey"], id_col="o_orderkey", cross="cross", bi="bi", top=3).select("o_custkey", "o_orderkey", "final_score", "place")


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_tok(f"'{PROMPT}'")}) AS q, {_tok('text')} AS d FROM conversations) SELECT conv_id, turn, round(len(list_filter(q, lambda w: list_contains(d, w)))::DOUBLE / len(q), 6) AS score FROM t""")
def pair_scores(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(fusion.pair_score(text.tokens(F.lit(PROMPT)), text.tokens(F.col("text"))), 6).alias("score"))


_ASKED = [(1, PROMPT), (2, "fix the build"), (3, "what is it"), (4, "Deploy API config for auth timeout"), (5, "hello world again")]


def _expand_sql() -> str:
    """The rules in SQL, from the same fixed words."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    one = lambda w, o: f"substr(low, 1, strpos(low, {quoted(w)}) - 1) || {quoted(o)} || substr(low, strpos(low, {quoted(w)}) + {len(w)})"
    parts = ["[q]"]
    parts += [f"CASE WHEN contains(low, {quoted(w)}) THEN [{one(w, o[0])}, {one(w, o[1])}] ELSE [] END" for w, o in fusion.SYNONYMS.items()]
    parts += [f"CASE WHEN contains(low, {quoted(w)}) THEN [low || {quoted(' ' + o[0])}] ELSE [] END" for w, o in fusion.RELATED.items()]
    drop = "\\b(" + "|".join(fusion.QUESTION_WORDS + fusion.FILLERS) + ")\\b"
    simple = f"trim(regexp_replace(regexp_replace(low, '{drop}', '', 'g'), '\\s+', ' ', 'g'))"
    known = ", ".join(map(quoted, [*fusion.SYNONYMS, *fusion.RELATED]))
    key = f"array_to_string(list_filter(string_split_regex(low, '\\s+'), lambda w: length(w) > 3 OR w IN ({known})), ' ')"
    parts += [f"[coalesce(nullif({simple}, ''), q)]", f"[coalesce(nullif({key}, ''), q)]"]
    every = "flatten([" + ", ".join(parts) + "])"
    asked = fixtures.values(_ASKED, "id, q")
    return f"""WITH a AS (SELECT id::BIGINT AS id, q, lower(q) AS low FROM {asked}), l AS (SELECT id, {every} AS l FROM a), v AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS v FROM l)
SELECT id, unnest(range(1, len(v) + 1))::BIGINT AS n, unnest(v) AS variant FROM v"""


@query(_expand_sql())
def query_expand_rules(spark, sf_dir):
    q = spark.createDataFrame(_ASKED, "id long, q string")
    return q.select("id", F.posexplode(fusion.Expander().column(F.col("q"))).alias("p", "variant")).select("id", (F.col("p") + 1).cast("long").alias("n"), "variant")


@query("SELECT 1::BIGINT AS id, unnest(['cold start', 'slow start', 'boot time', 'first run']) AS variant")
def query_expand_parse(spark, sf_dir):
    q = spark.createDataFrame([(1, "cold start", "1. slow start\n\n- boot time\ncold start\n* first run\n4. more")], "id long, q string, a string")
    return q.select("id", F.explode(fusion.parse_variants(F.col("a"), F.col("q"))).alias("variant"))


@query(f"""WITH f AS (SELECT *, user_id || scope || coalesce(nullif('k' || key, 'k'), '#' || id) AS k FROM {fixtures.FACTS_SQL})
SELECT user_id, scope, min(id)::BIGINT AS id, arg_max(value, minute) AS value, max(minute)::BIGINT AS minute FROM f GROUP BY user_id, scope, k""")
def fact_upsert_latest(spark, sf_dir):
    return memory.upsert_facts(fixtures.facts(spark)).select("user_id", "scope", "id", "value", F.col("minute").cast("long").alias("minute"))


_VISIBLE = "user_id = 'u1' AND (scope = 'user' OR agent_id = 'a1') AND (scope <> 'session' OR session_id = 's1')"


@query(f"""WITH s AS (SELECT id, value, {_MB.format(q='search engine')} AS b FROM (SELECT *, string_split_regex(lower(value), '\\s+') AS ws FROM {fixtures.FACTS_SQL} WHERE {_VISIBLE}))
SELECT id::BIGINT AS id, round(0.8::DOUBLE * b, 6) AS score FROM s WHERE 0.8::DOUBLE * b >= 0.75 OR b > 0.5 ORDER BY score DESC, id LIMIT 10""")
def fact_retrieve_scoped(spark, sf_dir):
    return memory.retrieve_facts(fixtures.facts(spark), None, user_id="u1", query="search engine", agent_id="a1", session_id="s1").select("id", "score")


_BIG_FACTS = f"""SELECT doc_id AS id, {_MB.format(q='the and')} AS b FROM (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS ws FROM documents WHERE source = 'src0' ORDER BY n_chars DESC, doc_id LIMIT 1000)"""


@query(f"SELECT id, round(0.8::DOUBLE * b, 6) AS score FROM ({_BIG_FACTS}) WHERE b > 0.5 OR 0.8::DOUBLE * b >= 0.75 ORDER BY score DESC, id LIMIT 10")
def fact_retrieve_topk(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("id"), F.col("text").alias("value"), F.lit("user").alias("scope"), F.col("lang").alias("category"), F.lit(None).cast("string").alias("key"), F.col("n_chars").alias("last_accessed_at"))
    return memory.retrieve_facts(f, None, user_id="src0", query="the and").select("id", "score")


@query(f"""SELECT coalesce(nullif(category, ''), 'general') AS category, '**' || upper(substr(coalesce(nullif(category, ''), 'general'), 1, 1)) || substr(coalesce(nullif(category, ''), 'general'), 2) || ':**' || chr(10) ||
 string_agg('• ' || value || CASE WHEN scope = 'session' THEN ' (this session)' ELSE ' ' END, chr(10) ORDER BY confidence DESC, id) AS block FROM {fixtures.FACTS_SQL} GROUP BY 1""")
def fact_group_by_category(spark, sf_dir):
    return memory.format_context(fixtures.facts(spark).withColumn("score", F.col("confidence")))


_SUMMARIES = "SELECT event_id AS id, 'u' || (user_id % 10) AS user_id, event_type AS topic, props AS content, ['e' || (event_id % 3), event_type] AS entities, ['p' || (event_id % 2)] AS projects, 1 AS source_messages, ts FROM events"


def _summaries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return e.select(F.col("event_id").alias("id"), s("u", F.col("user_id") % 10).alias("user_id"), F.col("event_type").alias("topic"), F.col("props").alias("content"), F.array(s("e", F.col("event_id") % 3), F.col("event_type")).alias("entities"), F.array(s("p", F.col("event_id") % 2)).alias("projects"), F.lit(1).alias("source_messages"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("ts").cast("timestamp").alias("last_accessed_at"))


@query(f"SELECT user_id, topic, min(id) AS id, substr(string_agg(content, chr(10) ORDER BY ts, id), 1, 1000) AS content, sum(source_messages)::BIGINT AS source_messages, len(list_distinct(flatten(list(entities))))::BIGINT AS n_entities FROM ({_SUMMARIES}) GROUP BY user_id, topic")
def summary_dedup_topic(spark, sf_dir):
    return memory.merge_topics(_summaries(spark, sf_dir)).select("user_id", "topic", "id", "content", "source_messages", F.size("entities").cast("long").alias("n_entities"))


@query(f"""WITH s AS (SELECT *, {_MB.format(q='purchase p1')} AS b FROM (SELECT *, string_split_regex(lower(topic || ' ' || content), '\\s+') AS ws FROM ({_SUMMARIES}) WHERE user_id = 'u3' ORDER BY ts DESC, id LIMIT 200))
SELECT id, topic, round(0.3::DOUBLE * b + CASE WHEN len(list_filter(entities, lambda e: contains('purchase p1', e) OR contains(e, 'purchase p1'))) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(projects, lambda e: contains('purchase p1', e) OR contains(e, 'purchase p1'))) > 0 THEN 0.1::DOUBLE ELSE 0 END, 6) AS score
FROM s WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 5""")
def summary_retrieve(spark, sf_dir):
    return memory.retrieve_summaries(_summaries(spark, sf_dir), None, None, user_id="u3", query="purchase p1").select("id", "topic", "score")


@query(f"""WITH f AS (SELECT 'fact' AS source, id::BIGINT AS id, round(0.8::DOUBLE * b, 6) AS score FROM (SELECT id, {_MB.format(q='search')} AS b FROM (SELECT *, string_split_regex(lower(value), '\\s+') AS ws FROM {fixtures.FACTS_SQL} WHERE user_id = 'u1')) WHERE b > 0.5 OR 0.8::DOUBLE * b >= 0.75 ORDER BY score DESC, id LIMIT 7),
s AS (SELECT 'summary' AS source, id, round(0.3::DOUBLE * b, 6) AS score FROM (SELECT id, ts, {_MB.format(q='search')} AS b FROM (SELECT *, string_split_regex(lower(topic || ' ' || content), '\\s+') AS ws FROM ({_SUMMARIES}) WHERE user_id = 'u1' ORDER BY ts DESC, id LIMIT 200)) WHERE 0.3::DOUBLE * b >= 0 ORDER BY score DESC, id LIMIT 5)
SELECT * FROM (FROM f UNION ALL FROM s) ORDER BY score DESC, source, id LIMIT 10""")
def memory_unified_topk(spark, sf_dir):
    f = memory.retrieve_facts(fixtures.facts(spark), None, user_id="u1", query="search", k=7)
    s = memory.retrieve_summaries(_summaries(spark, sf_dir), None, None, user_id="u1", query="search", k=5, least=0.0)
    return memory.search_memory(f, s).select("source", "id", "score")


@query("SELECT user_id, event_type, count(*) AS observation_count, arg_max(props, event_id) AS description, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS confidence FROM events GROUP BY ALL")
def pattern_confidence(spark, sf_dir):
    return memory.pattern_confidence(table(spark, sf_dir, "events"), keys=["user_id", "event_type"], description="props", ts="event_id")


@query(f"SELECT user_id, event_type, round(least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS confidence FROM events GROUP BY ALL HAVING least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - 1)) >= 0.75")
def patterns_confident(spark, sf_dir):
    return pattern_confidence(spark, sf_dir).where("confidence >= 0.75").select("user_id", "event_type", "confidence")


@query("SELECT lang AS scope, count(*) AS facts, count(l.doc_id) AS with_embedding, round(100.0::DOUBLE * count(l.doc_id) / count(*), 0) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE source = 'src0' GROUP BY lang")
def memory_stats(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("lang").alias("scope"), F.col("doc_id").alias("content_hash"))
    return memory.stats(f, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_hash")), user_id="src0")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def embedding_left_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("SELECT count(*) AS total, count(l.doc_id) AS with_embedding, coalesce(round(100.0::DOUBLE * count(l.doc_id) / nullif(count(*), 0)), 0) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def embedding_coverage(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1)), "doc_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("has").alias("with_embedding")).withColumn("coverage", F.coalesce(F.round(F.try_divide(F.col("with_embedding") * F.lit(100.0), F.col("total"))), F.lit(0.0)))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def scope_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def lru_evict_per_user(spark, sf_dir):
    return memory.keep_newest(table(spark, sf_dir, "events"), 20, by=["user_id"], order="ts", id_col="event_id").select("event_id", "user_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def lru_evict(spark, sf_dir):
    return memory.keep_newest(table(spark, sf_dir, "events").select("event_id", "ts"), 1000, order="ts", id_col="event_id").select("event_id")


@query("SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR >= TIMESTAMP '2024-01-20'")
def ttl_expire(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return memory.unexpired(e, AS_OF, created="ts", hours=24).select("event_id")


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def audit_purge(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return memory.since(e, AS_OF, ts="ts", days=7).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE user_id <> 7")
def forget_user(spark, sf_dir):
    return memory.forget_user({"events": table(spark, sf_dir, "events")}, 7)["events"].select("event_id")


@query(f"SELECT id::BIGINT AS id FROM {fixtures.FACTS_SQL} WHERE NOT (scope = 'session' AND session_id = 's1')")
def session_cleanup(spark, sf_dir):
    return memory.clean_session(fixtures.facts(spark), "s1").select("id")


@query(f"SELECT id::BIGINT AS id, CASE id WHEN 1 THEN 'new text' ELSE value END AS value, CASE id WHEN 3 THEN 'decision' ELSE category END AS category, sha256(CASE id WHEN 1 THEN 'new text' ELSE value END) AS content_hash FROM {fixtures.FACTS_SQL} WHERE id <> 9")
def fact_update_delete(spark, sf_dir):
    changes = spark.createDataFrame([("u1", 1, "old text", None, datetime(2024, 2, 1)), ("u1", 1, "new text", None, datetime(2024, 2, 2)), ("u1", 3, None, "decision", datetime(2024, 2, 1)), ("u2", 4, "not mine", None, datetime(2024, 2, 1))], "user_id string, id long, value string, category string, ts timestamp")
    gone = spark.createDataFrame([("u2", 9), ("u2", 5)], "user_id string, id long")
    return memory.delete_facts(memory.update_facts(fixtures.facts(spark), changes), gone).select("id", "value", "category", "content_hash")


@query("SELECT event_id AS id, greatest(ts, coalesce(t, ts)) AS last_accessed_at FROM events LEFT JOIN (SELECT o_orderkey AS event_id, max(o_orderdate) + INTERVAL 30 YEAR AS t FROM orders GROUP BY 1) USING (event_id)")
def touch_fold(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("last_accessed_at"))
    touched = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), (F.col("o_orderdate").cast("timestamp") + F.make_ym_interval(F.lit(30))).alias("ts"))
    return memory.fold_touches(f, touched)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    return memory.cascade(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), child_key="l_orderkey", parent_key="o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT sha256(text)[:16] AS content_hash, 'tr_' || sha256(text)[:8] AS result_id, ceil(length(text) / 4.0)::BIGINT AS token_count, min(doc_id) AS first_writer, count(*) AS writes FROM documents GROUP BY text")
def content_hash_dedup(spark, sf_dir):
    return results.save(table(spark, sf_dir, "documents"), order="doc_id")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def content_exists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = results.save(d.where("doc_id % 2 = 0"), order="doc_id")
    return results.exists(d, stored).select("doc_id")


@query("SELECT content_hash, min(vec_id) AS vec_id FROM (SELECT vec_id, label::VARCHAR AS content_hash FROM embeddings) GROUP BY content_hash")
def embedding_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("content_hash"), "vec_id", (-F.col("vec_id")).alias("created_at"))
    return tables.upsert_embeddings(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")).select("content_hash", "vec_id")


@query("SELECT count(*) AS results, sum(ceil(length(text) / 4.0)::BIGINT)::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, count(*) FILTER (doc_id % 3 = 0) AS accessed FROM documents")
def store_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(text.estimate_tokens(F.col("text")).alias("token_count"), F.col("text").alias("full_result"), F.lit(0).alias("created_at"), (F.col("doc_id") % 3 == 0).cast("int").alias("accessed_at"))
    return results.stats(d)


@query("SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END AS content FROM documents WHERE length(text) >= 10 AND doc_id % 2 = 1")
def index_skip_existing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tables.index_rows(d, d.where("doc_id % 2 = 0"), id_col="doc_id", text="text")


@query("""SELECT doc_id, i AS chunk_idx, (i * 1800)::BIGINT AS start_offset, least(i * 1800 + 2000, length(text))::BIGINT AS end_offset, sha256(substr(text, (i * 1800 + 1)::BIGINT, 2000)) AS hash
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 2000 THEN 1 ELSE ceil((length(text) - 2000) / 1800.0)::BIGINT + 1 END)) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.inline(results.fixed_chunks(F.col("text"))))
    return c.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), F.sha2("chunk_text", 256).alias("hash"))


@query("""SELECT vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings WHERE score >= 0.2 ORDER BY score DESC, chunk_id LIMIT 20""")
def chunk_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    s = e.join(F.broadcast(q)).select(F.col("vec_id").alias("chunk_id"), F.round(vector.cosine(F.col("embedding"), F.col("q")), 5).alias("score"))  # one stated query
    return s.where("score >= 0.2").orderBy(F.desc("score"), "chunk_id").limit(20)


_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"WITH {_LINES}, m AS (SELECT *, contains(lower(content), 'license') AS is_match FROM lines) SELECT doc_id, line::BIGINT AS line, content, is_match FROM m QUALIFY max(is_match) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def line_search_context(spark, sf_dir):
    return results.search_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "LICENSE", keys=["doc_id"])


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER (contains(lower(content), 'license')) AS match_count, array_to_string(coalesce(list(line ORDER BY line) FILTER (contains(lower(content), 'license')), [])[1:10], ',') AS matches FROM lines GROUP BY doc_id")
def line_search_summary(spark, sf_dir):
    s = results.search_summary(table(spark, sf_dir, "documents"), "license", keys=["doc_id"])
    return s.select("doc_id", "match_count", F.array_join(F.col("matches").cast("array<string>"), ",").alias("matches"))


@query(f"WITH {_LINES} SELECT doc_id, trim(string_agg(line || ': ' || content, chr(10) ORDER BY line)) AS content FROM lines WHERE line BETWEEN 2 AND 4 GROUP BY doc_id")
def line_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = d.select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"), text.line_range(F.col("text"), 2, 4, 25000).alias("content"))
    return out.where("n >= 2").select("doc_id", "content")


@query(f"WITH {_LINES} SELECT doc_id, line::BIGINT AS line, content FROM lines WHERE line BETWEEN 1 AND 8")
def around_line(spark, sf_dir):
    return results.around_line(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, keys=["doc_id"])


@query("""SELECT doc_id, sha256(CASE WHEN length(text) <= 4000 THEN text WHEN contains(substr(text, 1, 4000), chr(10)) AND 4000 - instr(reverse(substr(text, 1, 4000)), chr(10)) > 3200
 THEN substr(text, 1, 4000 - instr(reverse(substr(text, 1, 4000)), chr(10))) || chr(10) || chr(10) || '... [content truncated, use mode="lines" for specific ranges]' ELSE substr(text, 1, 4000) || chr(10) || chr(10) || '... [content truncated]' END) AS hash FROM documents""")
def full_retrieval(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.full_within(F.col("text"), 1000), 256).alias("hash"))


@query("""SELECT page_id, CASE WHEN starts_with(html, '{') OR starts_with(html, '[') THEN 'json' WHEN contains(html, '<!DOCTYPE') OR contains(html, '<html') THEN 'html' WHEN contains(html, 'import ') OR contains(html, 'export ') THEN 'javascript'
 WHEN contains(html, 'def ') THEN 'python' WHEN contains(html, 'package ') OR contains(html, 'func ') THEN 'go' ELSE 'text' END AS kind, len(string_split(html, chr(10)))::BIGINT AS lines FROM pages""")
def file_type_heuristic(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", previews.file_type(F.col("html")).alias("kind"), previews.line_count(F.col("html")).alias("lines"))


@query(r"SELECT page_id, coalesce(nullif(substr(regexp_extract(html, '(?m)^#[ \t]+(.+)$', 1), 1, 60), ''), 'Article/page content') AS title, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS html_title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", previews.web_title(F.col("html")).alias("title"), F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1).alias("html_title"))


@query("""SELECT doc_id, lang, ceil(length(text) / 4.0)::BIGINT > CASE lang WHEN 'en' THEN 1500 WHEN 'de' THEN 2500 ELSE 2000 END AS large FROM documents""")
def size_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tool = F.when(F.col("lang") == "en", "exec").when(F.col("lang") == "de", "Read").otherwise("other")
    return d.select("doc_id", "lang", previews.is_large(tool, F.col("text")).alias("large"))


def _stored_sql(text: str, clock: str, tool: str = "other", about: str | None = None, preview: str | None = None) -> str:
    """The stored form of a result, in SQL."""
    nl, rid = "chr(10)", f"'tr_' || sha256({text})[:8]"
    options = "".join(f"\n   • {t}" for t in render.TIPS.get(tool, render.DEFAULT_TIPS)).replace("'", "''")
    label = render.LABELS[tool] if tool in render.TIPS else render.DEFAULT_LABEL
    about = about or f"len(string_split({text}, {nl})) || ' lines'"
    preview = preview or f"substr({text}, 1, 1600)"
    return f"""('[STORED: ' || {rid} || ']' || {nl} || {nl} || '📄 {label}' || {nl} || '📊 Size: ~' || format('{{:,}}', ceil(length({text}) / 4.0)::BIGINT) || ' tokens' || {nl} || '📋 ' || {about} || {nl} || '🕐 ' || {clock}
 || {nl} || {nl} || '--- PREVIEW ---' || {nl} || trim({preview}, ' ' || chr(10) || chr(9) || chr(13)) || {nl} || '--- END PREVIEW ---' || {nl} || {nl} || '💡 Retrieve full content with: retrieve_tool_result(result_id="' || {rid} || '")' || {nl} || '   Options:{options}')"""


@query(f"""WITH t AS (SELECT ceil(length(text) / 4.0)::BIGINT AS k, {_stored_sql('text', "''")} AS shown FROM documents), s AS (SELECT k, k > 2000 AS large, CASE WHEN k > 2000 THEN ceil(length(shown) / 4.0)::BIGINT ELSE k END AS o FROM t)
SELECT large, count(*) AS n, sum(k)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out FROM s GROUP BY large""")
def result_processor(spark, sf_dir):
    p = results.process(table(spark, sf_dir, "documents").select(F.lit("other").alias("tool_name"), "text"))
    return p.groupBy(F.col("is_large").alias("large")).agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("SELECT 1::BIGINT AS id, 'link:3 button:2 heading:1' AS summary")
def preview_elements(spark, sf_dir):
    d = spark.createDataFrame([(1, "- link a\n  - Button b\n- link\n- LINK c\n - heading x\n- button")], "id long, t string")
    return d.select("id", render.element_counts(F.col("t")).alias("summary"))


_FACTS_OUT = [(1, "likes tea", "preference", 0.9, "said so"), (2, "uses vim", "system", 0.8, extraction.DEFAULT_CONTEXT), (3, "bare", "personal", 1.0, extraction.DEFAULT_CONTEXT), (4, "one", "error_pattern", 0.5, "c"), (4, "two", "project", 0.25, extraction.DEFAULT_CONTEXT), (7, "l" * 197 + "...", "decision", 0.0, extraction.DEFAULT_CONTEXT)]


@query("SELECT id::BIGINT AS id, fact, category, confidence::DOUBLE AS confidence, source_context FROM " + fixtures.values(_FACTS_OUT, "id, fact, category, confidence, source_context"))
def json_fact_coerce(spark, sf_dir):
    return fixtures.responses(spark).select("id", F.inline(extraction.valid_facts(extraction.parse(F.col("response"))["facts"])))


@query("SELECT 1::BIGINT AS id, 'tea' AS topic, 'about tea' AS content, 'cup' AS entities, 'kitchen' AS projects")
def json_summary_coerce(spark, sf_dir):
    s = fixtures.responses(spark).select("id", extraction.valid_summary(extraction.parse(F.col("response"))["summary"]).alias("s")).where("s is not null")
    return s.select("id", "s.topic", "s.content", F.array_join("s.entities", ",").alias("entities"), F.array_join("s.projects", ",").alias("projects"))


@query(r"""SELECT event_id, regexp_extract(props, '"([a-z_]+)"\s*:', 1) AS k, (json_extract_string(props, '$.' || regexp_extract(props, '"([a-z_]+)"\s*:', 1))) AS v FROM events""")
def json_props(spark, sf_dir):
    key = F.regexp_extract("props", r'"([a-z_]+)"\s*:', 1)
    return table(spark, sf_dir, "events").select("event_id", key.alias("k"), F.expr("get_json_object(props, '$.' || regexp_extract(props, '\"([a-z_]+)\"\\\\s*:', 1))").alias("v"))


_REPAIRED = [(4, "one"), (4, "two")]


@query("SELECT id::BIGINT AS id, fact FROM " + fixtures.values(_REPAIRED, "id, fact"))
def json_repair(spark, sf_dir):
    r = fixtures.responses(spark).where("id IN (4, 5)")
    return r.select("id", F.explode(extraction.repaired(F.col("response"))).alias("f")).select("id", "f.fact")


def _candidates(spark):
    f = fixtures.facts(spark).withColumn("embedding", F.lit(None).cast("array<float>"))
    new = spark.createDataFrame([("u1", 101, "project", "builds a search engine in spark and sql", 0.75), ("u1", 102, "preference", "prefers vim", 0.5), ("u2", 103, "project", "builds a search engine", 0.9), ("u1", 104, "system", "database is postgres", 0.95)], "user_id string, id long, category string, value string, confidence double")
    return new.withColumn("embedding", F.lit(None).cast("array<float>")), f


_NEW = "(VALUES ('u1', 101, 'project', 'builds a search engine in spark and sql', 0.75), ('u1', 102, 'preference', 'prefers vim', 0.5), ('u2', 103, 'project', 'builds a search engine', 0.9), ('u1', 104, 'system', 'database is postgres', 0.95)) AS n(user_id, nid, category, nvalue, nconf)"
_CONFLICTS = f"c AS (SELECT n.*, t.id AS old_id, t.value, t.confidence FROM {_NEW} JOIN {fixtures.FACTS_SQL} USING (user_id, category) WHERE contains(lower(nvalue), lower(value)) OR contains(lower(value), lower(nvalue)) QUALIFY row_number() OVER (PARTITION BY nid ORDER BY id) = 1)"


@query(f"WITH {_CONFLICTS} SELECT nid::BIGINT AS id, old_id::BIGINT AS old_id FROM c")
def conflict_candidates(spark, sf_dir):
    new, old = _candidates(spark)
    return extract.conflicts(new, old).select("id", "old_id")


@query(f"""WITH {_CONFLICTS} SELECT nid::BIGINT AS id, CASE WHEN old_id IS NULL THEN 'add' WHEN nconf > confidence THEN 'update' ELSE 'keep' END AS action, CASE WHEN old_id IS NULL OR nconf > confidence THEN nvalue ELSE value END AS value FROM (SELECT n.nid, n.nvalue, n.nconf, c.old_id, c.value, c.confidence FROM {_NEW} LEFT JOIN c USING (nid))""")
def conflict_resolve(spark, sf_dir):
    new, old = _candidates(spark)
    return extract.resolve(new, old).select("id", "action", "value")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS entities FROM orders GROUP BY o_custkey")
def entity_union(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("e"))
    return g.select("o_custkey", F.array_join("e", ",").alias("entities"))


_OK = "(CASE WHEN b.type = 'tool_use' THEN coalesce(b.name, '') <> '' AND coalesce(regexp_full_match(b.id, '[a-zA-Z0-9_-]+'), false) WHEN b.type = 'tool_result' THEN coalesce(regexp_full_match(b.tool_use_id, '[a-zA-Z0-9_-]+'), false) AND b.content IS NOT NULL ELSE true END)"


@query(f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role IS NOT NULL AND len(list_filter(content, lambda b: NOT {_OK})) = 0 AS valid, len(list_filter(content, lambda b: {_OK}))::BIGINT AS kept FROM {fixtures.MESSAGES_SQL}")
def validate_messages(spark, sf_dir):
    return fixtures.messages(spark).select("conv_id", "turn", messages.valid_message(F.col("role"), F.col("content")).alias("valid"), F.size(F.filter("content", messages.valid_block)).cast("long").alias("kept"))


@query(f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, len(list_filter(content, lambda b: {_OK}))::BIGINT AS blocks FROM {fixtures.MESSAGES_SQL} WHERE role IS NOT NULL AND len(list_filter(content, lambda b: {_OK})) > 0")
def sanitise_messages(spark, sf_dir):
    return messages.sanitise(fixtures.messages(spark)).select("conv_id", "turn", F.size("content").cast("long").alias("blocks"))


@query(f"""WITH x AS (SELECT unnest(content) AS b FROM {fixtures.MESSAGES_SQL}), f AS (SELECT b.type AS type, coalesce(b.name, '') = '' AS nameless, NOT coalesce(regexp_full_match(b.id, '[a-zA-Z0-9_-]+'), false) AS bad, NOT coalesce(regexp_full_match(b.tool_use_id, '[a-zA-Z0-9_-]+'), false) AS badr, b.content IS NULL AS nul FROM x),
c AS (SELECT count(*) FILTER (type = 'tool_use' AND nameless) AS tool_use_missing_name, count(*) FILTER (type = 'tool_use' AND NOT nameless AND bad) AS tool_use_invalid_id, count(*) FILTER (type = 'tool_result' AND badr) AS tool_result_invalid_id, count(*) FILTER (type = 'tool_result' AND NOT badr AND nul) AS tool_result_missing_content FROM f)
SELECT *, tool_use_missing_name + tool_use_invalid_id + tool_result_invalid_id + tool_result_missing_content AS total FROM c""")
def invalid_block_counts(spark, sf_dir):
    return messages.invalid_blocks(fixtures.messages(spark))


@query(f"SELECT b.type AS type, count(*) AS n FROM (SELECT unnest(content) AS b FROM {fixtures.MESSAGES_SQL}) GROUP BY 1")
def block_type_counts(spark, sf_dir):
    return messages.block_types(fixtures.messages(spark))


@query(f"""SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, array_to_string(list_filter(list_transform(content, lambda b: CASE WHEN b.type = 'text' THEN b.text WHEN b.type = 'tool_result' THEN '[Tool result: ' || substr(coalesce(b.content, ''), 1, 500) || '...]' ELSE '' END), lambda t: t <> ''), chr(10)) AS text,
len(list_filter(content, lambda b: b.type <> 'text')) > 0 AS has_tools FROM {fixtures.MESSAGES_SQL}""")
def message_texts(spark, sf_dir):
    return fixtures.messages(spark).select("conv_id", "turn", messages.message_text(F.col("content")).alias("text"), messages.has_tool_calls(F.col("content")).alias("has_tools"))


@query(f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn FROM {fixtures.MESSAGES_SQL} WHERE len(list_filter(content, lambda b: b.type = 'text')) > 0")
def strip_tool_blocks(spark, sf_dir):
    return messages.strip_tools(fixtures.messages(spark)).select("conv_id", "turn")


@query(f"SELECT conv_id::BIGINT AS conv_id, b.tool_use_id AS tool_call_id, coalesce(b.content, '') AS text FROM (SELECT conv_id, unnest(content) AS b FROM {fixtures.MESSAGES_SQL}) WHERE b.type = 'tool_result'")
def tool_result_rows(spark, sf_dir):
    return messages.tool_results(fixtures.messages(spark), keys=["conv_id"])


_CHAINS = [(1, 0, 0, "single"), (1, 1, 1, "single"), (1, 2, 2, "tool-chain"), (1, 3, 2, "tool-chain"), (1, 4, 2, "tool-chain"), (1, 5, 5, "single"), (2, 0, 0, "tool-chain"), (2, 1, 0, "tool-chain"), (2, 2, 2, "single"), (2, 3, 3, "single"), (2, 4, 4, "tool-chain"), (2, 5, 5, "tool-chain"), (2, 6, 5, "tool-chain"), (3, 0, 0, "single"), (3, 1, 1, "single"), (4, 0, 0, "tool-chain"), (4, 1, 1, "tool-chain"), (4, 2, 1, "tool-chain"), (5, 0, 0, "single"), (5, 1, 1, "single")]


@query("SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, group_id::BIGINT AS group_id, kind FROM " + fixtures.values(_CHAINS, "conv_id, turn, group_id, kind"))
def tool_chain_groups(spark, sf_dir):
    return messages.tool_chains(fixtures.messages(spark))


_EXTRACTABLE = "role IN ('user', 'assistant') AND length(trim(text)) >= 10"


@query(f"WITH r AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 5)::BIGINT AS batch FROM conversations WHERE {_EXTRACTABLE}) SELECT conv_id, batch, count(*) AS n, min(turn) AS first_turn, max(turn) AS last_turn FROM r GROUP BY ALL")
def extract_batches(spark, sf_dir):
    return extract.batches(table(spark, sf_dir, "conversations"))


@query(f"""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8), e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM l WHERE {_EXTRACTABLE})
SELECT conv_id, string_agg('[' || i || '] ' || upper(role) || ': ' || substr(text, 1, 500), chr(10) ORDER BY turn) AS prompt FROM e GROUP BY conv_id HAVING bool_or(role = 'user')""")
def extraction_prompts(spark, sf_dir):
    return extract.prompt_texts(table(spark, sf_dir, "conversations"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def audit_windows(spark, sf_dir):
    return triggers.audit_windows(table(spark, sf_dir, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return triggers.sessions(table(spark, sf_dir, "events"))


@query("SELECT conv_id, turn, coalesce(max(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING), false) AS expanded FROM conversations")
def thread_context_expand(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = threads.single_thread(c).join(c.select("conv_id", "turn", (F.col("role") == "system").alias("hit")), ["conv_id", "turn"])
    return threads.expand(t, "hit").select("conv_id", "turn", "expanded")


@query()
def thread_detect(spark, sf_dir):
    """Without SQL: a topic follows from all messages before. Tested against a plain version."""
    return threads.detect(table(spark, sf_dir, "conversations"), similarity=0.3).select("conv_id", "turn", "thread_id")


@query("SELECT conv_id, -1::BIGINT AS turn, 'system' AS role FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, turn, role FROM conversations")
def context_injection(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return memory.inject(c, c.select("conv_id").distinct().withColumn("text", F.lit("## Context"))).select("conv_id", "turn", "role")


@query("SELECT id::BIGINT AS id, family FROM (VALUES (1, 'kimi'), (2, 'anthropic'), (3, 'gemini'), (4, 'default'), (5, 'default'), (6, 'kimi')) AS t(id, family)")
def model_families(spark, sf_dir):
    d = spark.createDataFrame([(1, "Kimi-K2"), (2, "vendor/anthropic-large"), (3, "google/x"), (4, "llama"), (5, None), (6, "fireworks/kimi")], "id long, m string")
    return d.select("id", text.model_family(F.col("m")).alias("family"))


@query("SELECT round(avg(o_totalprice), 2) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS hit_rate FROM orders")
def metrics_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.count("*").alias("n"), F.round(F.try_divide(F.count_if(F.col("o_orderstatus") == "F") * F.lit(100.0), F.count("*")), 4).alias("hit_rate"))
