"""Lexical index and search queries: every benchmark text against every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators import lexical as L
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query


def titled(spark, sf):
    """Chunks whose title is the file key and the first line."""
    return X.corpus(spark, sf).withColumn("title", F.concat_ws(" ", "file_key", T.first_line("text")))


TITLED_SQL = f"SELECT *, file_key || ' ' || {D.first_line('text')} AS title FROM ({X.CORPUS_SQL})"

POSTINGS_SQL = f"""SELECT term, chunk_key, count(*) AS tf, dl FROM (SELECT chunk_key, len(t) AS dl, unnest(t) AS term
 FROM (SELECT chunk_key, {D.tokens('text')} AS t FROM ({X.CORPUS_SQL}))) GROUP BY ALL"""


@query("build_postings", POSTINGS_SQL)
def _(spark, sf):
    return L.build_postings(X.corpus(spark, sf))


TERM_STATS_SQL = f"""SELECT term, df, CASE WHEN raw < 0 THEN {V.BM25_EPSILON} * avg(raw) OVER () ELSE raw END AS idf FROM (
 SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM (
 SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) GROUP BY term))"""


@query("term_stats", f"SELECT term, df, round(idf, 6) AS idf FROM ({TERM_STATS_SQL})")
def _(spark, sf):
    return L.term_stats(L.vocabulary(X.corpus(spark, sf))).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_sql(k: int, queries: str = X.QUERIES_SQL) -> str:
    k1, b = V.BM25_K1, V.BM25_B
    return f"""SELECT * FROM (SELECT query_id, chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank FROM (
 SELECT query_id, chunk_key, sum(qf * idf * tf * {k1 + 1} / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))) AS score
 FROM (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({D.tokens('query')}) AS term FROM ({queries})) GROUP BY ALL)
 JOIN ({POSTINGS_SQL}) USING (term) JOIN ({TERM_STATS_SQL}) USING (term),
 (SELECT avg(len({D.tokens('text')})) AS avgdl FROM documents) GROUP BY query_id, chunk_key)) WHERE rank <= {k}"""


@query("bm25_topk", f"SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM ({bm25_sql(V.TOP_K)})")
def _(spark, sf):
    r = L.bm25_topk(X.corpus(spark, sf), X.queries(spark, sf))
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query(
    "bm25_topk_padded",
    f"""WITH top AS (SELECT * FROM ({bm25_sql(V.TOP_K)}) WHERE query_id % 3 <> 0),
 n AS (SELECT q.query_id, count(t.chunk_key) AS n FROM ({X.QUERIES_SQL}) q LEFT JOIN top t USING (query_id) GROUP BY 1),
 pad AS (SELECT query_id, chunk_key, n, row_number() OVER (PARTITION BY query_id ORDER BY chunk_key) AS r FROM n, ({X.CORPUS_SQL}) c
  WHERE n < {V.TOP_K} AND NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = n.query_id AND t.chunk_key = c.chunk_key))
 SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM top UNION ALL SELECT query_id, chunk_key, 0.0, n + r FROM pad WHERE n + r <= {V.TOP_K}""",
)
def _(spark, sf):
    """A third of the questions have words that no chunk has."""
    q = X.queries(spark, sf).withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("qqzz zz"), F.col("query_id"))).otherwise(F.col("query")))
    r = L.bm25_topk(X.corpus(spark, sf), q, pad=True)
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


def coverage_sql(k: int, min_score: float, queries: str = X.QUERIES_SQL) -> str:
    qt = f"SELECT query_id, len(t) AS n, unnest(t) AS token FROM (SELECT query_id, {D.meaningful('query')} AS t FROM ({queries}))"
    ct = f"""SELECT chunk_key, token, max(b) AS b, max(h) AS h FROM (
 SELECT chunk_key, unnest({D.meaningful('text')}) AS token, 1 AS b, 0 AS h FROM ({TITLED_SQL}) UNION ALL
 SELECT chunk_key, unnest({D.meaningful('title')}) AS token, 0 AS b, 1 AS h FROM ({TITLED_SQL})) GROUP BY ALL"""
    g = f"SELECT query_id, chunk_key, n, count(*) AS matched, sum(b) AS body, sum(h) AS title_hits FROM ({qt}) JOIN ({ct}) USING (token) GROUP BY ALL"
    s = f"SELECT *, CASE WHEN n = 1 THEN greatest(r, 0.55) ELSE r END AS score FROM (SELECT *, (matched/n*0.68 + body/n*0.22 + title_hits/n*0.10)::DOUBLE AS r FROM ({g}))"
    return f"""SELECT query_id, chunk_key, matched::BIGINT AS matched, body::BIGINT AS body, title_hits::BIGINT AS title_hits, score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, matched DESC, title_hits DESC, chunk_key) AS rank
 FROM ({s}) WHERE (n < 3 OR matched >= 2) AND (n > 1 OR title_hits > 0) AND score >= {min_score}) WHERE rank <= {k}"""


@query(
    "coverage_topk",
    f"SELECT query_id, chunk_key, matched, body, title_hits, round(score, 6) AS score, rank FROM ({coverage_sql(V.COVERAGE_TOP_K, V.COVERAGE_MIN_SCORE)})",
)
def _(spark, sf):
    r = L.coverage_topk(titled(spark, sf), X.queries(spark, sf))
    return r.select(
        "query_id", "chunk_key", "matched", "body", "title_hits", F.round("score", 6).alias("score"),
        F.col("rank").cast("bigint"),
    )


def question_texts(spark, sf):
    return X.questions(spark, sf).select(F.col("question_id").alias("query_id"), F.col("question").alias("query"))


QUESTION_TEXTS_SQL = f"SELECT question_id AS query_id, question AS query FROM ({X.QUESTIONS_SQL})"


@query(
    "token_presence",
    f"""SELECT query_id, token, token IN (SELECT DISTINCT unnest(list_concat({D.meaningful('text')}, {D.meaningful('title')})) FROM ({TITLED_SQL})) AS present
 FROM (SELECT query_id, unnest({D.meaningful('query')}) AS token FROM ({QUESTION_TEXTS_SQL}))""",
)
def _(spark, sf):
    return L.token_presence(titled(spark, sf), question_texts(spark, sf))


_PRF_WORDS = f"""SELECT query_id, rank, w, generate_subscripts(ws, 1) AS pos FROM (SELECT query_id, rank, ws, unnest(ws) AS w FROM (SELECT query_id, rank,
 string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM ({bm25_sql(3)}) JOIN ({X.CORPUS_SQL}) USING (chunk_key)))"""
_PRF_WORDS = f"""SELECT query_id, rank, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT query_id, rank,
 string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM ({bm25_sql(3)}) JOIN ({X.CORPUS_SQL}) USING (chunk_key))"""


@query(
    "prf_expand",
    f"""SELECT q.query_id, concat_ws(' ', q.query, coalesce(t.terms, '')) AS expanded FROM ({X.QUERIES_SQL}) q LEFT JOIN (
 SELECT query_id, string_agg(w, ' ' ORDER BY r) AS terms FROM (SELECT query_id, w, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS r FROM (
 SELECT query_id, w, count(*) AS n, min(rank * 10000000 + pos) AS f FROM ({_PRF_WORDS})
 WHERE regexp_matches(w, '^[a-z]{{4,}}$') AND w NOT IN {D.words(V.FEEDBACK_STOP_WORDS)} GROUP BY ALL)) WHERE r <= 5 GROUP BY query_id) t USING (query_id)""",
)
def _(spark, sf):
    c, q = X.corpus(spark, sf), X.queries(spark, sf)
    return L.prf_expand(c, q, L.bm25_topk(c, q, 3))
