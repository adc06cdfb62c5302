"""Vector search queries: label centroids against every embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import lexical as L
from corpusloom.operators import vectors as VX
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans import lexical_queries as LQ
from corpusloom.plans.registry import query


def vector_queries(spark, sf):
    return VX.centroids(X.table(spark, sf, "embeddings"), "label", "embedding").withColumn(
        "query_id", F.col("query_id").cast("bigint"))


def vector_corpus(spark, sf):
    return X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")


CENTROID_SQL = """SELECT label::BIGINT AS query_id, list(v ORDER BY dim) AS vector FROM (
 SELECT label, dim, avg(v::DOUBLE) AS v FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim) GROUP BY label"""
VECTOR_TOPK_SQL = f"""SELECT * FROM (SELECT query_id, chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank
 FROM (SELECT query_id, vec_id AS chunk_key, list_cosine_similarity(vector, embedding::DOUBLE[]) AS score FROM ({CENTROID_SQL}), embeddings)) WHERE rank <= 10"""


@query("vector_topk", f"SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM ({VECTOR_TOPK_SQL})")
def _(spark, sf):
    r = VX.vector_topk(vector_queries(spark, sf), vector_corpus(spark, sf))
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


ANN_SQL = """SELECT * FROM (SELECT query_id, chunk_key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_key) AS rank
 FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_key, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""


@query("vector_topk_ann", f"SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM ({ANN_SQL})")
def _(spark, sf):
    """Every row with an id divisible by 20 against all rows."""
    e = X.table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    r = VX.vector_topk_ann(asked, vector_corpus(spark, sf))
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("embed_batch")
def _(spark, sf):
    e = VX.embed_batch(X.corpus(spark, sf), "chunk_key", "text")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return e.select("chunk_key", F.size("embedding").cast("bigint").alias("dim"), F.round(size, 4).alias("norm"))


def bm25_pairs(spark, sf):
    c, q = X.corpus(spark, sf), X.queries(spark, sf)
    from corpusloom.operators.fusion import with_text

    return with_text(L.bm25_topk(c, q), c, q)


def pair_score_sql(q: str, t: str) -> str:
    qt = D.meaningful(q)
    return f"CASE WHEN len({qt}) > 0 THEN len(list_intersect({qt}, {D.meaningful(f'left({t}, 3000)')}))::DOUBLE / len({qt}) ELSE 0 END"


@query(
    "rescore_pairs",
    f"""SELECT query_id, chunk_key, round(rescore, 6) AS rescore, row_number() OVER (PARTITION BY query_id ORDER BY round(rescore, 9) DESC, rank, chunk_key) AS rank
 FROM (SELECT query_id, chunk_key, rank, {pair_score_sql('query', 'text')} AS rescore FROM ({LQ.bm25_sql(10)}) JOIN ({X.QUERIES_SQL}) USING (query_id) JOIN ({X.CORPUS_SQL}) USING (chunk_key))""",
)
def _(spark, sf):
    r = VX.rescore_pairs(bm25_pairs(spark, sf))
    return r.select("query_id", "chunk_key", F.round("rescore", 6).alias("rescore"), F.col("rank").cast("bigint"))
