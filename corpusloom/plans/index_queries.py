"""The persisted index: built over one state of the corpus, carried through three changes, and searched."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import vocab as V
from corpusloom.operators import index as IX
from corpusloom.operators import lexical as L
from corpusloom.plans import fixtures as X
from corpusloom.plans.lexical_queries import POSTINGS_SQL, TERM_STATS_SQL, bm25_sql
from corpusloom.plans.registry import query
from corpusloom.session import ensure_checkpoint_dir


def states(spark, sf):
    """The first corpus, and three changes as (fresh, removed): languages arrive, toxic texts are reworded, bad documents go."""
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_key"), "lang", "text")
    marks = X.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    docs = docs.join(marks.withColumnRenamed("doc_id", "chunk_key"), "chunk_key", "left")
    late = F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))
    plain = lambda d: d.select("chunk_key", "text")
    reworded = docs.where("toxic = 1").withColumn("text", F.concat(F.lit("revised edition "), "text"))
    return plain(docs.where(~late)), [(plain(docs.where(late)), None), (plain(reworded), None), (plain(docs.limit(0)), docs.where("quality = 0").select("chunk_key"))]


AFTER = """documents AS MATERIALIZED (SELECT d.* REPLACE (CASE WHEN toxic = 1 THEN 'revised edition ' || text ELSE text END AS text) FROM documents d
 LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE quality IS DISTINCT FROM 0)"""


def changed_index(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    base, changes = states(spark, sf)
    layers = [IX.write_layer(IX.first_layer(base), f"{root}/0")]
    for i, (fresh, removed) in enumerate(changes, 1):
        layers.append(IX.write_layer(IX.next_layer(layers, fresh, removed), f"{root}/{i}"))
    return layers


@query("index_topk", f"SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM ({bm25_sql(V.TOP_K)})")
def _(spark, sf):
    root = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    layer = IX.write_layer(IX.first_layer(X.corpus(spark, sf)), root)
    r = IX.index_topk([layer], X.queries(spark, sf))
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("index_topk_changed", f"WITH {AFTER} SELECT query_id, chunk_key, round(score, 6) AS score, rank FROM ({bm25_sql(V.TOP_K)})")
def _(spark, sf):
    r = IX.index_topk(changed_index(spark, sf), X.queries(spark, sf))
    return r.select("query_id", "chunk_key", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@query("index_statistics", f"WITH {AFTER} SELECT term, df, round(idf, 6) AS idf FROM ({TERM_STATS_SQL})")
def _(spark, sf):
    return L.term_stats(IX.vocabulary(changed_index(spark, sf))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("index_forward", f"WITH {AFTER} SELECT chunk_key, dl, count(*) AS n_terms, max(tf) AS max_tf FROM ({POSTINGS_SQL}) GROUP BY ALL")
def _(spark, sf):
    f = IX.live_forward(changed_index(spark, sf)).where("dl > 0")
    return f.select("chunk_key", "dl", F.size("counts").cast("bigint").alias("n_terms"), F.array_max(F.map_values("counts")).cast("bigint").alias("max_tf"))
