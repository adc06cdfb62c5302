"""Index statistics and lexical search over a chunk table.

Inputs are tables: ``chunks(chunk_key, text, ...)`` and ``queries(query_id, query)``.
``chunk_key`` is also the corpus order used to break ties.  Texts never travel through a
shuffle: tokens are filtered against the query terms inside the scan stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators.products import best_products, plain_keys
from corpusloom.operators.scale import bounded_batches, computed_once, fits, join_lookup, materialized, top_k_per
from corpusloom.operators.words import counted, covered, seen


def score_order(score: str, *ties: str) -> list[Column]:
    """Descending score (rounded so summation order cannot flip ranks), then ascending ties."""
    return [F.round(score, 9).desc(), *[F.col(t).asc() for t in ties]]


def _token_rows(chunks: DataFrame) -> DataFrame:
    """``chunk_key, dl, term``.

    The length is its own step, otherwise every exploded row would carry the token array;
    ``computed_once`` keeps the inferred not-empty filter from tokenising a second time.
    """
    t = chunks.select("chunk_key", computed_once(T.tokenize("text")).alias("t")).withColumn("dl", F.size("t").cast("bigint"))
    return t.select("chunk_key", "dl", F.explode("t").alias("term"))


def term_counts(chunks: DataFrame) -> DataFrame:
    """``chunk_key, dl, counts``: the terms of each chunk with their counts, made inside the scan; null texts are no chunks."""
    kind = chunks.schema["chunk_key"].dataType.simpleString()
    return bounded_batches(chunks).where("text is not null").select("chunk_key", "text").mapInArrow(counted, f"chunk_key {kind}, dl long, counts map<string,int>")


def build_postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_key, tf, dl``; map-side combine collapses each chunk's tokens before the shuffle."""
    rows = _token_rows(chunks)
    return rows.groupBy("term", "chunk_key", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "chunk_key", "tf", "dl")


_CORPUS = ""  # the vocabulary row that counts chunks and tokens


def vocabulary(chunks: DataFrame) -> DataFrame:
    """``term, df, n_tokens``; the row with the empty term holds the chunk and token totals.

    One pass over the texts: everything BM25 needs to know about the corpus comes from
    this table, whose shuffle is reused by the scalar subqueries below.
    """
    t = chunks.select(computed_once(T.tokenize("text")).alias("t")).withColumn("dl", F.size("t").cast("bigint"))
    t = t.withColumn("t", F.array_append(F.array_distinct("t"), F.lit(_CORPUS))).select("dl", F.explode("t").alias("term"))
    own = F.when(F.col("term") == _CORPUS, F.col("dl")).otherwise(0)
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(own).alias("n_tokens"))


def _total(vocab: DataFrame, value: Column) -> Column:
    return vocab.agg(F.max(F.when(F.col("term") == _CORPUS, value)).alias("v")).scalar()


def average_length(vocab: DataFrame) -> Column:
    """Mean tokens per chunk, as a scalar subquery."""
    return _total(vocab, F.col("n_tokens") / F.col("df"))


def term_stats(vocab: DataFrame) -> DataFrame:
    """``term, df, idf``; negative idf is replaced by a quarter of the vocabulary's mean idf."""
    n = _total(vocab, F.col("df"))
    raw = vocab.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    is_term = F.col("term") != _CORPUS
    floor = raw.agg((F.avg(F.when(is_term, F.col("raw"))) * V.BM25_EPSILON).alias("f")).scalar()
    return raw.where(is_term).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, term, qf``: repeated query tokens count repeatedly."""
    t = queries.select("query_id", F.explode(T.tokenize("query")).alias("term"))
    return t.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_key, score`` for every chunk sharing a token with the query.

    Pass a stored ``vocab`` to skip the statistics pass.
    """
    qt = query_terms(queries)
    small = fits(qt)
    v = vocabulary(chunks) if vocab is None else vocab
    idf = term_stats(v)
    # A plain inner join: a semi join would be pushed below the vocabulary's aggregation
    # and the statistics subqueries could no longer share its shuffle.
    weights = idf.join(F.broadcast(qt) if small else qt, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("w"))
    hits = _token_rows(chunks)
    if small:
        hits = hits.join(F.broadcast(qt.select("term").distinct()), "term", "left_semi")
    # Matched tokens move once, by chunk; counting, weighting and summing then stay in place.
    hits = hits.repartition("chunk_key")
    tf = hits.groupBy("chunk_key", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    k1, b = V.BM25_K1, V.BM25_B
    tf = tf.withColumn("part", F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / average_length(v))))
    joined = join_lookup(tf.select("chunk_key", "term", "part"), weights, ["term"], ["chunk_key"], small)
    return joined.groupBy("query_id", "chunk_key").agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def bm25_topk(chunks: DataFrame, queries: DataFrame, k: int = V.TOP_K, vocab: DataFrame | None = None, pad: bool = False) -> DataFrame:
    """``query_id, chunk_key, score, rank``: the k best matching chunks per query.

    With ``pad`` a query that fewer than k chunks match is filled up with chunks of score 0 by key.
    """
    if plain_keys(chunks):
        forward = materialized(term_counts(chunks))
        top = ranked_counts(forward, queries, materialized(counted_vocabulary(forward)) if vocab is None else vocab, k)
    else:
        top = top_k_per(bm25_scores(chunks, queries, vocab), ["query_id"], score_order("score", "chunk_key"), k, "rank")
    return _padded(top, chunks, queries, k) if pad else top


def counted_vocabulary(forward: DataFrame) -> DataFrame:
    """``vocabulary`` of the chunks whose ``term_counts`` are given."""
    rows = forward.select("dl", F.explode(F.array_append(F.map_keys("counts"), F.lit(_CORPUS))).alias("term"))
    own = F.when(F.col("term") == _CORPUS, F.col("dl")).otherwise(0)
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(own).alias("n_tokens"))


def ranked_counts(forward: DataFrame, queries: DataFrame, vocab: DataFrame, k: int) -> DataFrame:
    """``bm25_topk`` over ``term_counts`` with unique keys: no row per matching pair is made."""
    total = vocab.where(F.col("term") == _CORPUS).first()
    mean = F.lit(total["n_tokens"] / total["df"] if total and total["n_tokens"] else 1.0)
    k1, b = V.BM25_K1, V.BM25_B
    parts = F.transform(F.map_values("counts"), lambda tf: tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / mean)))
    rows = forward.select("chunk_key", F.map_keys("counts").alias("terms"), parts.alias("parts"))
    qt = query_terms(queries)
    weights = term_stats(vocab).join(F.broadcast(qt) if fits(qt) else qt, "term")
    weights = weights.select(F.col("query_id").alias("query"), "term", (F.col("qf") * F.col("idf")).alias("w"))
    found = best_products(rows, weights, k).select(F.col("query").alias("query_id"), "chunk_key", F.col("value").alias("score"))
    return materialized(top_k_per(found, ["query_id"], score_order("score", "chunk_key"), k, "rank"))


def _padded(top: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The 2k smallest keys always hold k that a query with fewer than k matches has not matched."""
    spare = [r[0] for r in chunks.select("chunk_key").distinct().orderBy("chunk_key").limit(2 * k).collect()]
    n = queries.select("query_id").join(top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    short = n.select("query_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    if not spare:
        return top
    extra = short.withColumn("chunk_key", F.explode(F.array(*[F.lit(x) for x in spare])))
    extra = extra.join(top.select("query_id", "chunk_key"), ["query_id", "chunk_key"], "left_anti")
    extra = top_k_per(extra, ["query_id"], [F.col("chunk_key").asc()], k, "r").where(F.col("r") + F.col("n") <= k)
    return top.unionByName(extra.select("query_id", "chunk_key", F.lit(0.0).alias("score"), (F.col("r") + F.col("n")).alias("rank")))


def query_tokens(queries: DataFrame) -> DataFrame:
    """``query_id, n_query, token``: distinct content tokens of each query."""
    q = queries.select("query_id", T.meaningful_tokens("query").alias("t"))
    return q.select("query_id", F.size("t").alias("n_query"), F.explode("t").alias("token"))


def _chunk_tokens(chunks: DataFrame) -> DataFrame:
    """``chunk_key, token, in_body, in_title`` with each token once per chunk; needs a ``title`` column."""
    c = chunks.select("chunk_key", "title", computed_once(T.meaningful_tokens("text")).alias("body"))
    c = c.select("chunk_key", "body", computed_once(T.meaningful_tokens("title")).alias("head"))
    both = F.concat(
        F.transform("body", lambda t: F.struct(t.alias("token"), F.lit(1).alias("in_body"))),
        F.transform(F.array_except("head", "body"), lambda t: F.struct(t.alias("token"), F.lit(0).alias("in_body"))),
    )
    c = c.select("chunk_key", "head", both.alias("both"))
    return c.select("chunk_key", "head", F.explode("both").alias("e")).select(
        "chunk_key", F.col("e.token").alias("token"), F.col("e.in_body").alias("in_body"),
        F.array_contains("head", F.col("e.token")).cast("int").alias("in_title"),
    )


def coverage_topk(
    chunks: DataFrame, queries: DataFrame, k: int = V.COVERAGE_TOP_K, min_score: float = V.COVERAGE_MIN_SCORE
) -> DataFrame:
    """Chunks ranked by how much of the query's content vocabulary they cover, title agreement included."""
    qt = query_tokens(queries)
    order = [F.round("score", 9).desc(), F.col("matched").desc(), F.col("title_hits").desc(), F.col("chunk_key").asc()]
    g = _coverage_products(chunks, qt, k, min_score) if plain_keys(chunks) else None
    if g is not None:
        return materialized(top_k_per(g, ["query_id"], order, k, "rank"))
    hits = join_lookup(_chunk_tokens(chunks), qt, ["token"], ["chunk_key"], fits(qt))
    g = hits.groupBy("query_id", "chunk_key", "n_query").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("in_body").alias("body"), F.sum("in_title").alias("title_hits")
    )
    n = F.col("n_query")
    raw = F.col("matched") / n * 0.68 + F.col("body") / n * 0.22 + F.col("title_hits") / n * 0.10
    g = g.withColumn("score", F.when(n == 1, F.greatest(raw, F.lit(0.55))).otherwise(raw))
    g = g.where((n < 3) | (F.col("matched") >= 2)).where((n > 1) | (F.col("title_hits") > 0))
    g = g.where(F.col("score") >= min_score)
    return top_k_per(g.drop("n_query"), ["query_id"], order, k, "rank")


def _coverage_products(chunks: DataFrame, qt: DataFrame, k: int, min_score: float) -> DataFrame | None:
    """Coverage rows as products of whole numbers that sort as the scores do; None if they would pass 2^53.

    A common token counts (68 + 22 in the text + 10 in the title) * base^2 + base + 1 in the title.  A question of one token
    asks for it among the titles.
    """
    words = qt.groupBy("query_id", "n_query", "token").agg(F.count(F.lit(1)).alias("w"))
    most = words.groupBy("query_id", "n_query").agg(F.sum("w").alias("n")).agg(F.max("n")).first()[0] or 0
    base = most + 1
    if 101 * base**3 >= 1 << 53:
        return None
    alone = F.col("n_query") == 1
    term = F.when(alone, F.concat(F.lit("title "), "token")).otherwise(F.col("token"))
    asked = words.select(F.struct("query_id", "n_query").alias("query"), term.alias("term"), F.col("w").cast("double").alias("w"))
    worth = lambda text, title: float((68 + 22 * text + 10 * title) * base * base + base + title)
    kind = chunks.schema["chunk_key"].dataType.simpleString()
    rows = bounded_batches(chunks).select("chunk_key", "title", "text").mapInArrow(covered(worth), f"chunk_key {kind}, terms array<string>, parts array<double>")

    def allowed(ids, row, value):
        n = ids.field("n_query").to_numpy(zero_copy_only=False)[row]
        points, rest = np.divmod(value.astype(np.int64), base * base)
        matched, title = np.divmod(rest, base)
        body = (points - 68 * matched - 10 * title) // 22
        score = matched / n * 0.68 + body / n * 0.22 + title / n * 0.10
        score = np.where(n == 1, np.maximum(score, 0.55), score)
        return ((n < 3) | (matched >= 2)) & ((n > 1) | (title > 0)) & (score >= min_score)

    found = best_products(rows, asked, k, allowed).withColumn("v", F.col("value").cast("bigint"))
    left = F.col("v") % (base * base)
    found = found.select(
        "query.query_id", "query.n_query", "chunk_key", F.floor(left / base).cast("bigint").alias("matched"), (left % base).alias("title_hits"),
        F.floor(F.col("v") / (base * base)).cast("bigint").alias("points"),
    )
    n, m, t = F.col("n_query"), F.col("matched"), F.col("title_hits")
    found = found.withColumn("body", F.expr("(points - 68 * matched - 10 * title_hits) div 22"))
    raw = m / n * 0.68 + F.col("body") / n * 0.22 + t / n * 0.10
    return found.select("query_id", "chunk_key", "matched", "body", "title_hits", F.when(n == 1, F.greatest(raw, F.lit(0.55))).otherwise(raw).alias("score"))


def token_presence(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, token, present``: does the token occur in any text or title."""
    qt = query_tokens(queries).select("query_id", "token")
    wanted = qt.select("token").distinct()
    found = bounded_batches(chunks).select("title", "text").mapInArrow(seen, "token string")
    if fits(wanted):
        found = found.join(F.broadcast(wanted), "token", "left_semi")
    found = found.distinct().withColumn("present", F.lit(True))
    return qt.join(found, "token", "left").select("query_id", "token", F.coalesce("present", F.lit(False)).alias("present"))


def prf_expand(chunks: DataFrame, queries: DataFrame, ranked: DataFrame, docs: int = 3, terms: int = 5) -> DataFrame:
    """Query plus the most frequent words of its best chunks (ties: first seen)."""
    top = ranked.where(F.col("rank") <= docs).select("query_id", "chunk_key", "rank")
    texts = top.join(chunks.select("chunk_key", "text"), "chunk_key")
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    w = texts.select("query_id", "rank", F.posexplode(words).alias("pos", "word"))
    w = w.where(F.col("word").rlike("^[a-z]{4,}$") & ~F.col("word").isin(V.FEEDBACK_STOP_WORDS))
    counted = w.groupBy("query_id", "word").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rank", "pos")).alias("first")
    )
    best = top_k_per(counted, ["query_id"], [F.col("n").desc(), F.col("first").asc()], terms, "r")
    added = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("r", "word"))).alias("a"))
    out = queries.join(added, "query_id", "left")
    extra = F.array_join(F.transform("a", lambda x: x["word"]), " ")
    return out.select("query_id", F.concat_ws(" ", "query", extra).alias("expanded"))
