"""Candidate fusion, scoring, filtering and selection.

A *pool* is ``query_id, chunk_key, score, rank`` plus evidence columns; it holds at most a
few dozen rows per query because every channel was cut to its top-k before.  Windows per
query therefore stay small.  ``with_text`` adds ``query, text, file_key, file_name``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import intents as I
from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators import lexical as L
from corpusloom.operators.scale import bounded_batches, computed_once, fence, fits, materialized, top_k_per
from corpusloom.operators.vectors import rescore_pairs, token_share
from corpusloom.operators.words import meaningful_words, pair_marks, text_marks


def per_query() -> Window:
    """Window over the few candidates of one query."""
    return Window.partitionBy("query_id")


def rerank(pool: DataFrame, *order: Column, rank: str = "rank") -> DataFrame:
    return pool.withColumn(rank, F.row_number().over(per_query().orderBy(*order)))


def hybrid_merge(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Weighted merge of two channels; the lexical score is scaled by the query's own best."""
    v = vector.select("query_id", "chunk_key", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    top = F.max("score").over(per_query())
    b = lexical.select(
        "query_id", "chunk_key", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"),
        F.when(top > 0, F.col("score") / top).otherwise(F.col("score")).alias("bm25_norm"),
    )
    m = v.join(b, ["query_id", "chunk_key"], "full_outer")
    score = V.VECTOR_WEIGHT * F.coalesce("vector_score", F.lit(0.0)) + V.LEXICAL_WEIGHT * F.coalesce("bm25_norm", F.lit(0.0))
    channels = F.concat_ws(
        ",", F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25")
    )
    m = m.withColumns({"score": score, "channels": channels}).drop("bm25_norm")
    return rerank(m, F.round("score", 9).desc(), F.col("vector_rank").asc_nulls_last(), F.col("bm25_rank").asc())


def rrf_fuse(results: DataFrame, k: int = V.RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ``query_id, variant, chunk_key, score, rank``.

    One result set passes through with its own order; scores are normalised by the query's best.
    """
    g = results.groupBy("query_id", "chunk_key").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.countDistinct("variant").alias("hits"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.col("variant").cast("string")))).alias("variants"),
        F.max("score").alias("best_score"),
    )
    sets = results.groupBy("query_id").agg(F.countDistinct("variant").alias("n_sets"))
    g = g.join(sets, "query_id")
    norm = F.col("rrf") / F.max("rrf").over(per_query())
    g = g.withColumn("score", F.when(F.col("n_sets") > 1, norm).otherwise(F.col("best_score")))
    return rerank(
        g.drop("n_sets"), F.round("rrf", 9).desc(), F.col("hits").desc(), F.round("best_score", 9).desc(), F.col("chunk_key").asc()
    )


def query_features(queries: DataFrame) -> DataFrame:
    """Everything a pool needs to know about its question, computed once per question."""
    f = I.retrieval_intents(F.col("query"), F.col("nq"))
    packed = lambda tokens: F.array_join(tokens, " ")
    return with_target(queries).select(
        "query_id",
        "query",
        "nq",
        packed(T.query_topic_tokens("query", F.col("nq"))).alias("topic_words"),
        packed(T.meaningful_tokens("query")).alias("query_words"),
        packed(F.col("target")).alias("target"),
        "kind",
        F.lower("query").rlike(V.RULE_REFERENCE).alias("rule_asked"),
        f["short_query"].alias("short_query"),
        f["list_query"].alias("list_query"),
        f["compound_query"].alias("compound_query"),
        "is_identity",
        f["reference_request"].alias("ref_asked"),
    )


def with_target(queries: DataFrame) -> DataFrame:
    """Adds ``nq, kind, is_identity`` and ``target``, what a question asks about: the topic of an identity question, else the anchors of its relation.

    Each is its own step: inside one expression a question would be normalised again for every pattern.
    """
    q, nq = F.col("query"), F.col("nq")
    d = queries.withColumn("nq", computed_once(T.normalize_text(q)))
    d = d.withColumn("kind", computed_once(I.direct_relation_kind(q, nq)))
    d = d.withColumn("is_identity", I.retrieval_intents(q, nq)["identity_query"])
    topic, anchors = F.slice(T.query_topic_tokens(q, nq), 1, 8), I.relation_anchors(q, F.col("kind"), nq)
    return d.withColumn("target", F.when(F.col("is_identity"), topic).otherwise(anchors))


def _unpacked(words: str) -> Column:
    return F.filter(F.split(words, " "), lambda t: t != "")


def _chunk_side(pool: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """The chunks a pool needs, so that text features are computed once per chunk, not per pair."""
    keys = pool.select("chunk_key").distinct()
    cols = [c for c in ("text", "file_key", "file_name", "chunk_id", "total_chunks", "section_role") if c in chunks.columns]
    t = chunks.select("chunk_key", *cols)
    # Dealt before the join: what is computed from a text is made after the shuffle and never moves.
    t = t.join(F.broadcast(keys), "chunk_key", "left_semi") if small else t.repartition("chunk_key").join(keys, "chunk_key", "left_semi")
    return bounded_batches(t).withColumn("text_tokens", meaningful_words(F.substring("text", 1, V.RESCORE_CHARS)))


#: Questions whose features are broadcast to the scan of the chunks.
SMALL_QUERIES = 2_000


def with_text(pool: DataFrame, chunks: DataFrame, queries: DataFrame, features: bool = False) -> DataFrame:
    """Joins texts and question features to a pool; the rows of a pair are made where its text is.

    Every text moves at most once, whatever number of questions found it: questions, which are short, go to the texts.  What
    callers do not select is pruned, so a pool that leaves this stage by question carries numbers, not texts.
    """
    small = fits(queries, SMALL_QUERIES)
    t = _chunk_side(pool, chunks, small)
    if features:
        t = chunk_features(t)
    asked = query_features(queries)
    if small:
        p = t.join(F.broadcast(pool), "chunk_key").join(F.broadcast(asked), "query_id")
    else:
        p = pool.join(asked, "query_id").join(t, "chunk_key")
    p = p.withColumns({"topic_toks": _unpacked("topic_words"), "query_tokens": _unpacked("query_words")})
    return p.withColumn("share", token_share(F.col("query_tokens"), F.col("text_tokens")))


#: Columns as long as texts or questions.
LONG = ["text", "nt", "text_tokens", "query", "nq", "topic_words", "query_words", "topic_toks", "query_tokens", "file_toks", "marks"]


# ---- scores -------------------------------------------------------------------------------------


def _sum(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def query_match_score(toks: Column, head: Column, nt: Column) -> Column:
    """Substring hits of distinct query tokens: near the start count more; capped."""
    add = lambda acc, t: acc + F.when(head.contains(t), 0.25).when(nt.contains(t), 0.08).otherwise(0.0)
    return F.least(F.aggregate(toks, F.lit(0.0), add), F.lit(1.25))


def source_topic_score(query_tokens: Column, file_tokens: Column) -> Column:
    n, hit = F.size(file_tokens), F.size(F.array_intersect(file_tokens, query_tokens))
    return (
        F.when((n == 0) | (F.size(query_tokens) == 0), 0.0)
        .when((n == 1) & (hit == 1) & (F.length(F.get(file_tokens, F.lit(0))) >= 4), 2.0)
        .when((n >= 2) & (hit / n >= 0.70), 2.5)
        .when((n >= 2) & (hit >= 2), 1.25)
        .otherwise(0.0)
    )


def strong_intro_score() -> Column:
    hits = F.col("strong_hits")
    return (
        F.when(hits >= 2, 0.80).otherwise(0.0)
        + F.when(F.col("strong_cue"), 1.20).otherwise(0.0)
        + F.when((hits >= 2) & (F.col("n_sentences") >= 1) & (F.col("n_words") >= 40), 0.50).otherwise(0.0)
    )


def chunk_features(chunks: DataFrame) -> DataFrame:
    """Evidence that depends on the chunk alone."""
    c = chunks.withColumns({"marks": text_marks(F.col("text")), "file_toks": T.file_topic_tokens("file_name")})
    return c.select(*[n for n in c.columns if n != "marks"], "marks.*")


def with_features(pool: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Pool with all evidence columns, each computed once, where the texts are."""
    p = with_text(pool, chunks, queries, features=True)
    p = p.withColumn("marks", pair_marks(F.col("nq"), F.col("topic_words"), F.col("nt")))
    p = p.select(*[c for c in p.columns if c != "marks"], "marks.*")
    p = p.withColumns(
        {
            "intro": F.when(F.col("quoted"), 0.40).otherwise(0.0) + F.when(F.col("intro_cue"), 0.80).otherwise(0.0),
            "topic": source_topic_score(F.col("topic_toks"), F.col("file_toks")),
            "strong_intro": strong_intro_score(),
            "topic_cov": F.when(F.size("topic_toks") > 0, F.col("topic_hits") / F.size("topic_toks")).otherwise(0.0),
        }
    )
    unasked_ref = F.col("is_ref") & ~F.col("ref_asked")
    strong_short = (
        (F.col("n_words") < 60) & ~unasked_ref & (F.col("noise") < 4) & (F.col("citation") < 6)
        & (F.col("score") >= 0.75) & (F.col("match") >= 0.50) & (F.col("topic_cov") >= 0.50)
    )
    plain = ~F.col("has_def") & ~strong_short
    low = (
        ((F.col("noise") >= 8) & ~F.col("has_def"))
        | ((F.col("citation") >= 8) & F.col("cites_first"))
        | ((F.col("n_words") < 25) & plain)
        | ((F.col("n_words") < 60) & (F.col("n_sentences") == 0) & plain)
    )
    p = p.withColumns({"unasked_ref": unasked_ref, "low_value": low})
    p = p.withColumn("info_score", information_score())
    for proof in (_identity_proof(), _relation_proof()):
        p = p.withColumns(proof)
    p = p.withColumn("definition", _definition())
    return fence(p, "query_id")


def _identity_proof() -> dict[str, Column]:
    """How well a chunk's source and text name the subject of an identity question; null for other questions."""
    open_ = F.expr("is_identity AND NOT unasked_ref AND id_noise < 4 AND NOT compound_query AND NOT list_query")
    target = _unpacked("target")
    in_file = F.filter(F.array_intersect("file_toks", target), lambda t: F.substring("nt", 1, 1000).contains(t))
    return {
        "source_score": F.when(open_, source_topic_score(target, F.col("file_toks"))),
        "target_match": F.when(open_, query_match_score(F.filter(target, lambda t: F.length(t) > 2), F.substring("nt", 1, 900), F.col("nt"))),
        "file_cov": F.when(open_ & (F.size("file_toks") > 0), F.size(in_file) / F.size("file_toks")),
    }


def _definition() -> Column:
    """``definition_strength`` of the rows that the other proofs of ``_identity_proof`` leave."""
    return F.when(F.expr("source_score >= 2.0 AND file_cov >= 0.80 AND target_match >= 0.25"), definition_strength(F.col("target"), F.col("nt"), F.col("closing")))


def _relation_proof() -> dict[str, Column]:
    """Local evidence of a direct fact, and whether a text has words that a question asks about."""
    open_ = F.expr("NOT is_identity AND NOT list_query AND NOT compound_query AND NOT unasked_ref AND NOT rule_asked AND kind <> ''")
    target = _unpacked("target")
    has = F.size(F.filter(target, lambda t: T.padded(F.col("nt")).contains(T.padded(t)))) >= 2
    return {
        "local": F.when(open_, relation_evidence(F.col("kind"), target, F.col("nt"))).otherwise(0.0),
        "literal": F.when(F.col("is_identity"), F.col("nt").contains(F.col("target"))).otherwise(has),
    }


def information_score() -> Column:
    c = F.col
    pts = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return (
        c("score") + c("match") + c("topic") + c("intro")
        + F.when(c("is_identity"), c("strong_intro")).otherwise(0.0)
        + pts(c("n_words") >= 40, 0.10) + pts(c("n_words") >= 100, 0.15) + pts(c("has_def"), 0.45)
        + pts(c("n_sentences") >= 2, 0.10)
        - F.least(c("noise") * 0.18, F.lit(1.20))
        - F.when(c("is_identity"), F.least(c("id_noise") * 0.35, F.lit(2.10))).otherwise(0.0)
        - F.when(c("unasked_ref"), F.when(c("is_identity"), 6.0).otherwise(2.5)).otherwise(0.0)
        - F.when(c("has_def"), F.least(c("citation") * 0.05, F.lit(0.40))).otherwise(
            F.least(c("citation") * 0.20, F.lit(1.50)))
        - pts(c("low_value"), 1.0)
    )


def informative_order(pool: DataFrame) -> DataFrame:
    """Re-ranks a feature pool by information score, prior rank on ties."""
    return rerank(pool.drop("prior_rank").withColumnRenamed("rank", "prior_rank"), *L.score_order("info_score", "prior_rank"))


def low_value_filter(pool: DataFrame) -> DataFrame:
    """Drops low-value chunks; a query that would lose everything keeps all (identity: nothing)."""
    keep = ~F.col("unasked_ref") & ~F.col("low_value")
    any_kept = F.max(keep.cast("int")).over(per_query()) == 1
    return pool.withColumn("keep", keep).withColumn("any_kept", any_kept).where(
        F.col("keep") | (~F.col("any_kept") & ~F.col("is_identity"))
    ).drop("keep", "any_kept")


def identity_noise_filter(pool: DataFrame) -> DataFrame:
    noisy = ((F.col("id_noise") >= 6) | ((F.col("id_noise") >= 4) & (F.col("info_score") < 1.5))) & ~F.col("bio")
    return pool.where(~F.col("is_identity") | (~F.col("unasked_ref") & ~noisy))


def list_score(pool: DataFrame) -> DataFrame:
    """Adds ``list_score``."""
    c = F.col
    pts = lambda cond, v: F.when(cond, v).otherwise(0.0)
    s = (
        c("info_score") + c("match")
        + pts(c("many_lines"), 0.35)
        + pts(c("has_bullet"), 0.35)
        + pts(c("enumerates"), 0.20)
        + pts(c("list_cue"), 0.20)
        - pts(c("unasked_ref"), 3.0)
    )
    return pool.withColumn("list_score", s)


def relationship_score(pool: DataFrame) -> DataFrame:
    """Adds ``relation_score`` and drops rows at or below -0.5 unless a query would lose all."""
    section = F.col("relation_section")
    s = (
        F.col("score") + F.col("match") + F.col("relation_weight")
        - F.col("relation_negative") * 0.80
        + F.when(section, 0.80).otherwise(0.0)
        - F.when(~F.col("relation_words") & ~section, 1.0).otherwise(0.0)
    )
    out = pool.withColumn("relation_score", s)
    out = out.withColumn("best", F.max("relation_score").over(per_query()))
    return out.where((F.col("relation_score") > -0.5) | (F.col("best") <= -0.5)).drop("best")


def source_filter(pool: DataFrame, family: Column, *fields: str) -> DataFrame:
    """Keeps rows whose source fields contain the family."""
    return pool.where(F.lower(F.concat_ws(" ", *fields)).contains(F.lower(family)))


def candidate_depth(queries: DataFrame) -> DataFrame:
    """Candidate and final depth per query."""
    f = I.retrieval_intents(F.col("query"))
    low = F.lower("query")
    q = queries.withColumns({"is_list": f["list_query"], "is_identity": f["identity_query"], "structured": low.rlike(V.RULE_REFERENCE)})
    k = (
        F.when(F.col("structured"), V.STRUCTURED_TOP_K)
        .when(F.col("is_list"), V.LIST_TOP_K)
        .when(F.col("is_identity"), V.IDENTITY_TOP_K)
        .otherwise(V.TOP_K)
    )
    final = F.when(F.col("is_list"), V.COMPLETENESS_TOP_K).otherwise(V.FINAL_TOP_K)
    return q.select("query_id", k.cast("bigint").alias("depth"), final.cast("bigint").alias("final_k"))


def top_source_focus(pool: DataFrame) -> DataFrame:
    """Short questions keep only the file of their best chunk."""
    short = F.col("short_query")
    first = F.first("file_key").over(per_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return pool.withColumn("top_file", first).where(~short | (F.col("file_key") == F.col("top_file"))).drop("top_file")


def identity_pool(pool: DataFrame, filtered: DataFrame, keep: int = 8, fill: int = 6) -> DataFrame:
    """Filtered rows first (at most ``keep``), then other non-reference rows until ``fill``."""
    f = filtered.select("query_id", "chunk_key", F.col("rank").alias("f_rank"))
    a = top_k_per(f, ["query_id"], [F.col("f_rank").asc()], keep, "f_pos").drop("f_rank")
    p = pool.where(~F.col("unasked_ref")).join(a, ["query_id", "chunk_key"], "left")
    p = rerank(p, F.col("f_pos").asc_nulls_last(), F.col("rank").asc(), rank="pool_rank")
    return p.where(F.col("f_pos").isNotNull() | (F.col("pool_rank") <= fill))


# ---- facets --------------------------------------------------------------------------------------


def facet_augment(pool: DataFrame, facet_pool: DataFrame) -> DataFrame:
    """Merges per-facet candidates (``query_id, facet_no, chunk_key, score``) into a pool.

    Adds ``facets`` (facets that found the chunk); the score is the best of all.
    """
    a = pool.select("query_id", "chunk_key", "score", F.lit(None).cast("bigint").alias("facet_no"), "rank")
    b = facet_pool.select("query_id", "chunk_key", "score", "facet_no", F.lit(None).cast("int").alias("rank"))
    g = a.unionByName(b).groupBy("query_id", "chunk_key").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_set("facet_no")).alias("facets"), F.min("rank").alias("prior_rank")
    )
    return rerank(g, F.round("score", 9).desc(), F.col("prior_rank").asc_nulls_last(), F.col("chunk_key").asc())


def facet_select(pool: DataFrame, limit: int | Column) -> DataFrame:
    """Best row of every facet first, then the rest by rank, up to ``limit``."""
    hit = pool.select("query_id", "chunk_key", "rank", F.explode("facets").alias("facet_no"))
    best = top_k_per(hit, ["query_id", "facet_no"], [F.col("rank").asc()], 1, "r")
    lead = best.groupBy("query_id", "chunk_key").agg(F.min("facet_no").alias("lead_facet"))
    p = pool.join(lead, ["query_id", "chunk_key"], "left")
    p = rerank(p, F.col("lead_facet").asc_nulls_last(), F.col("rank").asc(), rank="pos")
    return p.where(F.col("pos") <= limit)


def facet_cover(ranked: DataFrame, facet_counts: DataFrame, limit: int | Column, floor: float = V.MIN_RETRIEVAL_SCORE) -> DataFrame:
    """``facet_select`` among confident rows plus a ``complete`` flag per query."""
    ok = ranked.where(F.col("rescore") >= floor)
    chosen = facet_select(ok, limit)
    covered = ok.select("query_id", F.explode("facets").alias("f")).distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_covered"))
    flags = facet_counts.join(covered, "query_id", "left").select(
        "query_id", (F.coalesce("n_covered", F.lit(0)) >= F.col("n_facets")).alias("complete")
    )
    return chosen.join(flags, "query_id")


# ---- gates and selection -------------------------------------------------------------------------------


def confidence_gate(pool: DataFrame, score: str = "rescore", floor: float = V.MIN_RETRIEVAL_SCORE) -> DataFrame:
    """Rows at or above the floor; a query whose best row is below it ends up empty."""
    return pool.where(F.col(score) >= floor)


def diversity_cap(pool: DataFrame, cap: Column, pinned: Column | None = None) -> DataFrame:
    """At most ``cap`` rows per file in rank order; pinned rows always stay but count."""
    pos = F.row_number().over(Window.partitionBy("query_id", "file_key").orderBy("rank"))
    keep = F.col("file_pos") <= cap
    return pool.withColumn("file_pos", pos).where(keep if pinned is None else keep | pinned)


def per_file_cap() -> Column:
    return (
        F.when(F.col("short_query") | F.col("compound_query"), V.FINAL_TOP_K)
        .when(F.col("list_query"), V.COMPLETENESS_TOP_K)
        .otherwise(2)
    )


def neighbor_expand(pool: DataFrame, chunks: DataFrame, seeds: int = 2, before: int = 1, after: int = 1, decay: float = 0.95) -> DataFrame:
    """Adds the chunks next to the first seeds of each query, in document order per seed.

    Neighbour ids are generated and equi-joined, so no range join is needed.
    """
    s = pool.where(F.col("rank") <= seeds).select(
        "query_id", "file_key", F.col("chunk_id").alias("seed_id"), "total_chunks", "score", F.col("rank").alias("seed_rank")
    )
    ids = F.sequence(F.greatest(F.lit(0), F.col("seed_id") - before), F.least(F.col("total_chunks") - 1, F.col("seed_id") + after))
    n = s.withColumn("chunk_id", F.explode(ids))
    n = n.join(chunks.select("file_key", "chunk_id", "chunk_key"), ["file_key", "chunk_id"])
    n = top_k_per(n, ["query_id", "chunk_key"], [F.col("seed_rank").asc()], 1, "dup").drop("dup")
    is_seed = F.col("chunk_id") == F.col("seed_id")
    n = n.withColumns({"is_neighbor": ~is_seed, "score": F.when(is_seed, F.col("score")).otherwise(F.col("score") * decay)})
    return rerank(n, F.col("seed_rank").asc(), F.col("chunk_id").asc(), rank="pos")


def anchors_first(pool: DataFrame, expanded: DataFrame, k: int) -> DataFrame:
    """The first k accepted rows, then their neighbours, up to k rows."""
    a = pool.where(F.col("rank") <= k).select("query_id", "chunk_key", F.lit(0).alias("tier"), F.col("rank").alias("r"))
    b = expanded.select("query_id", "chunk_key", F.lit(1).alias("tier"), F.col("pos").alias("r"))
    u = top_k_per(a.unionByName(b), ["query_id", "chunk_key"], [F.col("tier").asc(), F.col("r").asc()], 1, "dup").drop("dup")
    return top_k_per(u, ["query_id"], [F.col("tier").asc(), F.col("r").asc()], k, "pos")


def build_context(pool: DataFrame) -> DataFrame:
    """One context text per query from its ranked rows (``rank, file_key, text``)."""
    block = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("] "), F.col("file_key"), F.lit("\n"), F.col("text"))
    g = pool.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return g.select("query_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n").alias("context"))


def compact_context(pool: DataFrame, total: int = 4800, each: int = 2200, head: int = 900) -> DataFrame:
    """Budgeted excerpts: the head of each chunk plus the window with the most query tokens.

    The window start is chosen among the token positions of the normalised text; a running
    sum over the ranked rows of a query enforces the total budget.
    """
    size = each - head
    p = pool.withColumns({"nt": T.normalize_text("text"), "toks": F.col("topic_toks")})
    p = p.withColumn("starts", F.array_distinct(F.filter(F.transform("toks", lambda t: F.instr(F.col("nt"), t)), lambda i: i > head)))

    def density(start: Column) -> Column:
        win = F.substring(F.col("nt"), start, F.lit(size))
        return F.struct(F.size(F.filter("toks", lambda t: win.contains(t))).alias("n"), (-start).alias("neg"))

    best = F.array_max(F.transform("starts", density))
    start = F.coalesce(-best["neg"], F.lit(head + 1))
    short = F.length("nt") <= each
    excerpt = F.when(short, F.col("nt")).otherwise(
        F.concat(F.substring("nt", 1, head), F.lit(" ... "), F.substring(F.col("nt"), start, F.lit(size - 5)))
    )
    p = p.withColumn("excerpt", excerpt).drop("nt", "toks", "starts")
    before = F.coalesce(
        F.sum(F.length("excerpt")).over(per_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    p = p.withColumn("room", total - before).where(F.col("room") > 0)
    return p.withColumn("excerpt", F.substring(F.col("excerpt"), F.lit(1), F.col("room").cast("int"))).drop("room")


# ---- fast paths and rescue --------------------------------------------------------------------------------


def definition_strength(target: Column, nt: Column, closing: Column) -> Column:
    """How directly a text introduces the target near its start (0, 2.0, 2.5 or 3.0)."""
    toks = F.split(target, " ")
    head = F.substring(nt, 1, 1400)
    subject = F.when(
        F.size(toks) >= 2,
        F.concat(F.get(toks, F.lit(0)), F.lit(r"(?:\s+[a-z0-9]+){0,6}\s+"), F.element_at(toks, -1)),
    ).otherwise(target)
    relation = r"\b(?:.{0,320}?\b(?:is|was|are|were)\s+(?:a\s+|an\s+|the\s+)[a-z]|.{0,240}?\b(?:serves|served|leads|led|founded|established|heads|headed)\b)"
    pattern = F.concat(F.lit(r"\b"), subject, F.lit(relation))
    pos = F.regexp_instr(head, pattern) - 1
    end = pos + F.length(F.regexp_substr(head, pattern))
    return (
        F.when(closing | (target == "") | (pos < 0) | pos.isNull() | (pos > 520), 0.0)
        .when((pos <= 80) & (end - pos <= 300), 3.0)
        .when((pos <= 220) & (end - pos <= 460), 2.5)
        .otherwise(2.0)
    )


def identity_fast_path(pool: DataFrame) -> DataFrame:
    """Single best chunk per identity question whose own source and introduction name the subject."""
    p = pool.where("source_score >= 2.0 AND file_cov >= 0.80 AND definition >= 2.0 AND target_match >= 0.25")
    p = p.withColumn("safety", F.col("source_score") + F.col("definition") + F.col("target_match"))
    order = [F.col("definition").desc(), F.round("safety", 9).desc(), F.round("score", 9).desc(), F.col("rank").asc()]
    return top_k_per(p, ["query_id"], order, 1, "pick")


RELATION_CUES = {
    "position": r"\b(?:served|serve)\b.{0,90}\bas\b|\b(?:was|is|were|are)\s+appointed\b|\b(?:appointed|appointment|position|role|office|title)\b",
    "organization": r"\b(?:co\s*founder|co\s*founded|founded|founding member|helped found|help found)\b",
    "approver": r"\b(?:approve|approves|approved|approval|approver|authorize|authorized|authorization)\b",
    "quantity": r"\b(?:day|days|hour|hours|credit|credits|percent|percentage|amount|limit|allotment|allowance|entitled|entitlement|provided|annual|annually|yearly)\b",
    "purpose": r"\b(?:purpose|objective|goal|aim|mission|primary\s+objective|seek|sought|intended)\b",
    "eligibility": r"\b(?:eligible|eligibility|qualified|qualify|entitled|entitlement|covered|regular\s+employees?)\b",
    "time": r"\b(?:signed|effective|issued|started|ended|approved|dated|date)\b",
}
NUMBER_WORDS = (
    r"\b(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen"
    r"|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred)\b"
)
DATE_VALUE = (
    r"\b(?:18|19|20)[0-9]{2}\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
    r"|\b[0-9]{1,2}[/-][0-9]{1,2}[/-](?:[0-9]{2}|[0-9]{4})\b"
)


def relation_evidence(kind: Column, anchors: Column, nt: Column) -> Column:
    """Local proof that one compact window holds the anchors and the relation wording."""
    pos = F.filter(F.transform(anchors, lambda t: F.instr(nt, t)), lambda p: p > 0)
    n, m = F.size(anchors), F.size(pos)
    need = F.when(n <= 3, n).otherwise(F.greatest(F.lit(3), F.floor(n * 0.75 + 0.999).cast("int")))
    first, last = F.array_min(pos), F.array_max(pos)
    start = F.greatest(F.lit(1), first - 220)
    window = F.substring(nt, start, last + 620 - start)
    cue = None
    for k, p in RELATION_CUES.items():
        cue = F.when(kind == k, window.rlike(p)) if cue is None else cue.when(kind == k, window.rlike(p))
    ok = (
        (n > 0) & (m >= need) & (last - first <= 720) & cue.otherwise(False)
        & ((kind != "quantity") | window.rlike(NUMBER_WORDS)) & ((kind != "time") | window.rlike(DATE_VALUE))
    )
    bonus = F.when(last - first <= 240, 1.0).otherwise(0.5)
    return F.when(ok, m / n * 4.0 + 2.0 + bonus).otherwise(0.0)


def relation_fast_path(pool: DataFrame) -> DataFrame:
    """Best proven chunk per direct-fact question; near ties between two files give nothing."""
    best = F.max("bm25_score").over(per_query())
    p = pool.withColumn("best", F.when(best > 0, best).otherwise(1.0))
    p = p.where("local > 0")
    norm = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("bm25_score") / F.col("best")))
    p = p.withColumn("safety", F.col("local") + F.col("topic") + F.col("match") + F.coalesce(norm, F.lit(0.0)))
    p = top_k_per(p.where("safety >= 7.0"), ["query_id"], [F.round("safety", 9).desc(), F.col("rank").asc()], 2, "pick")
    w = per_query().orderBy("pick")
    p = p.withColumns({"next_file": F.lead("file_key").over(w), "next_safety": F.lead("safety").over(w)})
    clash = (F.col("next_file") != F.col("file_key")) & (F.col("safety") - F.col("next_safety") < 0.75)
    return p.where((F.col("pick") == 1) & ~F.coalesce(clash, F.lit(False)))


def ood_reject(queries: DataFrame, presence: DataFrame, pool: DataFrame) -> DataFrame:
    """Questions with no lexical footprint in the corpus.

    ``presence`` comes from ``token_presence`` on the target tokens of each question; a
    literal hit among the lexical candidates vetoes the rejection.
    """
    q = unknown_questions(queries, presence)
    veto = pool.where("literal").select("query_id").distinct()
    return q.join(veto, "query_id", "left_anti").select("query_id", "kind", "is_identity")


def unknown_questions(queries: DataFrame, presence: DataFrame) -> DataFrame:
    """``query_id, query, kind, is_identity`` of the questions that ask for two words or more of which the corpus has none."""
    n = presence.groupBy("query_id").agg(F.sum(F.col("present").cast("int")).alias("n_present"), F.count(F.lit(1)).alias("n_tokens"))
    q = queries.join(n.where("n_present = 0 and n_tokens >= 2"), "query_id")
    f = I.retrieval_intents(F.col("query"), F.col("nq"))
    q = with_target(q).where((F.col("is_identity") | (F.col("kind") != "")) & (F.size("target") >= 2) & ~f["compound_query"] & ~f["list_query"])
    return q.select("query_id", "query", "kind", "is_identity")


RESCUE_MIN_SCORE = 0.40


def empty_rescue(queries: DataFrame, answered: DataFrame, chunks: DataFrame, k: int = V.FINAL_TOP_K, found: DataFrame | None = None) -> DataFrame:
    """Coverage search for questions without any accepted row.

    ``found``: rows of ``coverage_topk`` for these questions, at least ``COVERAGE_TOP_K`` deep and from a floor of at most
    ``RESCUE_MIN_SCORE``, where the caller has searched so already; ranks follow scores, so the rescue's rows are the first of them.
    """
    open_q = materialized(queries.join(answered.select("query_id").distinct(), "query_id", "left_anti"))
    if found is None:
        cov = L.coverage_topk(chunks, open_q, V.COVERAGE_TOP_K, RESCUE_MIN_SCORE)
    else:
        cov = found.where((F.col("score") >= RESCUE_MIN_SCORE) & (F.col("rank") <= V.COVERAGE_TOP_K)).join(open_q.select("query_id"), "query_id", "left_semi")
    p = with_features(cov.select("query_id", "chunk_key", "score", "rank"), chunks, open_q).where(~F.col("unasked_ref") & (F.col("noise") < 5))
    p = top_k_per(p, ["query_id"], [F.col("rank").asc()], 10, "r10").drop("r10")
    ok = confidence_gate(rescore_pairs(p.select("query_id", "chunk_key", "share", "file_key", "rank", "short_query", "list_query", "compound_query")))
    ok = rerank(ok.drop("prior_rank").withColumnRenamed("rank", "p"), F.col("p").asc())
    d = diversity_cap(ok, per_file_cap())
    return top_k_per(d, ["query_id"], [F.col("rank").asc()], k, "pos")


def stage_summary(queries: DataFrame, **stages: DataFrame) -> DataFrame:
    """Rows per query at every stage; zero where a stage has none."""
    parts = [df.select("query_id", F.lit(name).alias("stage")) for name, df in stages.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    g = u.groupBy("query_id").agg(*[F.sum(F.when(F.col("stage") == s, 1).otherwise(0)).alias(f"n_{s}") for s in stages])
    out = queries.select("query_id").join(g, "query_id", "left")
    return out.select("query_id", *[F.coalesce(f"n_{s}", F.lit(0)).cast("bigint").alias(f"n_{s}") for s in stages])


def candidate_trace(floor: float = V.MIN_RETRIEVAL_SCORE, **stages: DataFrame) -> DataFrame:
    """One row per query, stage and position: score, acceptance and a text preview (``preview``, or the start of ``text``)."""
    parts = []
    for name, df in stages.items():
        s = F.col("rescore") if "rescore" in df.columns else F.col("score")
        judged = F.lit("rescore" in df.columns)
        parts.append(df.select(
            "query_id", F.lit(name).alias("stage"), F.col("rank").cast("bigint").alias("position"), "chunk_key", s.alias("score"),
            F.when(judged, s >= floor).alias("accepted"),
            F.when(judged & (s < floor), "below threshold").alias("reason"),
            (F.col("preview") if "preview" in df.columns else F.substring("text", 1, 240)).alias("preview"),
        ))
    return reduce(lambda a, b: a.unionByName(b), parts)
