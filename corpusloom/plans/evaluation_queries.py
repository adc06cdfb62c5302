"""Evaluation, audit, latency and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import fusion as FU
from corpusloom.operators import lexical as L
from corpusloom.operators import structure as S
from corpusloom.operators.scale import top_k_per
from corpusloom.plans import catalogue_queries as CQ
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.lexical_queries import bm25_sql
from corpusloom.plans.registry import query
from corpusloom.plans.structure_queries import _CHUNKT, _WIN1


@query(
    "match_case",
    f"""SELECT doc_id AS question_id, coalesce(case_id, 'AUTO-' || upper(left(sha1(nq), 8))) AS case_id, case_id IS NOT NULL AS matched FROM (SELECT doc_id, {D.norm('text')} AS nq FROM documents) LEFT JOIN (
 SELECT {D.norm('text')} AS nq, min('CASE-' || item_id) AS case_id FROM benchmark GROUP BY 1) USING (nq)""",
)
def _(spark, sf):
    q = X.table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("text").alias("question"))
    c = X.table(spark, sf, "benchmark").select(F.concat(F.lit("CASE-"), "item_id").alias("case_id"), F.col("text").alias("alias"))
    return E.match_case(q, c)


@query(
    "run_numbering",
    "SELECT event_id, (n - 1) % 3 + 1 AS run_number, (n - 1) // 3 + 1 AS cycle_number FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)",
)
def _(spark, sf):
    r = E.run_numbering(X.table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "event_id", 3)
    return r.select("event_id", "run_number", "cycle_number")


def eval_cases(spark, sf):
    """Each benchmark item is a case, its ten best documents are the answers."""
    c, q = X.corpus(spark, sf), X.queries(spark, sf)
    p = FU.with_text(L.bm25_topk(c, q), c, q)
    w = F.split("nq", " ")
    return p.select(
        "query_id", "chunk_key", F.col("text").alias("answer"), F.lit(True).alias("matched"), F.lit("").alias("exact_answer"),
        F.array(F.array(F.concat_ws(" ", w[0], w[1], w[2]), F.concat_ws(" ", w[3], w[4])), F.array(F.concat_ws(" ", w[1], w[3]))).alias("required_groups"),
        F.array(F.lit("license")).alias("forbidden_terms"), F.col("topic_toks").alias("pool_terms"), F.lit(4).alias("minimum_pool_matches"), F.lit(0).alias("minimum_bullets"))


_HIT = lambda na, a, t: f"({a} <> '' AND (contains({na}, {a}) OR (len(string_split({a}, ' ')) = 2 AND length(string_split({a}, ' ')[1]) >= 3 AND length(string_split({a}, ' ')[2]) >= 3 AND regexp_matches({na}, '\\b' || string_split({a}, ' ')[1] || '\\b(?:\\s+[a-z0-9]+){{0,2}}\\s+\\b' || string_split({a}, ' ')[2] || '\\b'))))"


@query(
    "evaluate_answer",
    f"""SELECT query_id, chunk_key, missing, banned, pool, CASE WHEN missing = 0 AND banned = 0 AND pool >= 4 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
 SELECT query_id, chunk_key, (NOT ({_HIT('na', 'a1', 0)} OR {_HIT('na', 'a2', 0)}))::BIGINT + (NOT {_HIT('na', 'a3', 0)})::BIGINT AS missing, contains(na, 'license')::BIGINT AS banned, len(list_filter(pt, lambda t: contains(na, t))) AS pool FROM (
 SELECT query_id, chunk_key, {D.norm('text')} AS na, w[1] || ' ' || w[2] || ' ' || w[3] AS a1, w[4] || ' ' || w[5] AS a2, w[2] || ' ' || w[4] AS a3, pt FROM (SELECT *, string_split({D.norm('query')}, ' ') AS w, list_distinct({D.topic_words(D.norm('query'), ())}) AS pt FROM ({bm25_sql(10)}) JOIN ({X.QUERIES_SQL}) USING (query_id) JOIN ({X.CORPUS_SQL}) USING (chunk_key))))""".replace(
        "AND t_ NOT IN ()", f"AND t_ NOT IN {D.words(__import__('corpusloom.functions.vocab', fromlist=['x']).QUERY_FILLER_WORDS)}"),
)
def _(spark, sf):
    e = E.evaluate_answer(eval_cases(spark, sf))
    return e.select("query_id", "chunk_key", F.col("missing").cast("bigint"), F.col("banned").cast("bigint"), F.col("pool").cast("bigint"), "status")


@query("case_eval_extra")
def _(spark, sf):
    """Bullet limits, fallback expectation and order of two terms per case and answer."""
    c = eval_cases(spark, sf).withColumn("na", T.normalize_text("answer"))
    a, b = F.col("required_groups")[0][1], F.col("required_groups")[1][0]
    return c.select("query_id", "chunk_key", (T.bullet_count("answer") <= 8).alias("bullets_ok"), F.col("na").contains("not found").alias("is_fallback"),
                    ((F.instr("na", a) > 0) & (F.instr("na", a) < F.instr("na", b))).alias("in_order"))


@query(
    "retrieval_eval",
    f"""SELECT query_id, n_relevant, coalesce(hits, 0) AS hits, round(coalesce(hits, 0)::DOUBLE / n_relevant, 6) AS recall, round(coalesce(1.0::DOUBLE / best, 0), 6) AS reciprocal_rank FROM (
 SELECT item_id AS query_id, count(*) AS n_relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1) LEFT JOIN (
 SELECT query_id, count(*) AS hits, min(rank) AS best FROM ({bm25_sql(10)}) JOIN documents d ON doc_id = chunk_key JOIN benchmark b ON item_id = query_id AND contains(d.text, b.text) GROUP BY 1) USING (query_id)""",
)
def _(spark, sf):
    c, q = X.corpus(spark, sf), X.queries(spark, sf)
    v = L.vocabulary(c)
    r = E.retrieval_eval(L.bm25_topk(c, q), E.containing_documents(c, q, v), 10)
    return r.select("query_id", "n_relevant", "hits", F.round("recall", 6).alias("recall"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(
    "latency_profile",
    """SELECT event_type, count(*) AS n_runs, round(avg(value), 6) AS avg, round(median(value), 6) AS median, round(list_sort(list(value))[floor((count(*) - 1) * 0.95 + 0.5)::BIGINT + 1], 6) AS p95, max(value) AS max,
 list_sort(list(value))[floor((count(*) - 1) * 0.95 + 0.5)::BIGINT + 1] <= 25.0 AS passes FROM events GROUP BY event_type""",
)
def _(spark, sf):
    p = E.latency_profile(X.table(spark, sf, "events"), "event_type", "value", 25.0)
    return p.select("event_type", "n_runs", F.round("avg", 6).alias("avg"), F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "max", "passes")


@query("paired_sample")
def _(spark, sf):
    """Two documents of every text that occurs more than once, in seeded order."""
    d = X.table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("concept"))
    many = d.groupBy("concept").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("concept")
    return top_k_per(d.join(many, "concept", "left_semi"), ["concept"], [F.xxhash64(F.lit(7), "doc_id").asc()], 2, "variant").select(
        "concept", "doc_id", F.col("variant").cast("bigint"))


@query(
    "qa_rollup",
    """SELECT event_type AS category, status, count(*) AS n_runs, round(avg(value), 6) AS avg_duration, grouping(event_type) + grouping(status) AS level FROM (SELECT *, CASE WHEN value <= 25 THEN 'PASS' ELSE 'FAIL' END AS status FROM events) GROUP BY ROLLUP (event_type, status)""",
)
def _(spark, sf):
    e = X.table(spark, sf, "events").select(F.col("event_type").alias("category"), F.when(F.col("value") <= 25, "PASS").otherwise("FAIL").alias("status"), "value")
    return e.rollup("category", "status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.round(F.avg("value"), 6).alias("avg_duration"), (F.grouping("category") + F.grouping("status")).cast("bigint").alias("level"))


_AUD = """SELECT file_key, n_chunks, lo = 0 AND hi = n_chunks - 1 AS contiguous, t0 = t1 AND t0 = n_chunks AS total_ok, min_chars, max_chars, round(avg_chars, 6) AS avg_chars, n_empty,
 CASE WHEN lo = 0 AND hi = n_chunks - 1 AND t0 = t1 AND t0 = n_chunks AND n_empty = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT file_key, count(*) AS n_chunks, min(chunk_id) AS lo, max(chunk_id) AS hi, min(total_chunks) AS t0, max(total_chunks) AS t1,
 min(length(text)) AS min_chars, max(length(text)) AS max_chars, avg(length(text)) AS avg_chars, count(*) FILTER (trim(text) = '') AS n_empty FROM ({c}) GROUP BY file_key)"""


@query("chunk_audit", _AUD.format(c=X.CHUNKS_SQL))
def _(spark, sf):
    a = E.chunk_audit(X.chunks(spark, sf), ["file_key"])
    return a.withColumn("avg_chars", F.round("avg_chars", 6))


@query(
    "overlap_estimate",
    f"""SELECT doc_id, part, coalesce(list_max(list_filter(range(1, least(220, len(a), len(b)) + 1), lambda n: a[len(a) - n + 1 : len(a)] = b[1:n])), 0) AS overlap_words FROM (
 SELECT doc_id, part, regexp_extract_all(lower(t), '[a-z0-9_+#.-]+') AS a, regexp_extract_all(lower(nt), '[a-z0-9_+#.-]+') AS b FROM (SELECT doc_id, part, t, lead(t) OVER (PARTITION BY doc_id ORDER BY part) AS nt FROM (SELECT doc_id, part, {_CHUNKT} AS t FROM ({_WIN1}))) WHERE nt IS NOT NULL)""",
)
def _(spark, sf):
    w = S.window_chunks(X.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "part", "chunk_text")
    return E.overlap_estimate(w)


@query(
    "kb_health",
    f"""SELECT d.doc_id, coalesce(n, 0) AS n_chunks, CASE WHEN source = 'src7' THEN 'unsupported' WHEN m.doc_id IS NULL THEN 'missing' WHEN m.skip_reason LIKE 'text too short%' THEN 'skipped' WHEN coalesce(n, 0) = 0 THEN 'zero_chunk' ELSE 'ok' END AS status
 FROM documents d LEFT JOIN ({CQ._OLD}) m USING (doc_id) LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) USING (doc_id)""".replace("WHEN source =", "WHEN d.source ="),
)
def _(spark, sf):
    s = X.table(spark, sf, "documents").select("doc_id", (F.col("source") != "src7").alias("supported"))
    n = X.table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return E.kb_health(s, CQ.old_manifest(spark, sf), n)


@query(
    "lifecycle_presence",
    f"""SELECT doc_id, change, CASE WHEN change = 'deleted' THEN n IS NULL ELSE n IS NOT NULL END AS presence_ok FROM ({CQ._DIFF}) LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({CQ._NEW}) GROUP BY 1) USING (doc_id)""",
)
def _(spark, sf):
    from corpusloom.operators import catalog as C

    diff = C.manifest_diff(CQ.old_manifest(spark, sf), CQ.new_manifest(spark, sf))
    after = C.apply_delta(CQ.old_scan(spark, sf).select("doc_id"), diff, CQ.new_scan(spark, sf).select("doc_id")).distinct().withColumn("n", F.lit(1))
    j = diff.join(after, "doc_id", "left")
    return j.select("doc_id", "change", F.when(F.col("change") == "deleted", F.col("n").isNull()).otherwise(F.col("n").isNotNull()).alias("presence_ok"))
