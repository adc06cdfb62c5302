"""Case evaluation, latency, audit and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.scale import block_row_number, block_scan


def contains_any(answer: Column, alternatives: Column) -> Column:
    """Any alternative occurs; two-word names may have up to two words between."""

    def hit(alt: Column) -> Column:
        t = F.split(alt, " ")
        pair = (F.size(t) == 2) & (F.length(F.get(t, F.lit(0))) >= 3) & (F.length(F.get(t, F.lit(1))) >= 3)
        pat = F.concat(F.lit(r"\b"), F.get(t, F.lit(0)), F.lit(r"\b(?:\s+[a-z0-9]+){0,2}\s+\b"), F.get(t, F.lit(1)), F.lit(r"\b"))
        return (alt != "") & (answer.contains(alt) | (pair & F.regexp_like(answer, pat)))

    return F.exists(alternatives, hit)


def evaluate_answer(cases: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reasons``.

    ``cases`` holds normalised arrays: ``answer, matched, exact_answer, required_groups,
    forbidden_terms, pool_terms, minimum_pool_matches, minimum_bullets``.
    """
    c = cases.withColumn("na", T.normalize_text("answer"))
    missing = F.size(F.filter("required_groups", lambda g: ~contains_any(F.col("na"), g)))
    banned = F.size(F.filter("forbidden_terms", lambda t: F.col("na").contains(t)))
    pool = F.size(F.filter(F.array_distinct("pool_terms"), lambda t: F.col("na").contains(t)))
    bullets = F.regexp_count("answer", F.lit(r"(?m)^\s*[-*]\s+\S"))
    c = c.withColumns({"missing": missing, "banned": banned, "pool": pool, "bullets": bullets})
    reasons = F.concat_ws(
        "; ", F.when(F.col("missing") > 0, F.concat(F.lit("missing groups: "), F.col("missing"))),
        F.when(F.col("banned") > 0, F.concat(F.lit("forbidden terms: "), F.col("banned"))),
        F.when(F.col("pool") < F.col("minimum_pool_matches"), F.concat(F.lit("pool matches: "), F.col("pool"))),
        F.when(F.col("bullets") < F.col("minimum_bullets"), F.concat(F.lit("bullets: "), F.col("bullets"))))
    exact = F.col("exact_answer") != ""
    same = F.col("na") == T.normalize_text("exact_answer")
    status = F.when(~F.col("matched"), "MANUAL CHECK").when(exact, F.when(same, "PASS").otherwise("FAIL")).when(reasons == "", "PASS").otherwise("FAIL")
    return c.withColumns({"status": status, "reasons": F.when(F.col("matched") & ~exact, reasons).otherwise("")})


def match_case(questions: DataFrame, cases: DataFrame) -> DataFrame:
    """Case id by normalised question or alias; otherwise an id made from the question's hash.

    ``questions(question_id, question)``, ``cases(case_id, alias)``.
    """
    q = questions.withColumn("nq", T.normalize_text("question"))
    a = cases.select(T.normalize_text("alias").alias("nq"), "case_id").groupBy("nq").agg(F.min("case_id").alias("case_id"))
    auto = F.concat(F.lit("AUTO-"), F.upper(F.substring(F.sha1("nq"), 1, 8)))
    return q.join(a, "nq", "left").select("question_id", F.coalesce("case_id", auto).alias("case_id"), F.col("case_id").isNotNull().alias("matched"))


def run_numbering(runs: DataFrame, keys: list[str], order: str, total_runs: int) -> DataFrame:
    r = block_row_number(runs, keys, order, "n", width=1 << 20)
    return r.withColumns({"run_number": (F.col("n") - 1) % total_runs + 1, "cycle_number": F.floor((F.col("n") - 1) / total_runs) + 1}).drop("n")


def retrieval_eval(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: relevant documents, hits in the first k, recall, reciprocal rank."""
    hit = ranked.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_key"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("rank").alias("best"))
    n = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    j = n.join(hit, "query_id", "left")
    h = F.coalesce("hits", F.lit(0))
    return j.select("query_id", "n_relevant", h.alias("hits"), (h / F.col("n_relevant")).alias("recall"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))


def containing_documents(chunks: DataFrame, queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """Documents that contain a query's whole text, found by an equi join on its rarest token."""
    from corpusloom.operators.scale import fits, join_lookup, top_k_per

    t = queries.select("query_id", F.explode(F.array_distinct(T.tokenize("query"))).alias("term")).join(vocab.select("term", "df"), "term")
    rare = top_k_per(t, ["query_id"], [F.col("df").asc(), F.col("term").asc()], 1, "r").select("query_id", "term")
    toks = chunks.select("chunk_key", F.array_distinct(T.tokenize("text")).alias("ts")).select("chunk_key", F.explode("ts").alias("term"))
    j = join_lookup(toks, rare, ["term"], ["chunk_key"], fits(queries, 10_000)).select("chunk_key", "query_id")
    j = j.join(chunks.select("chunk_key", "text"), "chunk_key").join(queries.select("query_id", "query"), "query_id")
    return j.where(F.contains("text", "query")).select("query_id", "chunk_key")


def latency_profile(runs: DataFrame, key: str, value: str, limit: float) -> DataFrame:
    """avg, median, nearest-rank p95 (row ``round(0.95 (n - 1))``), max and pass flag per key.

    Exact order statistics from a value histogram: no group is ever sorted in one task.
    """
    hist = runs.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    cum = block_scan(hist, [key], "v", total={"upto": F.col("n")}, width=16)
    g = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    n = F.col("n_runs")
    g = g.withColumns({"i95": F.floor((n - 1) * 0.95 + 0.5), "lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2)})
    at = lambda i: F.min(F.when(F.col("upto") > F.col(i), F.col("v")))
    s = cum.join(g, key).groupBy(key, "n_runs", "avg", "max").agg(at("i95").alias("p95"), ((at("lo") + at("hi")) / 2).alias("median"))
    return s.withColumn("passes", F.col("p95") <= limit)


def chunk_audit(chunks: DataFrame, per: list[str]) -> DataFrame:
    """Per file: contiguity, total consistency, character statistics, empty chunks, verdict."""
    n = F.length("text")
    g = chunks.groupBy(*per).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi"), F.min("total_chunks").alias("t0"), F.max("total_chunks").alias("t1"),
        F.min(n).cast("bigint").alias("min_chars"), F.max(n).cast("bigint").alias("max_chars"), F.avg(n).alias("avg_chars"),
        F.sum((F.trim("text") == "").cast("bigint")).alias("n_empty"))
    contiguous = (F.col("lo") == 0) & (F.col("hi") == F.col("n_chunks") - 1)
    total_ok = (F.col("t0") == F.col("t1")) & (F.col("t0") == F.col("n_chunks"))
    return g.select(*per, "n_chunks", contiguous.alias("contiguous"), total_ok.alias("total_ok"), "min_chars", "max_chars", "avg_chars", "n_empty",
                    F.when(contiguous & total_ok & (F.col("n_empty") == 0), "PASS").otherwise("FAIL").alias("verdict"))


WORD = r"([a-z0-9_+#.-]+)"


def overlap_estimate(parts: DataFrame, limit: int = 220) -> DataFrame:
    """Longest suffix-prefix word overlap of consecutive parts (``doc_id, part, chunk_text``)."""
    p = block_scan(parts, ["doc_id"], "part", lead={"next_text": F.col("chunk_text")}).where("next_text IS NOT NULL")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))
    p = p.select("doc_id", "part", words("chunk_text").alias("a"), words("next_text").alias("b"))
    top = F.least(F.lit(limit), F.size("a"), F.size("b"))
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), top)), lambda n: F.slice("a", -n, n) == F.slice("b", F.lit(1), n))
    return p.select("doc_id", "part", F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint").alias("overlap_words"))


def kb_health(sources: DataFrame, manifest: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Status per source document: unsupported, missing, skipped, zero-chunk or ok."""
    m = manifest.select("doc_id", "skip_reason", F.lit(True).alias("in_manifest"))
    j = sources.join(m, "doc_id", "left").join(chunk_counts, "doc_id", "left")
    benign = F.col("skip_reason").startswith("text too short")
    status = (
        F.when(~F.col("supported"), "unsupported").when(F.col("in_manifest").isNull(), "missing").when(benign, "skipped")
        .when(F.col("skip_reason").isNotNull(), "failed").when(F.coalesce("n_chunks", F.lit(0)) == 0, "zero_chunk").otherwise("ok"))
    return j.select("doc_id", F.coalesce("n_chunks", F.lit(0)).cast("bigint").alias("n_chunks"), status.alias("status"))
