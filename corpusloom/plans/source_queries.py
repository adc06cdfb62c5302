"""Source and sink queries: files are first written from the given tables, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators.structure import ingest_corpus
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources import readers as R
from corpusloom.sources import sinks as K


def _dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _by_source(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", "source", "lang", "text")


@query("list_sources")
def _(spark, sf):
    """All table files of the data folder, treated as the corpus' supported extension."""
    return R.list_sources(spark, sf, ["parquet"]).select(F.substring_index("path", "/", -1).alias("file_name"), "size", "ext")


@query("scan_text")
def _(spark, sf):
    d = _dir(spark)
    _by_source(spark, sf).repartition("source").select("text").write.text(d)
    t = R.scan_text(spark, d)
    return t.select(F.substring_index("path", "/", -1).alias("file_name"), F.length("text").cast("bigint").alias("n_chars"))


@query(
    "scan_csv_as_text",
    """SELECT 'p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_size: ' || p_size AS text FROM part
 UNION ALL SELECT 's_suppkey: ' || s_suppkey || ' | s_name: ' || s_name AS text FROM supplier""",
)
def _(spark, sf):
    """Two tables with different headers in one folder."""
    d = _dir(spark)
    X.table(spark, sf, "part").select("p_partkey", "p_name", "p_size").write.option("header", True).csv(f"{d}/a")
    X.table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(f"{d}/b")
    return R.scan_csv_as_text(spark, d).select("text")


@query(
    "scan_json_as_text",
    """SELECT '{' || chr(10) || '  "conv_id": ' || conv_id || ',' || chr(10) || '  "turn": ' || turn || ',' || chr(10) || '  "role": ' || to_json(role) || ',' || chr(10)
 || '  "text": ' || to_json(text) || chr(10) || '}' AS text FROM conversations""",
)
def _(spark, sf):
    d = _dir(spark)
    X.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").write.json(d)
    return R.scan_json_as_text(spark, d).select("text")


@query(
    "scan_xml_as_text",
    """SELECT '<row>' || chr(10) || '    <s_name>' || s_name || '</s_name>' || chr(10) || '    <s_suppkey>' || s_suppkey || '</s_suppkey>' || chr(10) || '</row>' AS text FROM supplier""",
)
def _(spark, sf):
    d = _dir(spark)
    X.table(spark, sf, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "row").save(d)
    return R.scan_xml_as_text(spark, d, "row", glob="*").select("text")


def _html_sql() -> str:
    t = "html"
    for tag in ("script", "style", "head", "nav", "footer"):
        t = D.rsub(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = D.rsub(t, r"(?s)<!--.*?-->|<![A-Za-z][^>]*>", " ")
    t = D.rsub(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|section|tr|table)\b[^>]*>", "\n")
    t = D.rsub(t, r"<[^>]+>", "")
    for k, v in R.ENTITIES.items():
        t = f"replace({t}, {D.lit(k)}, {D.lit(v)})"
    t = D.rsub(D.rsub(t, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return "trim(" + D.rsub(t, r"^\s+|\s+$", "") + ")"


@query("scan_html_as_text", f"SELECT page_id, {_html_sql()} AS text FROM pages")
def _(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", R.html_to_text(F.col("html")).alias("text"))


@query(
    "flatten_parts",
    """SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM (SELECT doc_id, i, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE p <> '' GROUP BY doc_id""",
)
def _(spark, sf):
    p = X.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "p"))
    return R.flatten_parts(p, "doc_id", "i", "p")


@query(
    "loader_dispatch",
    """SELECT 'txt' AS ext, sum(length(text) + 1) AS n, 0 AS n_errors FROM documents UNION ALL
 SELECT 'csv', count(*), 0 FROM part UNION ALL SELECT 'json', count(*), 0 FROM conversations""",
)
def _(spark, sf):
    """Records by format; texts, which are whole files, by characters."""
    d = _dir(spark)
    _by_source(spark, sf).select("text").write.text(f"{d}/docs")
    X.table(spark, sf, "part").select("p_partkey", "p_name").write.option("header", True).csv(f"{d}/parts")
    X.table(spark, sf, "conversations").write.json(f"{d}/chats")
    r = R.loader_dispatch(spark, d)
    n = F.when(F.col("ext") == "txt", F.length("text")).otherwise(1)
    return r.groupBy("ext").agg(F.sum(n.cast("bigint")).alias("n"), F.sum(F.col("error").isNotNull().cast("bigint")).alias("n_errors"))


@query("scan_qa_runs", "SELECT event_type AS category, count(*) AS n_runs, round(sum(value), 4) AS seconds FROM events GROUP BY 1")
def _(spark, sf):
    """Events written as a 19-column run log and read back."""
    d = _dir(spark)
    e = X.table(spark, sf, "events")
    s = lambda c, v="": F.lit(v).alias(c)
    e.select(
        F.col("event_id").cast("string").alias("run_id"), s("test_case_id", "T"), F.col("event_type").alias("category"), s("description", 'a "quoted"\nline'), s("question"), s("expected_result"),
        s("actual_result"), s("status", "PASS"), F.lit(1).alias("run_number"), F.lit(1).alias("total_runs"), F.col("ts").cast("string").alias("started_at"), s("finished_at"),
        F.col("value").alias("duration_seconds"), F.lit(0).alias("accepted_chunks"), F.lit(0).alias("final_chunks"), s("fallback_used"), F.col("props").alias("sources"), s("error"), s("evidence_log"),
    ).write.option("header", True).option("escape", '"').csv(d)
    r = R.scan_qa_runs(spark, d)
    return r.groupBy("category").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.sum("duration_seconds"), 4).alias("seconds"))


@query("sink_chunks")
def _(spark, sf):
    """Chunks and their manifest published together under one version."""
    d = _dir(spark)
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    manifest = docs.select("doc_id", F.sha2("text", 256).alias("hash"))
    K.publish_version({"chunks": (ingest_corpus(docs), "doc_id"), "manifest": (manifest, "doc_id")}, d)
    c, m = K.read_published(spark, d, "chunks"), K.read_published(spark, d, "manifest")
    n = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return m.join(n, "doc_id", "left").select("doc_id", "hash", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


@query("sink_chunk_inventory")
def _(spark, sf):
    d = _dir(spark)
    K.write_inventory(X.chunks(spark, sf).select("file_key", "chunk_id", "total_chunks", "text"), d)
    r = spark.read.option("header", True).option("escape", '"').csv(d)
    return r.groupBy("file_key").agg(F.count(F.lit(1)).alias("n_rows"))
