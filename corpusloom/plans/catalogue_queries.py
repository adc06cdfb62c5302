"""Change tracking queries: two snapshots of the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import catalog as C
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import _CLEAN
from corpusloom.session import ensure_checkpoint_dir

# Old snapshot: everything except the Spanish documents.  New snapshot: everything that is
# not labelled toxic, with the sources src1* cleaned.


def _sig(df, model):
    return df.withColumns({"schema_version": F.lit(None).cast("string"), "model": model, "normalized": F.lit(True)})


def old_scan(spark, sf):
    d = X.table(spark, sf, "documents").where("lang <> 'es'").select("doc_id", "source", "lang", "text")
    d = d.withColumns({"size": F.length("text").cast("bigint"), "mtime_ns": F.col("doc_id") * 1000000000})
    return _sig(d.withColumn("content_hash", T.content_hash("text")), F.lit("m1"))


def new_scan(spark, sf):
    toxic = X.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    d = X.table(spark, sf, "documents").join(toxic, "doc_id", "left_anti")
    t = F.when(F.col("source").startswith("src1"), T.clean_text("text")).otherwise(F.col("text"))
    d = d.select("doc_id", "source", "lang", t.alias("text"), (t != F.col("text")).cast("bigint").alias("touched"))
    d = d.withColumns({"size": F.length("text").cast("bigint"), "mtime_ns": F.col("doc_id") * 1000000000 + F.col("touched")})
    return _sig(d.withColumn("content_hash", T.content_hash("text")), F.when(F.col("lang") == "fr", "m2").otherwise("m1"))


def old_manifest(spark, sf):
    short = F.when(F.length("text") < 50, F.concat(F.lit("text too short: "), F.length("text").cast("string")))
    return old_scan(spark, sf).withColumns({
        "hash": F.col("content_hash"), "skip_reason": short, "status": F.when(short.isNull(), "indexed").otherwise("skipped"),
        "last_indexed": F.lit("2024-01-01 00:00:00")}).drop("text", "content_hash")


def new_manifest(spark, sf):
    return new_scan(spark, sf).withColumn("hash", F.col("content_hash"))


_OLD = """SELECT doc_id, source, lang, text, length(text) AS size, doc_id * 1000000000 AS mtime_ns, sha256(text) AS hash, 'm1' AS model,
 CASE WHEN length(text) < 50 THEN 'text too short: ' || length(text) END AS skip_reason FROM documents WHERE lang <> 'es'"""
_NEW = f"""SELECT *, length(text) AS size, doc_id * 1000000000 + touched AS mtime_ns, sha256(text) AS hash, CASE WHEN lang = 'fr' THEN 'm2' ELSE 'm1' END AS model FROM (
 SELECT doc_id, source, lang, CASE WHEN source LIKE 'src1%' THEN {_CLEAN} ELSE text END AS text, (CASE WHEN source LIKE 'src1%' THEN {_CLEAN} ELSE text END <> text)::BIGINT AS touched
 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
_DIFF = f"""SELECT doc_id, CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash AND o.model = n.model THEN 'unchanged' ELSE 'updated' END AS change
 FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id)"""


@query(
    "build_manifest",
    f"""SELECT n.doc_id, CASE WHEN s THEN o.hash ELSE n.hash END AS hash, s AS hash_reused, CASE WHEN k THEN '2024-01-01 00:00:00' END AS last_indexed,
 CASE WHEN k THEN CASE WHEN o.skip_reason IS NULL THEN 'indexed' ELSE 'skipped' END ELSE 'pending' END AS status, CASE WHEN k THEN o.skip_reason END AS skip_reason FROM (
 SELECT n.doc_id, coalesce(o.size = n.size AND o.mtime_ns = n.mtime_ns, false) AS s, coalesce((CASE WHEN o.size = n.size AND o.mtime_ns = n.mtime_ns THEN o.hash ELSE n.hash END) = o.hash AND o.model = n.model, false) AS k
 FROM ({_NEW}) n LEFT JOIN ({_OLD}) o USING (doc_id)) f JOIN ({_NEW}) n USING (doc_id) LEFT JOIN ({_OLD}) o USING (doc_id)""",
)
def _(spark, sf):
    m = C.build_manifest(new_scan(spark, sf).drop("text"), old_manifest(spark, sf))
    return m.select("doc_id", "hash", "hash_reused", "last_indexed", "status", "skip_reason")


@query("manifest_diff", _DIFF)
def _(spark, sf):
    return C.manifest_diff(old_manifest(spark, sf), new_manifest(spark, sf))


@query("index_signature", f"SELECT doc_id, 'v4' AS schema_version, model, true AS normalized FROM ({_NEW})")
def _(spark, sf):
    return new_manifest(spark, sf).select("doc_id", C.index_signature().alias("s")).select("doc_id", "s.*")


@query(
    "update_plan",
    f"""SELECT CASE WHEN n_sig > 1 THEN 'full_rebuild' WHEN a + u + d = 0 THEN 'noop' ELSE 'incremental' END AS mode,
 CASE WHEN n_sig > 1 THEN 'index signature changed' WHEN a + u + d = 0 THEN 'no changes' ELSE 'documents changed' END AS reason, a AS n_added, u AS n_updated, d AS n_deleted, x AS n_unchanged FROM (
 SELECT count(*) FILTER (change = 'added') AS a, count(*) FILTER (change = 'updated') AS u, count(*) FILTER (change = 'deleted') AS d, count(*) FILTER (change = 'unchanged') AS x,
 (SELECT count(DISTINCT model) FROM (SELECT model FROM ({_OLD}) UNION ALL SELECT model FROM ({_NEW}))) AS n_sig FROM ({_DIFF}))""",
)
def _(spark, sf):
    return C.update_plan(old_manifest(spark, sf), new_manifest(spark, sf))


@query(
    "apply_delta",
    f"""SELECT o.doc_id, md5(o.text) AS text_hash FROM ({_OLD}) o JOIN ({_DIFF}) d USING (doc_id) WHERE change = 'unchanged'
 UNION ALL SELECT n.doc_id, md5(n.text) FROM ({_NEW}) n JOIN ({_DIFF}) d USING (doc_id) WHERE change IN ('added', 'updated')""",
)
def _(spark, sf):
    diff = C.manifest_diff(old_manifest(spark, sf), new_manifest(spark, sf))
    hashed = lambda df: df.select("doc_id", F.md5("text").alias("text_hash"))
    return C.apply_delta(hashed(old_scan(spark, sf)), diff, hashed(new_scan(spark, sf)))


@query(
    "missing_chunks",
    f"SELECT doc_id, change FROM ({_DIFF}) JOIN ({_OLD}) o USING (doc_id) WHERE change IN ('updated', 'deleted') AND skip_reason IS NULL AND doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def _(spark, sf):
    diff = C.manifest_diff(old_manifest(spark, sf), new_manifest(spark, sf))
    held = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return C.missing_chunks(held, diff, old_manifest(spark, sf)).select("doc_id", "change")


@query(
    "count_reconcile",
    """SELECT *, chunks_without_vector = 0 AND vectors_without_chunk = 0 AND min_dim = max_dim AS consistent FROM (SELECT count(d.doc_id) AS n_chunks, count(e.vec_id) AS n_vectors,
 count(*) FILTER (e.vec_id IS NULL) AS chunks_without_vector, count(*) FILTER (d.doc_id IS NULL) AS vectors_without_chunk, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim
 FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id)""",
)
def _(spark, sf):
    v = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_key"), "embedding")
    return C.count_reconcile(X.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_key")), v)


@query(
    "source_stability",
    f"""SELECT *, planned_only = 0 AND current_only = 0 AS stable FROM (SELECT
 (SELECT count(*) FROM (SELECT doc_id, hash FROM ({_OLD}) EXCEPT ALL SELECT doc_id, hash FROM ({_NEW}))) AS planned_only,
 (SELECT count(*) FROM (SELECT doc_id, hash FROM ({_NEW}) EXCEPT ALL SELECT doc_id, hash FROM ({_OLD}))) AS current_only)""",
)
def _(spark, sf):
    return C.source_stability(old_manifest(spark, sf), new_manifest(spark, sf))


@query(
    "match_doc_chunks",
    """SELECT DISTINCT p.page_id AS doc_id, c.page_id AS chunk_key FROM pages p JOIN pages c ON lower(split_part(c.url, '?', 1)) = lower(split_part(p.url, '?', 1)) OR lower(split_part(c.url, '?', 1)) = lower(p.url)""",
)
def _(spark, sf):
    p = X.table(spark, sf, "pages")
    bare = T.squash(F.lower(F.substring_index("url", "?", 1)))
    docs = p.select(F.col("page_id").alias("doc_id"), bare.alias("current_path"), F.lower("url").alias("indexed_path"))
    return C.match_doc_chunks(docs, p.select(F.col("page_id").alias("chunk_key"), bare.alias("path")))


@query("full_rebuild")
def _(spark, sf):
    """Chunks of all documents published as a new version, read back through the pointer."""
    import uuid

    from corpusloom.operators.structure import ingest_corpus
    from corpusloom.sources.sinks import publish_version, read_published

    root = f"{ensure_checkpoint_dir(spark)}/published-{uuid.uuid4().hex}"
    chunks = ingest_corpus(X.table(spark, sf, "documents").select("doc_id", "source", "text"))
    publish_version({"chunks": (chunks, "doc_id")}, root)
    c = read_published(spark, root, "chunks")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))
