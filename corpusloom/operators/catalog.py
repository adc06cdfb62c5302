"""Corpus change tracking: manifests, diffs, incremental maintenance, checks.

A manifest is ``doc_id, hash, size, mtime_ns`` plus the index signature columns
``schema_version, model, normalized`` and ``status, skip_reason, last_indexed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNATURE_DEFAULTS = {"schema_version": "v4", "model": "m1", "normalized": True}


def index_signature(prefix: str = "") -> Column:
    """Signature struct; rows written before a field existed get its default."""
    c = lambda n: F.coalesce(F.col(prefix + n), F.lit(SIGNATURE_DEFAULTS[n])).alias(n)
    return F.struct(*[c(n) for n in SIGNATURE_DEFAULTS])


def build_manifest(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Manifest of the current scan (``doc_id, size, mtime_ns, content_hash, model, schema_version, normalized``).

    The stored hash is kept when size and time are unchanged; index state is kept when
    hash and signature are.  ``content_hash`` is computed inside the scan, so texts never
    reach the join.
    """
    p = previous.select(
        "doc_id", F.col("hash").alias("p_hash"), F.col("size").alias("p_size"), F.col("mtime_ns").alias("p_mtime"),
        index_signature().alias("p_sig"), F.col("status").alias("p_status"), F.col("skip_reason").alias("p_skip"),
        F.col("last_indexed").alias("p_last"))
    j = current.join(p, "doc_id", "left").withColumn("sig", index_signature())
    same_stat = F.coalesce((F.col("size") == F.col("p_size")) & (F.col("mtime_ns") == F.col("p_mtime")), F.lit(False))
    j = j.withColumn("hash_reused", same_stat)
    j = j.withColumn("hash", F.when(same_stat, F.col("p_hash")).otherwise(F.col("content_hash")))
    keep = F.col("p_hash").eqNullSafe(F.col("hash")) & F.col("p_sig").eqNullSafe(F.col("sig"))
    return j.select(
        "doc_id", "hash", "size", "mtime_ns", "schema_version", "model", "normalized", "hash_reused",
        F.when(keep, F.col("p_last")).alias("last_indexed"), F.when(keep, F.col("p_status")).otherwise("pending").alias("status"),
        F.when(keep, F.col("p_skip")).alias("skip_reason"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``doc_id, change``: added, deleted, updated (hash or signature differs) or unchanged."""
    o = old.select("doc_id", F.col("hash").alias("o_hash"), index_signature().alias("o_sig"), F.lit(True).alias("in_old"))
    n = new.select("doc_id", F.col("hash").alias("n_hash"), index_signature().alias("n_sig"), F.lit(True).alias("in_new"))
    same = F.col("o_hash").eqNullSafe(F.col("n_hash")) & F.col("o_sig").eqNullSafe(F.col("n_sig"))
    change = (
        F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(same, "unchanged").otherwise("updated"))
    return o.join(n, "doc_id", "full_outer").select("doc_id", change.alias("change"))


def update_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: mode (full_rebuild, noop, incremental), reason and change counts."""
    d = manifest_diff(old, new)
    counts = [F.coalesce(F.sum(F.when(F.col("change") == c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"n_{c}")
              for c in ("added", "updated", "deleted", "unchanged")]
    n_old = F.sum(F.when(F.col("change") != "added", 1).otherwise(0))
    g = d.agg(*counts, F.coalesce(n_old, F.lit(0)).cast("bigint").alias("n_old"))
    sigs = old.select(index_signature().alias("s")).unionByName(new.select(index_signature().alias("s"))).distinct()
    g = g.withColumn("n_signatures", sigs.agg(F.count(F.lit(1)).alias("n")).scalar())
    changes = F.col("n_added") + F.col("n_updated") + F.col("n_deleted")
    mode = F.when((F.col("n_old") == 0) | (F.col("n_signatures") > 1), "full_rebuild").when(changes == 0, "noop").otherwise("incremental")
    reason = (
        F.when(F.col("n_old") == 0, "no previous manifest").when(F.col("n_signatures") > 1, "index signature changed")
        .when(changes == 0, "no changes").otherwise("documents changed"))
    return g.select(mode.alias("mode"), reason.alias("reason"), "n_added", "n_updated", "n_deleted", "n_unchanged")


def apply_delta(chunks: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunk table after a change: stale rows out, fresh rows of added and updated documents in."""
    gone = diff.where(F.col("change").isin("updated", "deleted")).select("doc_id")
    into = diff.where(F.col("change").isin("updated", "added")).select("doc_id")
    kept = chunks.join(gone, "doc_id", "left_anti")
    return kept.unionByName(fresh.join(into, "doc_id", "left_semi"))


def missing_chunks(chunks: DataFrame, diff: DataFrame, previous: DataFrame) -> DataFrame:
    """Changed documents whose old chunks cannot be found and were not skipped: the update must refuse."""
    changed = diff.where(F.col("change").isin("updated", "deleted"))
    indexed = previous.where("skip_reason IS NULL").select("doc_id")
    return changed.join(indexed, "doc_id", "left_semi").join(chunks.select("doc_id"), "doc_id", "left_anti")


def count_reconcile(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row comparing chunk and vector tables: counts, gaps, dimensions, verdict."""
    c = chunks.select("chunk_key", F.lit(1).alias("c"))
    v = vectors.select("chunk_key", F.size("embedding").alias("dim"))
    g = c.join(v, "chunk_key", "full_outer").agg(
        F.count("c").alias("n_chunks"), F.count("dim").alias("n_vectors"),
        F.sum(F.when(F.col("dim").isNull(), 1).otherwise(0)).cast("bigint").alias("chunks_without_vector"),
        F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).cast("bigint").alias("vectors_without_chunk"),
        F.min("dim").cast("bigint").alias("min_dim"), F.max("dim").cast("bigint").alias("max_dim"))
    ok = (F.col("chunks_without_vector") == 0) & (F.col("vectors_without_chunk") == 0) & (F.col("min_dim") == F.col("max_dim"))
    return g.withColumn("consistent", ok)


def source_stability(planned: DataFrame, current: DataFrame) -> DataFrame:
    """One row: did the file set and hashes stay as planned."""
    a = planned.select("doc_id", "hash").exceptAll(current.select("doc_id", "hash")).select(F.lit("planned_only").alias("side"))
    b = current.select("doc_id", "hash").exceptAll(planned.select("doc_id", "hash")).select(F.lit("current_only").alias("side"))
    g = a.unionByName(b).agg(
        F.coalesce(F.sum(F.when(F.col("side") == "planned_only", 1)), F.lit(0)).cast("bigint").alias("planned_only"),
        F.coalesce(F.sum(F.when(F.col("side") == "current_only", 1)), F.lit(0)).cast("bigint").alias("current_only"))
    return g.withColumn("stable", (F.col("planned_only") == 0) & (F.col("current_only") == 0))


def match_doc_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a document by its current path or the path it was indexed under: two equi joins."""
    by = lambda col: docs.select("doc_id", F.col(col).alias("path")).join(chunks, "path").select("doc_id", "chunk_key")
    return by("current_path").unionByName(by("indexed_path")).distinct()
