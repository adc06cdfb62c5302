"""Streaming queries and their batch twins on ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.plans import conversation_queries as CQ
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans import structure_queries as SQ
from corpusloom.plans.registry import query
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.streaming import streams as S


def _run_dir(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events_stream(spark, sf):
    e = S.read_table_stream(spark, f"{sf}/event[s].parquet", X.table(spark, sf, "events").schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


_TS = lambda c: F.col(c).cast("timestamp_ntz").alias(c)


@query(
    "stream_latency",
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n_runs, round(avg(value), 6) AS avg, max(value) AS max FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    w = S.windowed_latency(X.table(spark, sf, "events"))
    return w.select(_TS("window_start"), "event_type", "n_runs", F.round("avg", 6).alias("avg"), "max")


@query("stream_latency_live")
def _(spark, sf):
    """The same windows from a watermarked stream; only windows the watermark has closed are emitted."""
    d = _run_dir(spark)
    S.run_available(S.stream_latency(_events_stream(spark, sf)), f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out")


@query(
    "session_activity",
    """SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT AS new FROM events)) GROUP BY user_id, s""",
)
def _(spark, sf):
    a = S.session_activity(X.table(spark, sf, "events"))
    return a.select("user_id", _TS("session_start"), _TS("session_last"), "n_events")


@query(
    "session_activity_live",
    """SELECT user_id, min(ts) AS session_start, max(ts) AS session_last, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT AS new FROM events))
 GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM events)""",
)
def _(spark, sf):
    """Sessions from a watermarked stream; those that the watermark has not closed are still state."""
    d = _run_dir(spark)
    S.run_available(S.stream_sessions(_events_stream(spark, sf)), f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out").select("user_id", _TS("session_start"), _TS("session_last"), "n_events")


@query("stream_topics", CQ.TOPIC_FILL_SQL)
def _(spark, sf):
    """Turns of all conversations as a stream, with the topic carried as state."""
    d = _run_dir(spark)
    t = S.read_table_stream(spark, f"{sf}/conversation[s].parquet", X.table(spark, sf, "conversations").schema)
    S.run_available(S.stream_topics(t.withColumnRenamed("text", "question")), f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out").select(*CQ.TOPIC_FILL_COLUMNS)


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    """Every event sent twice; each id is kept once."""
    d = _run_dir(spark)
    e = _events_stream(spark, sf)
    S.run_available(S.stream_dedupe(e.unionByName(e), "event_id"), f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out").select("event_id", "user_id", "event_type")


_AFTER = """(SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN concat(text, ' and some more words') ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0)"""
_FINAL = SQ._WIN.format(t=D.squash("c"), src=f"(SELECT doc_id, source, {SQ._CLEAN} AS c FROM {_AFTER} WHERE {SQ._SKIP} IS NULL)")


@query("stream_ingest", f"SELECT doc_id, source, part, parts, {SQ._CHUNKT} AS chunk_text FROM ({_FINAL})")
def _(spark, sf):
    """Three batches: all documents, changed ones, deleted ones."""
    d = _run_dir(spark)
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" and some more words")))
    deleted = docs.where("doc_id % 11 = 0").withColumn("text", F.lit(None).cast("string"))
    for seq, rows in enumerate((docs, changed, deleted)):
        step = rows.withColumn("deleted", F.lit(seq == 2)).withColumn("seq", F.lit(seq).cast("long"))
        step.write.mode("append").parquet(f"{d}/in")
        S.stream_ingest(S.read_table_stream(spark, f"{d}/in", step.schema), f"{d}/out", f"{d}/ckpt")
    return S.ingested(spark, f"{d}/out").select("doc_id", "source", "part", "parts", "chunk_text")
