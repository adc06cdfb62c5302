"""Structured Streaming forms of corpus upkeep and run logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.conversation import extract_topic
from corpusloom.operators.structure import ingest_corpus


def read_table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def windowed_latency(runs: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Runs, mean and maximum duration per event-time window and category; batch and stream alike."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = runs.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("value").alias("avg"), F.max("value").alias("max"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n_runs", "avg", "max")


def stream_latency(runs: DataFrame, delay: str = "2 hours", window: str = "1 day") -> DataFrame:
    return windowed_latency(runs.withWatermark("ts", delay), window)


def stream_dedupe(events: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """Upserts by stable id: the first arrival within the watermark wins."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def session_activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user by inactivity gap; ``session_window`` merges map-side and shuffles by user and session."""
    g = events.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("first").alias("session_start"), F.col("last").alias("session_last"), "n_events")


def stream_sessions(events: DataFrame, delay: str = "2 hours", gap: str = "30 minutes") -> DataFrame:
    """``session_activity`` over a stream: a session is emitted once, when the watermark has passed its gap."""
    return session_activity(events.withWatermark("ts", delay), gap)


def stream_topics(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, own_topic, current_topic`` of a stream of turns, as ``conversation.topic_fill`` gives them.

    The latest topic of every conversation is state, so a turn finds topics of earlier micro-batches and of runs before a
    restart.  Turns of a conversation must arrive in order over micro-batches; inside one they are put in order.
    """
    kind = dict(turns.dtypes)["conv_id"]

    def fill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        topic = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("turn")
        current = []
        for own in rows["own_topic"]:
            current.append(topic)
            topic = own if isinstance(own, str) else topic
        state.update((topic,))
        yield rows.assign(current_topic=current)[["conv_id", "turn", "own_topic", "current_topic"]]

    own = extract_topic(turns).select("conv_id", "turn", "own_topic")
    out = f"conv_id {kind}, turn long, own_topic string, current_topic string"
    return own.withColumn("turn", F.col("turn").cast("long")).groupBy("conv_id").applyInPandasWithState(fill, out, "topic string", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes everything that is available and stops; exactly-once through the file sink's log."""
    q: StreamingQuery = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stream_ingest(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Follows a stream of document changes (``doc_id, source, text, deleted, seq``).

    Every micro-batch is one delta: the last change of each document in the batch (by ``seq``) and the chunks
    of what it did not delete, each in a folder named by the batch, so a replayed batch overwrites itself and
    no published row is rewritten.  ``ingested`` reads the table as of the last finished batch.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("doc_id").agg(F.max_by(F.struct("source", "text", "deleted"), "seq").alias("d")).select("doc_id", "d.*")
        ingest_corpus(last.where("not deleted").select("doc_id", "source", "text")).write.mode("overwrite").parquet(f"{out}/chunks/batch={epoch}")
        last.select("doc_id", "deleted").write.mode("overwrite").parquet(f"{out}/changes/batch={epoch}")

    changes.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the documents that are there now: each document's last batch wins, deleted ones are gone.

    Chunk numbers of a source hold inside a batch; ``number_chunks`` renumbers a snapshot.
    """
    changes = spark.read.parquet(f"{out}/changes")
    heads = changes.groupBy("doc_id").agg(F.max("batch").alias("batch"), F.max_by("deleted", "batch").alias("deleted")).where("not deleted")
    return spark.read.parquet(f"{out}/chunks").join(heads.select("doc_id", "batch"), ["doc_id", "batch"], "left_semi").drop("batch")
