"""Streams against their batch forms, with restarts between files."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators.conversation import topic_fill
from corpusloom.streaming import streams as S


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_topics_survive_restarts(spark, tmp_path):
    rng = np.random.default_rng(4)
    said = ["What is leave policy?", "tell me more", "Explain overtime pay", "it", "hello", "Who is Ada Byron?", None]
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", said[int(rng.integers(len(said)))]) for c in range(6) for t in range(12)]
    schema = "conv_id long, turn int, role string, question string"
    whole = spark.createDataFrame(turns, schema)
    for part in range(3):  # each run sees one more file and starts from the checkpoint
        whole.where(F.col("turn").between(part * 4, part * 4 + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.stream_topics(S.read_table_stream(spark, f"{tmp_path}/in", whole.schema))
        S.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    cols = ("conv_id", "turn", "own_topic", "current_topic")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), *cols) == rows(topic_fill(whole), *cols)


def test_sessions_close_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    day = dt.datetime(2024, 3, 1)
    events = sorted((day + dt.timedelta(minutes=int(m)), int(u)) for u, m in zip(rng.integers(0, 5, 300), rng.integers(0, 3000, 300)))
    schema = "ts timestamp, user_id int"
    for lo, hi in ((0, 150), (150, 300)):
        spark.createDataFrame(events[lo:hi], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = S.stream_sessions(S.read_table_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema), "1 hour")
        S.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    limit = events[-1][0] - dt.timedelta(hours=1)
    batch = S.session_activity(spark.createDataFrame(events, schema))
    cols = ("user_id", "session_start", "session_last", "n_events")
    closed = batch.where(F.col("session_last") + F.expr("interval 30 minutes") <= F.lit(limit))
    assert rows(spark.read.parquet(f"{tmp_path}/out"), *cols) == rows(closed, *cols) != []
