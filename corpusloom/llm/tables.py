"""Row keys, reliable checkpoints and hot-key-safe components for the operators of this package."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrays import release
from corpusloom.session import ensure_checkpoint_dir

ROW = "__row"


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; it survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stable(df: DataFrame) -> DataFrame:
    """``df`` if two scans of it split the same way: a file scan or a checkpoint; anything else is checkpointed."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    ops = (re.sub(r"^[\s:+|-]*", "", line) for line in plan.splitlines() if line.strip())
    return df if all(o.startswith(("Project", "Filter", "Relation", "LogicalRDD")) for o in ops) else saved(df)


def keyed(df: DataFrame) -> DataFrame:
    """Adds ``__row``, a unique integer that a second scan gives again."""
    return stable(df).withColumn(ROW, F.monotonically_increasing_id())


def boxed(df: DataFrame) -> DataFrame:
    """``__row`` and the whole row as ``__doc``, so that no column of it can clash with a helper's; ``df`` is stable."""
    return keyed(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc")))


#: Row keys sent to every task at once: 8 MB.
KEYS_SENT = 1_000_000


def split_by_keys(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ``df`` that may have one of the ``__row`` keys, and the rest if it could be told apart.

    Spares texts a shuffle before a join.  Keys are counted first and sent to every task only when they are
    few; with more of them all rows are returned, and the join that follows does the work.
    """
    keys = keys.select(ROW).distinct()
    if keys.limit(KEYS_SENT + 1).count() > KEYS_SENT:
        return df, None
    few = F.broadcast(keys)
    return df.join(few, ROW, "left_semi"), df.join(few, ROW, "left_anti")


#: Rows and bytes that a Python task takes at a time; its arrays are a few times that size.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session, for long texts the more so; ``df`` stays as it is."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def released(run):
    """``run`` for mapInArrow, which gives its memory back when a task begins and ends: Python workers live on."""

    def whole(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, under these names; other columns cannot clash with helper columns."""
    return bounded_batches(df).select(*columns)


#: Rows of a small table that one task works on.
ROWS_IN_TASK = 200_000


def fitted(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table in as many partitions as its rows need, never more than it has.

    A round over a few thousand edges then costs a few tasks and files, however many partitions the session has.
    """
    rows = df.count() if rows is None else rows
    return df.coalesce(rows // ROWS_IN_TASK + 1)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component = smallest node).

    Alternating large-star and small-star rounds; each round rewires edges towards the smallest
    neighbour, so a node with very many neighbours loses them within a few rounds, and the work per
    round is one aggregation and one join of edges.  Each round is checkpointed; nodes never meet on
    the driver, which sees only a count and a digest of the edges.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    e = saved(e)
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
    before = e.agg(*digest).first()
    while before[0]:
        few = before[0] // ROWS_IN_TASK + 1
        e = e.coalesce(few)
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("m").alias("u"), F.col("y").alias("v")).where("u < v").coalesce(few).distinct()
        # small star: a node and its smaller neighbours point to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("w"))
        linked = small.where("m < w").select(F.col("m").alias("u"), F.col("w").alias("v"))
        linked = linked.union(low.select(F.col("m").alias("u"), "v")).coalesce(few).distinct()
        new = saved(linked.coalesce(few))
        after = new.agg(*digest).first()
        e, same, before = new, after == before, after
        if same:
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
