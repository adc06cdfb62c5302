"""Skew-safe building blocks.

A window ``PARTITION BY key ORDER BY pos`` puts a whole key into one task.  When one
key can hold a third of the table that task never ends, so the ordered operators here
work in two levels: rows are windowed inside ``(key, block)`` where ``block`` is an
order-preserving slice of the position column, and only one summary row per block is
windowed per key.  Results are exact; the largest sort is one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir

BLOCK_WIDTH = 1 << 16
HOT_KEY_SALTS = 16
_B = "__block"


def _with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(carry, [*keys, _B], "left")


def block_row_number(
    df: DataFrame, keys: Sequence[str], order: str, out: str, width: int = BLOCK_WIDTH, total: str | None = None
) -> DataFrame:
    """1-based row number per key by a unique integer position, optionally with the key's row count."""
    keys = list(keys)
    rows = _with_block(df, order, width).repartition(*keys, _B)
    per_block = rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(
        *keys,
        _B,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
        F.sum("__n").over(Window.partitionBy(*keys)).alias("__total"),
    )
    local = Window.partitionBy(*keys, _B).orderBy(order)
    res = _join_carry(rows.withColumn("__local", F.row_number().over(local)), carry, keys)
    res = res.withColumn(out, (F.col("__local") + F.col("__before")).cast("bigint"))
    if total:
        res = res.withColumn(total, F.col("__total").cast("bigint"))
    return res.drop(_B, "__local", "__before", "__total")


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str) -> DataFrame:
    """First ``k`` rows per key.  With an int ``k`` Catalyst prunes to k rows per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w))
    return ranked.where(F.col(rank) <= k)


def salted_join(
    hot: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "inner", salts: int = HOT_KEY_SALTS
) -> DataFrame:
    """Equi join that spreads each hot key of ``hot`` over ``salts`` tasks.

    ``small`` is replicated ``salts`` times; Catalyst still broadcasts it when its
    statistics are under the session's threshold.
    """
    left = hot.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def two_level_count(df: DataFrame, keys: Sequence[str], distinct: Sequence[str], out: str) -> DataFrame:
    """``count(distinct ...)`` per key as two aggregations, so a hot key is never one task's set."""
    return df.select(*keys, *distinct).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


BROADCAST_ROWS = 200_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when a bounded count proves that ``df`` has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def join_lookup(
    big: DataFrame, lookup: DataFrame, on: Sequence[str], salt_by: Sequence[str], small: bool, how: str = "inner"
) -> DataFrame:
    """Join with a lookup side: broadcast when its size was checked, salted shuffle join otherwise."""
    if small:
        return big.join(F.broadcast(lookup), [*on], how)
    return salted_join(big, lookup, on, salt_by, how)


def materialized(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder: for results that several later steps read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows and bytes that a Python task takes at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches of the session, so that Python tasks on long texts stay small; ``df`` stays as it is."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


#: Rows of a task that ``spread`` makes, and the most tasks: so many files a shuffle writes without sorting or holding rows.
SPREAD_ROWS, SPREAD_TASKS = 5_000, 200


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals the rows of a scan by ``keys`` if it has fewer splits than cores or a few of its splits hold most rows.

    A file of one row group is read by one task, into how many splits it may be cut.  Rows go by the hash of their keys: dealing
    them in turn would sort every split in memory first.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    found = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    most, rows = found.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if df.rdd.getNumPartitions() >= cores and most * cores <= 2 * rows:
        return df
    return df.repartition(min(SPREAD_TASKS, max(cores, -(-rows // SPREAD_ROWS))), *keys)


def fence(df: DataFrame, key: str) -> DataFrame:
    """Stops later filters from being pushed below, and so re-evaluating, expensive columns.

    ``key`` must have few rows per value (candidates of one query).
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("__fence", n).where("__fence > 0").drop("__fence")


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fill: dict[str, Column] | None = None,
    fill_before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    lag: dict[str, Column] | None = None,
    lead: dict[str, Column] | None = None,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Several ordered computations per key in one two-level pass.

    ``fill``/``fill_before``: latest non-null value up to / strictly before the row;
    ``total``: inclusive running sum; ``lag``/``lead``: neighbouring row's value.
    """
    keys = list(keys)
    rows = _with_block(df, order, width)
    local = Window.partitionBy(*keys, _B).orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    below = local.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy(_B)
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    value, summary, carry, result = {}, {}, {}, {}
    inside = {}

    def add(name: str, col: Column, edge: Column, carried: Column, within: Column, final: Column) -> None:
        v = f"__v_{name}"
        value[v], summary[f"__s_{name}"], carry[f"__c_{name}"] = col, edge, carried
        inside[f"__w_{name}"], result[name] = within, final

    for group, frame in ((fill, upto), (fill_before, below)):
        for n, c in (group or {}).items():
            v = f"__v_{n}"
            add(n, c, F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))),
                F.last(f"__s_{n}", ignorenulls=True).over(earlier), F.last(v, ignorenulls=True).over(frame),
                F.coalesce(f"__w_{n}", f"__c_{n}"))
    for n, c in (total or {}).items():
        add(n, c.cast("bigint"), F.sum(f"__v_{n}"), F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)),
            F.sum(f"__v_{n}").over(upto), (F.col(f"__w_{n}") + F.col(f"__c_{n}")).cast("bigint"))
    for group, step, pick in ((lag, 1, F.max_by), (lead, -1, F.min_by)):
        for n, c in (group or {}).items():
            add(n, F.struct(c.alias("v")), pick(f"__v_{n}", order), F.lag(f"__s_{n}", step).over(blocks),
                F.lag(f"__v_{n}", step).over(local), F.coalesce(f"__w_{n}", f"__c_{n}").getField("v"))
    # One shuffle by (key, block) serves the local windows and the block summaries.
    rows = rows.withColumns(value).repartition(*keys, _B)
    per_block = rows.groupBy(*keys, _B).agg(*[e.alias(n) for n, e in summary.items()])
    carried = per_block.select(*keys, _B, *[e.alias(n) for n, e in carry.items()])
    out = _join_carry(rows.withColumns(inside), carried, keys)
    return out.select(*[F.col(c) for c in df.columns], *[e.alias(n) for n, e in result.items()])


def computed_once(col: Column) -> Column:
    """A generated column: filters on it cannot be rewritten to evaluate its expression again."""
    return F.explode(F.array(col))


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name.

    Spark 4.1 treats a union of inputs that are partitioned alike as partitioned itself; when adaptive execution then
    reads one input by its map outputs, the partition counts differ and the query fails, so that is switched off.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
