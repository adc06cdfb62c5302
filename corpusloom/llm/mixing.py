"""Mixing sources to target weights by weighted sampling without replacement.

A source's target is met by complete epochs of all its documents first; the rest of the target is a sample by
Efraimidis and Spirakis: every document draws an exponential key whose rate is its quality weight, and the
smallest keys are taken until their sizes add up to the rest.  The draw is a hash of the document's id, so
reruns agree.

Texts are scanned once, into a narrow table of sizes and keys.  A source is never sorted whole: its keys are
dealt to slices in their order, the slices' sums are added up, and only the slice in which the rest of the target
ends is sorted.  All work is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import saved
from corpusloom.operators.scale import fits, join_lookup

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Documents of a slice of keys, on average.
SLICE_DOCS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def draw(doc_id: Column) -> Column:
    """A number in (0, 1) from 52 bits of the md5 of an id as text; a null id draws as the empty text."""
    text = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampling_key(u: Column, quality: Column) -> Column:
    """Exponential key: the smaller, the sooner taken.  A null weight is 1; without a positive one a row comes last."""
    w = F.coalesce(quality.cast("double"), F.lit(1.0))
    return F.when((w > 0) & ~F.isnan(w), -F.log(u) / w).otherwise(F.lit(float("inf")))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to targets: ``share`` of all sizes, dealt by repeating ``weights`` over the sources in
    code point order, null last.

    A target stops at ``most`` times its source's size; the excess is dealt again by weight among the others until no
    target is above.  Each round is one aggregation over the sources; the driver sees three numbers.
    Sources are numbered by a range partitioning, so that no task sorts all of them.
    """
    ordered = saved(sources.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source"))
    mark = ordered.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    parts = mark.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = saved(mark.join(F.broadcast(parts), "__part").select("source", "source_size", of.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    goal = share * (total or 0)
    rate, full = (goal / weight if weight else 0.0), -1
    while True:
        over = F.col("cap") <= F.lit(rate) * F.col("weight")
        n, taken, left = ranked.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == full or not left:
            break
        full, rate = n, (goal - taken) / left
    return ranked.select("source", "source_size", F.least("cap", F.lit(rate) * F.col("weight")).alias("target"))


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST_EPOCHS,
    slice_docs: int = SLICE_DOCS,
) -> DataFrame:
    """How many words of each document (``doc_id``, ``text``, ``source``) a mix of the sources takes.

    Returns (doc_id, source, size, source_size, target, epochs, taken), one row per document: ``size`` counts the
    words of the text, ``target`` is the source's (see ``source_targets``), ``epochs`` the complete passes over the source,
    and ``taken`` words of the document in all.  A source's ``taken`` add up to its target rounded to whole words: the last
    document of the sample gives the words that are left, so no document exceeds ``most`` epochs rounded up.

    ``quality(doc_id, weight)`` gives the rates of the sampling keys, the largest of several for an id (none or null: 1;
    zero, negative or NaN: after all others); it meets the narrow table, never the texts.  Null or empty texts have size 0 and take 0; a null source is a source of its own, last in order.  Equal keys go by doc_id, nulls first, then by
    size; rows that agree in all of these are interchangeable.  An empty table gives no rows; other columns are ignored.

    A hot source is aggregated map-side, its lookup is broadcast or salted, and only one slice of about
    ``slice_docs`` documents of it is sorted.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    if quality is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(quality.groupBy("doc_id").agg(F.max("weight").alias("weight")), "doc_id", "left")
    key = sampling_key(draw(F.col("doc_id")), F.col("weight"))
    rows = saved(rows.select("doc_id", "source", "size", key.alias("key")))
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("key") < float("inf"), F.col("key"))).alias("mean")
    )
    sources = saved(sources)
    targets = source_targets(sources.select("source", "source_size"), weights, share, most)
    budget = F.least(F.round("target").cast("long"), F.floor(F.lit(float(most)) * F.col("source_size")).cast("long"))
    plan = targets.withColumn("budget", budget).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    stats = sources.select(F.col("source").alias("s"), "n", "mean")
    plan = plan.join(stats, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # slices keep the order of keys: the share of an exponential with the source's mean key that lies below
    plan = saved(_named(plan.withColumn("slices", F.ceil(F.col("n") / F.lit(float(slice_docs))).cast("long"))))
    small = fits(plan)
    rows = join_lookup(_named(rows).drop("source"), plan, ["__s"], ["doc_id"], small)
    below = F.when(F.col("key") < float("inf"), F.lit(1.0) - F.exp(-F.col("key") / F.col("mean"))).otherwise(F.lit(1.0))
    rows = rows.withColumn("slice", F.coalesce(F.least(F.floor(below * F.col("slices")), F.col("slices") - 1), F.lit(0)))
    sums = rows.groupBy("__s", "slice").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("__s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    sums = sums.join(F.broadcast(plan.select("__s", "rest")) if small else plan.select("__s", "rest"), "__s")
    # the one slice of a source in which the rest ends
    last = sums.where("before < rest and before + words >= rest").select("__s", F.col("slice").alias("last"), "before")
    last = saved(last)
    rows = join_lookup(rows, last, ["__s"], ["doc_id"], small, "left")
    whole = F.when(F.col("slice") < F.col("last"), F.col("size")).otherwise(F.lit(0))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    split = F.col("slice") == F.col("last")
    others = rows.where(F.coalesce(~split, F.lit(True))).select(*out, (F.col("epochs") * F.col("size") + whole).alias("taken"))
    alike = ["source", "size", "source_size", "target", "epochs", "rest", "before", "key", "doc_id"]
    ending = rows.where(split).groupBy("__s", *alike).agg(F.count(F.lit(1)).alias("copies"))
    upto = Window.partitionBy("__s").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ending = ending.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(upto), F.lit(0)))
    ending = ending.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    left = F.col("rest") - F.col("start") - (F.col("copy") - 1) * F.col("size")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", left))
    return others.union(ending.select(*out, (F.col("epochs") * F.col("size") + part).alias("taken")))


def _named(df: DataFrame) -> DataFrame:
    """Adds ``__s``, the source without nulls, for joins."""
    return df.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
