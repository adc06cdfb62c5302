"""Cross-site boilerplate lines by distinct-site spread.

Every line hash keeps a HyperLogLog sketch of the sites that show it; sketches merge by aggregation, so a
line of any number of pages is one small row.  Lines whose estimate is near the threshold get an exact
distinct count.  A line on enough sites is boilerplate: its first occurrence (smallest row of the smallest
doc_id) stays, so that no text is lost from the corpus, and all others go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tables import ROW, boxed, keyed, need, saved, stable
from corpusloom.operators.scale import fits, join_lookup

MIN_SITES = 5
SKETCH_BITS = 12
#: Five standard errors of such a sketch, and one site for the smallest counts.
DOUBT = 5 * 1.04 / 2 ** (SKETCH_BITS / 2)


def _lines(rows: DataFrame) -> DataFrame:
    """__row, doc_id, site, pos, and the 128-bit key of each line that is not blank."""
    one = rows.select(ROW, "doc_id", "site", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    line = F.trim(F.translate("line", "\t\r\f\v", "    "))
    one = one.select(ROW, "doc_id", "site", "pos", line.alias("line")).where("line != ''")
    return one.select(ROW, "doc_id", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of lines on ``min_sites`` sites or more; a null site counts as one site."""
    at = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", ROW, "pos")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_BITS))).alias("sites"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first")
    )
    slack = F.lit(1 + DOUBT * min_sites)
    likely = saved(spread.where((F.col("n") >= min_sites) & (F.col("sites") >= min_sites - slack)))
    sure = likely.where(F.col("sites") > min_sites + slack).select("h1", "h2", "first")
    near = likely.where(F.col("sites") <= min_sites + slack).select("h1", "h2", "first")
    few = fits(near)
    pairs = join_lookup(lines.select("h1", "h2", "site", ROW), near, ["h1", "h2"], [ROW], few)
    exact = pairs.select("h1", "h2", "first", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first"))
    return sure.unionByName(exact.where(F.col("n") >= min_sites).select("h1", "h2", "first"))


_CUT = "text string, n_lines long, n_removed long, n_left long"


def _cut(text, gone):
    """The text without the lines at the given places, and line counts; nothing for untouched rows."""
    if text is None or gone is None:
        return None
    lines, gone = text.split("\n"), set(gone)
    kept = [x for i, x in enumerate(lines) if i not in gone]
    return "\n".join(kept), len(lines), len(gone), sum(1 for x in kept if x.strip())


def line_spread_dedup(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", counts: str = "line_dedup") -> DataFrame:
    """``docs`` with repeated boilerplate lines removed from ``text``; all rows and columns stay.

    A line is what stands between line feeds, compared without white space around it; blank lines are
    never removed.  Null texts stay null, empty ones empty; a null site is a site of its own; equal rows
    are separate occurrences; an empty table gives no rows.  Adds ``counts``, a struct (a column of that
    name is replaced): n_lines (lines of the input text, 0 for null), n_removed and n_left (lines with
    words left; null where nothing was removed).
    """
    docs = stable(docs)
    helper = need(docs, "doc_id", "text", site).withColumnRenamed(site, "site")
    rows = keyed(helper).withColumn("site", F.coalesce(F.col("site").cast("string"), F.lit("\x00none")))
    lines = _lines(rows)
    found = saved(boilerplate(lines, min_sites))
    few = fits(found)
    hit = join_lookup(lines.select(ROW, "pos", "h1", "h2"), found, ["h1", "h2"], [ROW, "pos"], few)
    gone = hit.where(~((F.col(ROW) == F.col(f"first.{ROW}")) & (F.col("pos") == F.col("first.pos"))))
    gone = gone.groupBy(ROW).agg(F.collect_list("pos").alias("__gone"))
    both = boxed(docs).join(gone, ROW, "left")
    cut = F.udf(_cut, _CUT)
    text = F.when(F.col("__gone").isNotNull(), F.col("__doc.text"))
    both = both.withColumn("__cut", cut(text, "__gone"))
    n_lines = F.when(F.col("__doc.text").isNull(), 0).otherwise(F.size(F.split("__doc.text", "\n", -1))).cast("long")
    numbers = F.struct(
        F.coalesce("__cut.n_lines", n_lines).alias("n_lines"), F.coalesce("__cut.n_removed", F.lit(0).cast("long")).alias("n_removed"), F.col("__cut.n_left").alias("n_left")
    )
    doc = F.col("__doc").withField("text", F.coalesce("__cut.text", "__doc.text")).withField(f"`{counts}`", numbers)
    return both.select(doc.alias("__doc")).select("__doc.*")
