"""Two-level scans against plain windows, with blocks small enough to matter."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators.scale import block_row_number, block_scan, salted_join


def _rows(spark):
    d = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), (F.col("id") * 7).alias("pos"),
        F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"))
    return d


def test_row_number_and_total(spark):
    d = _rows(spark)
    w = Window.partitionBy("k").orderBy("pos")
    want = {(r.k, r.pos): (r.rn, r.n) for r in d.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k"))).collect()}
    got = {(r.k, r.pos): (r.rn, r.n) for r in block_row_number(d, ["k"], "pos", "rn", width=50, total="n").collect()}
    assert got == want


def test_block_scan_matches_windows(spark):
    d = _rows(spark)
    w = Window.partitionBy("k").orderBy("pos")
    upto, below = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = d.select(
        "k", "pos", F.last("v", True).over(upto).alias("f"), F.last("v", True).over(below).alias("b"), F.sum(F.lit(2)).over(upto).alias("t"),
        F.lag("v").over(w).alias("lg"), F.lead("pos").over(w).alias("ld"))
    got = block_scan(d, ["k"], "pos", fill={"f": F.col("v")}, fill_before={"b": F.col("v")}, total={"t": F.lit(2)}, lag={"lg": F.col("v")}, lead={"ld": F.col("pos")}, width=50)
    cols = ["k", "pos", "f", "b", "t", "lg", "ld"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


def test_salted_join_is_exact(spark):
    d = _rows(spark)
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3)], "k string, x int")
    a = sorted(map(tuple, salted_join(d, lookup, ["k"], ["pos"]).select("k", "pos", "x").collect()))
    b = sorted(map(tuple, d.join(lookup, "k").select("k", "pos", "x").collect()))
    assert a == b


def test_windows_are_cut_in_bounded_batches(spark):
    from corpusloom.operators import scale, structure

    conf = spark.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.createDataFrame([(i, "One two. Three four.") for i in range(10)], "doc_id long, text string")
    assert structure.window_chunks(df).count() == 10
    assert int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == scale.BATCH_ROWS
    assert int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == scale.BATCH_BYTES


def test_content_lines_are_made_once(spark, monkeypatch):
    from corpusloom.operators import structure

    kept, plain = [], structure.materialized
    monkeypatch.setattr(structure, "materialized", lambda df: kept.append(1) or plain(df))
    lines = spark.createDataFrame([("d", 1, "Rule 1.1", 1, 15.0, 17.0, 100.0, 14.0, False), ("d", 2, "some text of it", 1, 50.0, 52.0, 100.0, 10.0, False)],
                                  "doc_key string, line_no long, text string, page long, y0 double, y1 double, page_height double, font double, bold boolean")
    got = structure.sections(lines).collect()
    assert [(r.section_type, r.rule_id, r.text) for r in got] == [("rule", "1.1", "Rule 1.1\nsome text of it")]
    assert kept == [1]
