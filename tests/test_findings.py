"""Cases in which registered queries once differed from their SQL or repeated work."""

from pyspark.sql import functions as F

from corpusloom.functions import intents as I
from corpusloom.functions import text as T
from corpusloom.operators import conversation as C
from corpusloom.operators import grounding as GR
from corpusloom.operators.scale import spread
from corpusloom.plans import registry

registry.load_all()


def test_a_number_inside_a_longer_one_is_no_support(spark):
    texts = ["see 199.7", "see 99.71", "see 3.99.7", "see 99.7.1", "see 99.7.", "rule 99.7 holds", "none"]
    a = spark.createDataFrame([(i, "what", t, "Under Rule 99.7 it is.") for i, t in enumerate(texts)], "answer_id int, question string, context string, answer string")
    bad = {r.answer_id: len(r.bad_refs) for r in GR.claim_grounding(a).collect()}
    assert bad == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 1}


def test_case_changes_keep_letters_and_repeats_are_found(spark):
    q = "welche straße"
    d = spark.range(1).select(I.validate_variants(F.lit(q), F.array(F.lit("große straße"), T.upper(F.lit("große straße")), F.lit("dritte"))).alias("v"), T.upper(F.lit("aß")).alias("u"))
    assert d.first() == (["große straße", "dritte"], "Aẞ")


def test_words_end_where_ascii_ends(spark):
    d = spark.createDataFrame([("Doíque ciónezco",), ("Dorado",), ("Do it",)], "q string")
    assert [r[0] for r in d.select(C.answer_focus(F.col("q"))).collect()] == ["YES_NO", "GENERAL", "YES_NO"]


def test_phrases_compute_their_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        calls.add(1)
        return t

    d = spark.createDataFrame([(" a b c ",)], "t string")
    assert d.select(T.phrase_hits(seen("t"), ["a", "c", "x", "y"]), T.phrase_weight(F.col("t"), {"a": 1.0, "b": 2.5})).first() == (2, 3.5)
    pad = F.rpad("t", 9, " ")
    plan = d.select(T.phrase_hits(pad, ["a", "c"]).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rpad(") == 1 and "transform(array(rpad(" in plan


def test_rows_of_one_row_group_are_dealt_by_their_keys(spark, tmp_path):
    spark.range(20_000).selectExpr("id", "sha2(cast(id as string), 256) as t").coalesce(1).write.parquet(str(tmp_path / "one"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        scan = spark.read.parquet(str(tmp_path / "one"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(scan, "id")
        sizes = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 5_000
        assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(800, numPartitions=spark.sparkContext.defaultParallelism)
    assert spread(even, "id") is even


def test_texts_without_a_sentence_are_answers_too(spark, tmp_path):
    rows = [(1, "", "en"), (2, " \n\t ", "de"), (3, None, "en"), (4, None, "de"), (5, "One is here. Two.", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.answer_id: (r.ok, r.bad_refs, r.bad_numbers, r.bad_acronyms) for r in registry.QUERIES["claim_grounding"](spark, str(tmp_path)).collect()}
    flagged, fine = (False, "rule 99.7", "4711,99.7", "XQZK"), (True, "", "", "")
    assert got == {1: flagged, 2: fine, 3: flagged, 4: fine, 5: fine}
