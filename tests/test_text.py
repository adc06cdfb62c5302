"""Golden values for text functions and question rules."""

import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import intents as I
from corpusloom.functions import references as R
from corpusloom.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "value,want",
    [("Groß Café", ["gro", "cafe"]), ("ﬁle № 5", ["file", "no", "5"]), ("wait…what", ["wait", "what"]), ("", [])],
)
def test_tokenize(spark, value, want):
    assert one(spark, value, T.tokenize) == want


def test_normalize_splits_where_index_joins(spark):
    assert one(spark, "Groß-Café!", T.normalize_text) == "gro cafe"


@pytest.mark.parametrize(
    "value,want",
    [("policies", "policy"), ("patching", "patch"), ("changed", "chang"), ("change", "chang"), ("applied", "apply"), ("boxes", "boxe"), ("classes", "class"), ("ties", "ties"), ("the", "the")],
)
def test_light_stem(spark, value, want):
    assert one(spark, value, T.light_stem) == want


def test_clean_text(spark):
    raw = "Title\r\nPage 3 of 9\n“Quoted” – text  here\n-----\n\n\n\nEnd "
    assert one(spark, raw, T.clean_text) == 'Title\n"Quoted" - text here\nEnd'


def test_record_id_is_uuid5(spark):
    got = spark.range(1).select(T.record_id(F.lit("docs/a.txt"), F.lit(7))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "docs/a.txt|7"))


def test_decode_markers(spark):
    assert one(spark, "Jos#U00e9 Rizal #U1F600 x#U", T.decode_unicode_markers) == "José Rizal 😀 x#U"


def test_script_families(spark):
    assert one(spark, "plain текст 漢字", T.script_families) == ["CJK", "CYRILLIC"]


@pytest.mark.parametrize(
    "question,want",
    [("Who is José Rizal?", "jose rizal"), ("who can approve VL?", "vacation leave approval"), ("What is rule 8.7 && 9?", "rule 8.7 logical and operator 9"),
     ("Who is eligible for SL and what are the steps?", "eligible for sick leave and what are the steps")],
)
def test_normalize_query(spark, question, want):
    assert one(spark, question, I.normalize_query) == want


def test_facets(spark):
    assert one(spark, "Who founded it and when was it signed?", I.split_facets) == ["Who founded it", "when was it signed"]
    assert one(spark, "compare alpha with beta.", I.split_facets) == ["alpha", "beta"]
    assert one(spark, "who founded it", I.split_facets) == []


def test_relation_kind(spark):
    assert one(spark, "How many days of leave?", I.direct_relation_kind) == "quantity"
    assert one(spark, "What organization did he found?", I.direct_relation_kind) == "organization"


def test_is_english(spark):
    assert one(spark, "kailan itinatag ang samahan", I.is_english) is False
    assert one(spark, "list of the rules", I.is_english) is True
    assert one(spark, "правило", I.is_english) is False


def test_references_in_order(spark):
    d = spark.createDataFrame([(1, "Rule 8.7, Dir 4.1 and rules 10.1, 14.3 and 8.7; Section IV, part of")], "id int, t string")
    got = [(r.kind, r.identifier) for r in R.explode_references(d, "id", "t").orderBy("ref_no").collect()]
    assert got == [("rule", "8.7"), ("directive", "4.1"), ("rule", "10.1"), ("rule", "14.3"), ("section", "iv")]


def test_labeled_block(spark):
    text = "Rule 1.1\nDo it.\nCategory\nRequired\nRationale\nBecause\nof this.\nExample\nx = 1"
    assert one(spark, text, lambda c: R.labeled_block(c, "rationale")) == "Because of this."
    assert one(spark, text, R.requirement_statement) == "Do it."
