"""Words counted inside tasks are those of the column expressions, whatever the text holds."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import lexical as L
from corpusloom.operators import words as W

ODD = [
    "", " ", "Plain words, twice words", "ÉCOLE naïve œuvre ß ẞ Straße İstanbul ıI K ﬁn ½ x¼y ™ № ǆ Ǆ", "áb c​d e f g", "ＦＵＬＬ ｗｉｄｔｈ ２３ x²y…z",
    "studies studied tied dies classes boxes used the and making sing houses as", "日本語 текст Ωmega ΣΑΣ", "a\x00b\tc\nd_e-f", "😀ok x😀y " * 3,
]


def test_words_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "i int, t string")
    for r in df.select("i", "t", T.tokenize("t").alias("w"), T.meaningful_tokens("t").alias("m")).collect():
        if r.t is None:
            assert W.meaningful(None) == {}
            continue
        assert [w.decode() for w in W.tokenize(r.t)] == r.w, r.t
        assert [w.decode() for w in W.meaningful(r.t)] == r.m, r.t


def test_counts_of_chunks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "chunk_key int, text string")
    got = {r.chunk_key: (r.dl, r.counts) for r in L.term_counts(df).collect()}
    rows = df.where("text is not null").select("chunk_key", F.explode_outer(T.tokenize("text")).alias("w")).groupBy("chunk_key", "w").count().collect()
    want = {}
    for r in rows:
        n, counts = want.get(r.chunk_key, (0, {}))
        want[r.chunk_key] = (n + r["count"], counts | {r.w: r["count"]}) if r.w is not None else (0, {})
    assert got == want
    assert "MapInArrow" in L.term_counts(df)._jdf.queryExecution().toString()
