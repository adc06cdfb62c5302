"""Pools carry evidence, not texts: it is made where the texts are and equals the column expressions."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators import fusion as G
from corpusloom.operators import lexical as L
from corpusloom.operators import words as W

TEXTS = [
    "", " \n ", "Plain words. Twice!\n- one\n* two\n3) three, four, five", "References\n[1] see www.x.org http://y [2]", "  [12] É naïve ß Straße İstanbul K ﬁn ½ ™ áb é f g",
    "Ada was a writer and known for the policy. " * 40, "the relationship and wife of the common law partner; daughter; family", "日本語 текст Ωmega ΣΑΣ 😀ok", "External Links\nsources", "a\tb\x0bc\n\n\nd",
]
COLS = "chunk_key long, text string, file_key string, file_name string, title string"


@pytest.fixture(scope="module")
def pool_inputs(spark):
    rows = [(i, f"Storage of bolts {i}. The bolts are stored in dry boxes and counted by the store keeper every year.", f"f{i % 3}", f"Bolts {i}.pdf", f"Bolts {i}") for i in range(30)]
    q = spark.createDataFrame([(i, f"where are the bolts {i} stored and counted") for i in range(12)] + [(99, "who is the store keeper of the bolts")], "query_id long, query string")
    return spark.createDataFrame(rows, COLS), q


def test_marks_are_those_of_the_columns(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").withColumn("nt", T.normalize_text("text"))
    pad, first = T.padded(F.col("nt")), lambda n: T.padded(F.substring("nt", 1, n))
    want = {
        "nt": F.col("nt"), "id_noise": T.identity_noise(pad), "has_def": T.has_definition(pad), "is_ref": T.is_reference_section("text"), "intro_cue": T.any_phrase(first(1000), V.INTRO_SIGNALS),
        "strong_cue": T.any_phrase(first(700), V.STRONG_INTRO_SIGNALS), "bio": T.any_phrase(first(900), V.BIOGRAPHY_SIGNALS), "list_cue": F.col("nt").rlike(rf"\b({V.LIST_CUE_PATTERN})\b"),
        "relation_words": T.any_phrase(pad, list(V.RELATIONSHIP_WEIGHTS)), "relation_section": T.any_phrase(pad, V.RELATIONSHIP_SECTION_SIGNALS), "relation_weight": T.phrase_weight(pad, V.RELATIONSHIP_WEIGHTS),
        "relation_negative": T.phrase_hits(pad, V.RELATIONSHIP_NEGATIVE_TERMS), "n_words": T.word_count("text"), "n_sentences": T.sentence_count("text"), "noise": T.reference_noise("text", pad),
        "citation": T.citation_score("text"), "cites_first": F.trim("text").rlike(r"^\[[0-9]+\]"), "many_lines": T.line_count("text") >= 3, "has_bullet": T.bullet_count("text") > 0,
        "enumerates": (F.regexp_count("text", F.lit(",")) >= 2) | (F.regexp_count("text", F.lit(";")) >= 2),
    }
    both = d.withColumn("m", W.text_marks(F.col("text"))).select("text", "m", F.struct(*[c.alias(n) for n, c in want.items()]).alias("w"), W.meaningful_words(F.col("text")).alias("got"), T.meaningful_tokens("text").alias("tokens"))
    for r in both.collect():
        assert {n: (r.m[n], r.w[n]) for n in want if r.m[n] != r.w[n]} == {} and r.got == r.tokens, r.text


def test_a_file_name_without_topic_words_is_no_error(spark):
    c = spark.createDataFrame([(1, "Jose Rizal was a writer born in Calamba. " * 9, "f", "--- (1).pdf", "Jose Rizal"), (2, "Jose Rizal\nJose Rizal was a writer. " + "He wrote two novels. " * 9, "g", "Jose Rizal.pdf", "Jose Rizal")], COLS)
    q = spark.createDataFrame([("q", "Who is Jose Rizal?")], "query_id string, query string")
    p = G.with_features(G.hybrid_merge(L.coverage_topk(c, q, 10), L.bm25_topk(c, q)), c, q)
    assert [r.chunk_key for r in G.identity_fast_path(p).collect()] == [2]


def test_no_text_leaves_its_chunk(spark, pool_inputs, monkeypatch):
    c, q = pool_inputs
    h = G.materialized(G.hybrid_merge(L.coverage_topk(c, q, 10), L.bm25_topk(c, q)))
    rows = lambda p: sorted(tuple(r) for r in p.select("query_id", "chunk_key", F.round("info_score", 6), F.round("share", 6), "literal", "low_value").collect())
    small = rows(G.with_features(h, c, q))
    monkeypatch.setattr(G, "fits", lambda *a, **k: False)
    p = G.with_features(h, c, q)
    assert rows(p) == small and len(small) == h.count()
    for d in (G.informative_order(p).select("query_id", "rank"), G.rescore_pairs(p).select("query_id", "rank")):
        moved = _window_inputs(d._jdf.queryExecution().optimizedPlan())
        assert "query_id" in moved and not moved & set(G.LONG)


def _window_inputs(node):
    """The columns that reach the windows by question."""
    kids = [node.children().apply(i) for i in range(node.children().size())]
    own = [k.output() for k in kids] if node.nodeName() == "Window" else []
    return {o.apply(i).name() for o in own for i in range(o.size())}.union(*map(_window_inputs, kids))


def test_pair_marks(spark):
    nt = "alpha beta " + "x " * 500 + "gamma delta"
    d = spark.createDataFrame([("alpha gamma zeta al of", "gamma zeta", nt), ("", "", ""), ("alpha beta x", "alpha", nt)], "q string, w string, t string")
    assert [tuple(r[0]) for r in d.select(W.pair_marks(F.col("q"), F.col("w"), F.col("t"))).collect()] == [(0.33, 1, 1, False), (0.0, 0, 0, False), (0.5, 1, 2, True)]


def test_a_question_is_normalised_once(spark):
    q = spark.createDataFrame([(1, "Who approves the leave of staff?"), (2, "who is Ada Byron"), (3, None)], "query_id long, query string")
    d = G.with_target(q)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("lower(query#") <= 3
    assert {r.query_id: (r.kind, r.is_identity, r.target) for r in d.collect()} == {1: ("approver", False, ["leave", "staff"]), 2: ("", True, ["ada", "byron"]), 3: ("", False, [])}
