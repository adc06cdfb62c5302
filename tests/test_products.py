"""Searches by tiled products against the search that makes a row per matching pair."""

import numpy as np
import pytest

from corpusloom.operators import lexical as L
from corpusloom.operators import products as P

SCHEMA = "chunk_key {}, title string, text string"


def rows(df):
    return sorted((tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tiles_equal_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(80)]
    p = 1 / np.arange(1, 81)
    text = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    key = int if kind == "long" else str
    docs = [(key(i), text(2), text(int(rng.integers(0, 40)))) for i in range(300)]
    docs += [(key(1000 + i), "word3 word70", "word1 word2 word3 word70") for i in range(40)] + [(key(2000), None, None), (key(2001), None, "word4"), (key(2002), "word5", None)]
    asked = [(i, text(int(rng.integers(1, 12)))) for i in range(60)] + [(100, "word70"), (101, "word3 word3"), (102, ""), (103, None), (104, "nothing")]
    chunks = spark.createDataFrame(docs, SCHEMA.format(kind)).repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, query string")
    both = lambda: [rows(L.bm25_topk(chunks, queries, 7)), rows(L.coverage_topk(chunks, queries, 7)), rows(L.coverage_topk(chunks, queries, 30, 0.0))]
    monkeypatch.setattr(L, "plain_keys", lambda c: False)
    pairs = both()
    monkeypatch.setattr(L, "plain_keys", P.plain_keys)
    monkeypatch.setattr(P, "BLOCK_TERMS", 90)  # several blocks of questions
    assert all(pairs) and both() == pairs


def test_no_row_per_matching_pair(spark, monkeypatch):
    monkeypatch.setattr(L, "bm25_scores", lambda *a: pytest.fail("scores of all pairs"))
    chunks = spark.createDataFrame([(i, "the title", "the same words") for i in range(50)], SCHEMA.format("long"))
    queries = spark.createDataFrame([(i, "the same") for i in range(50)], "query_id long, query string")
    assert L.bm25_topk(chunks, queries, 3).count() == 150


def test_negative_weights_and_repeated_keys(spark, monkeypatch):
    """A term in every chunk of a small corpus weighs less than nothing; a key on two rows is one chunk."""
    one = spark.createDataFrame([(1, "t", "a b")], SCHEMA.format("long"))
    twice = spark.createDataFrame([(1, "t", "a b"), (1, "t", "a c"), (2, "t", "b")], SCHEMA.format("long"))
    queries = spark.createDataFrame([(1, "a"), (2, "b c"), (3, "z")], "query_id long, query string")
    got = [rows(L.bm25_topk(c, queries, 3)) for c in (one, twice)]
    monkeypatch.setattr(L, "plain_keys", lambda c: False)
    assert got == [rows(L.bm25_topk(c, queries, 3)) for c in (one, twice)] and all(got)
