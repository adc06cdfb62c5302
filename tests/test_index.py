"""The persisted index: three changes against a rebuild, pruning without loss, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index as IX
from corpusloom.operators import lexical as L

SCHEMA = "chunk_key long, text string"


def rows(df, *cols):
    return sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    text = lambda: " ".join(rng.choice(words, int(rng.integers(1, 40)), p=p / p.sum()))
    return [(i, text()) for i in range(400)] + [(1000, ""), (1001, "w0 " * 500), (1002, None)]


def test_changes_equal_a_rebuild(spark, corpus, monkeypatch, tmp_path):
    monkeypatch.setattr(IX, "BLOCK", 8)
    frame = lambda x: spark.createDataFrame(x, SCHEMA)
    layers = [IX.write_layer(IX.first_layer(frame(corpus[:300])), f"{tmp_path}/0")]
    state = dict(corpus[:300])
    changes = [
        (corpus[250:], []),  # fifty texts again, the rest new
        ([(i, "w3 fresh words") for i in range(0, 100, 7)], [5, 6, 5, 99999]),
        ([(7, "w1 w1 w1")], [7, 8, 1001]),  # a key on both sides keeps the fresh text
    ]
    q = frame([]).sparkSession.createDataFrame([(1, "w0 w1 w1 w7"), (2, "fresh w59 w3"), (3, "nothing here"), (4, None), (5, "w0")], "query_id long, query string")
    for i, (fresh, gone) in enumerate(changes, 1):
        removed = spark.createDataFrame([(k,) for k in gone], "chunk_key long")
        layers.append(IX.write_layer(IX.next_layer(layers, frame(fresh), removed), f"{tmp_path}/{i}"))
        for k in gone:
            state.pop(k, None)
        state.update(fresh)
        now = frame(list(state.items()))
        assert rows(IX.vocabulary(layers).where("term <> ''"), "term", "df") == rows(L.vocabulary(now).where("term <> ''"), "term", "df")
        assert rows(IX.vocabulary(layers).where("term = ''"), "df", "n_tokens") == rows(L.vocabulary(now).where("term = ''"), "df", "n_tokens")
        cols = ("query_id", "chunk_key", "score", "rank")
        assert rows(IX.index_topk(layers, q, 5), *cols) == rows(L.bm25_topk(now, q, 5), *cols)
    one = [IX.compacted(layers)]
    assert rows(IX.index_topk(one, q, 5), *cols) == rows(L.bm25_topk(now, q, 5), *cols)
    assert one[0].forward.count() == sum(t is not None for t in state.values())


def test_blocks_are_bounded_and_pruned(spark, corpus, monkeypatch):
    monkeypatch.setattr(IX, "BLOCK", 8)
    layer = IX.first_layer(spark.createDataFrame(corpus, SCHEMA))
    for r in layer.postings.collect():
        assert len(r["keys"]) <= 8 and r.max_tf == max(r.tfs) and r.min_dl == min(r.dls)
    scored = []
    plain = IX.materialized

    def spy(df):
        out = plain(df)
        if out.columns == ["query_id", "chunk_key", "score"]:
            scored.append(out.count())
        return out

    monkeypatch.setattr(IX, "materialized", spy)
    q = spark.createDataFrame([(1, "w0")], "query_id long, query string")
    IX.index_topk([layer], q, 3).collect()
    assert sum(scored) < 0.5 * sum(1 for _, t in corpus if t and "w0" in t.split())


def test_empty_index_and_queries(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert IX.index_topk([IX.first_layer(none)], q).collect() == []
    one = IX.first_layer(spark.createDataFrame([(1, "a b")], SCHEMA))
    assert IX.index_topk([one], q.limit(0)).collect() == []
    emptied = [one, IX.next_layer([one], none, spark.createDataFrame([(1,)], "chunk_key long"))]
    assert IX.index_topk(emptied, q).collect() == [] and IX.live_forward(emptied).count() == 0


def test_many_postings_are_multiplied_with_the_same_result(spark, corpus, monkeypatch):
    layer = IX.first_layer(spark.createDataFrame(corpus, SCHEMA))
    changed = [layer, IX.next_layer([layer], spark.createDataFrame([(3, "w0 w5 fresh")], SCHEMA), spark.createDataFrame([(4,)], "chunk_key long"))]
    q = spark.createDataFrame([(1, "w0 w1 w1 w7"), (2, "w59 fresh"), (3, "nothing"), (4, None)], "query_id long, query string")
    cols = ("query_id", "chunk_key", "score", "rank")
    few = rows(IX.index_topk(changed, q, 5), *cols)
    monkeypatch.setattr(IX, "FEW_POSTINGS", 0)
    monkeypatch.setattr(IX, "top_k_per", lambda *a: pytest.fail("blocks were compared"))
    assert rows(IX.index_topk(changed, q, 5), *cols) == few and few
