"""The rescue of unanswered questions from a search that was made already."""

import pytest

from corpusloom.operators import fusion as G
from corpusloom.operators import lexical as L
from corpusloom.plans import knowledge_queries as K


def test_rescue_takes_the_search_that_was_made(spark, monkeypatch):
    texts = ["blue bolts stored in dry boxes and counted by the store", "red gears greased monthly near the lathe", "bolts and gears of the blue store"] * 6
    chunks = spark.createDataFrame([(i, f"f{i % 4}", f"t{i}", f"t{i}.pdf", t) for i, t in enumerate(texts)], "chunk_key long, file_key string, title string, file_name string, text string")
    asked = spark.createDataFrame([(1, "where are blue bolts stored"), (2, "who greased the gears"), (3, "blue gears store"), (4, "nothing of it")], "query_id long, query string")
    answered = spark.createDataFrame([(3,)], "query_id long")
    rows = lambda d: sorted(tuple(r) for r in d.select("query_id", "chunk_key", "pos", "rescore").collect())
    plain = rows(G.empty_rescue(asked, answered, chunks))
    found = L.coverage_topk(chunks, asked, 15, 0.1)
    monkeypatch.setattr(L, "coverage_topk", lambda *a: pytest.fail("searched again"))
    assert rows(G.empty_rescue(asked, answered, chunks, found=found)) == plain and {r[0] for r in plain} == {1, 2}


def test_texts_of_the_rescue_are_not_numbered(spark):
    plan = K.kb_texts(spark, "/root/testdata/sf0.001").select("chunk_key", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join LeftOuter" not in plan
