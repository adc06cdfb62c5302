"""The routed cascade on a small knowledge base: every route, in the right order, with the right rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fusion as G
from corpusloom.operators import retrieval as RT

LONG = " The store keeps its stock in order and counts it twice a year, after which a written list is kept for every shelf of the store."


@pytest.fixture(scope="module")
def cascade(spark):
    texts = {
        "ada": "Ada Byron\nAda Byron is a mathematician of the first engines and the author of the notes on them." + LONG,
        "leave": "Leave policy\nLeave requests of night staff are approved by the duty manager before the first day of leave." + LONG,
        "bolt": "Bolts\nBolts of the blue series are stored in dry boxes, sorted by length, checked for rust and counted by the store." + LONG,
        "gear": "Gears\nGears of the red series are greased monthly and stored in sealed drawers near the lathe of the workshop." + LONG,
    }
    rows = [(i, k, t.split("\n")[0] + ".pdf", t.split("\n")[0], t, 0, 1) for i, (k, t) in enumerate(texts.items())]
    chunks = spark.createDataFrame(rows, "chunk_key long, file_key string, file_name string, title string, text string, chunk_id long, total_chunks long")
    std = []
    for major in (7, 8):
        for minor in (1, 2):
            rule = f"{major}.{minor}"
            std.append((major, minor, "rule", rule, "", "Mandatory" if minor == 1 else "Advisory", "requirement", f"Rule {rule}", f"Rule {rule}\nwidgets shall be painted\nCategory\nMandatory", f"std_{major}", minor * 2))
            std.append((major, minor, "rule", rule, "", "Advisory", "rationale", "Rationale", "Rationale\nbecause", f"std_{major}", minor * 2 + 1))
        std.append((major, 0, "section", "", str(major), None, "document_section", f"Painting guidelines of {'wood' if major == 7 else 'metal'}", f"Section {major}", f"std_{major}", 0))
    cols = "major long, minor long, section_type string, rule_id string, section_id string, category string, section_role string, section_title string, text string, file_key string, chunk_id long"
    std = spark.createDataFrame(std, cols).withColumn("chunk_key", F.concat_ws("::", "file_key", "chunk_id"))
    questions = {
        "exact": "Explain Rule 7.2 please", "comparison": "What is the difference between Rule 7.1 and Rule 8.2?", "family": "Explain Rule 8 of the manual", "unknown_reference": "What does Rule 7.99 say?",
        "section_title": "painting guidelines of metal", "catalog": "List all mandatory rules on widgets", "identity_fast": "Who is Ada Byron?", "relation_fast": "Who approves leave requests of night staff?",
        "out_of_corpus": "Who is Zqxwv Kjhgf?", "hybrid": "How are bolts of the blue series stored and checked for rust?", "unanswered": "qqq www zzz",
    }
    q = spark.createDataFrame([(k, v) for k, v in questions.items()], "query_id string, query string")
    v = spark.createDataFrame([("hybrid", 1, "blue series bolts stored in boxes"), ("hybrid", 2, "rust check of bolts")], "query_id string, variant_no int, variant string")
    routes, rows = RT.retrieve(q, chunks, std, v)
    return questions, {r.query_id: r.route for r in routes.collect()}, rows.collect()


def test_every_question_has_its_route(cascade):
    questions, routes, _ = cascade
    assert routes == {k: k for k in questions}


def test_rows_of_the_routes(cascade):
    _, routes, rows = cascade
    of = lambda q: [r.chunk_key for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.pos)]
    assert of("exact") == ["std_7::4", "std_7::5"] and of("family") == ["std_8::2", "std_8::4"]
    assert of("comparison") == ["std_7::2", "std_7::3", "std_8::4", "std_8::5"]
    assert of("section_title") == ["std_8::0"] and of("catalog") == ["std_7::2", "std_8::2"]
    assert of("identity_fast") == ["0"] and of("relation_fast") == ["1"] and of("hybrid")[0] == "2"
    assert not any(of(q) for q, r in routes.items() if r in RT.STOPS)


def test_free_slots_take_rule_bodies_near_the_floor(spark):
    cols = "query_id string, chunk_key string, pos int, score double"
    final = spark.createDataFrame([("a", "x", 1, 0.9), ("b", "x", 1, 0.9), ("b", "y", 2, 0.8), ("b", "z", 3, 0.7)], cols)
    ranked = spark.createDataFrame(
        [(q, k, i, "painted widgets", "Rule 1.1\npainted widgets only\nCategory\nx", role, s) for q in ("a", "b", "c") for i, (k, role, s) in enumerate([("n1", "requirement", 0.52), ("n2", "rationale", 0.52), ("n3", "requirement", 0.3)])],
        "query_id string, chunk_key string, rank int, query string, text string, section_role string, rescore double",
    )
    got = sorted((r.query_id, r.chunk_key, r.pos) for r in RT._near_threshold(final, ranked).collect())
    assert got == [("a", "n1", 2), ("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("b", "z", 3)]


def test_one_wording_passes_through(spark):
    d = spark.createDataFrame([("q", 0, 5, 2.0, 1), ("q", 0, 3, 1.0, 2)], "query_id string, variant int, chunk_key long, score double, rank int")
    assert [(r.chunk_key, r.score) for r in G.rrf_fuse(d).orderBy("rank").collect()] == [(5, 2.0), (3, 1.0)]
