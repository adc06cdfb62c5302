"""Registered queries against their SQL on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "bm25_topk", "coverage_topk", "vector_topk", "hybrid_merge", "information_score", "neighbor_expand", "enrich_query", "extract_references", "assign_sections",
    "number_chunks", "update_plan", "reference_group", "rule_catalog", "resolve_followups", "claim_grounding", "latency_profile", "overlap_estimate", "session_activity",
    "scan_csv_as_text", "scan_json_as_text", "scan_xml_as_text", "loader_dispatch", "stream_ingest", "bm25_topk_padded", "label_overview", "label_fact", "label_compare", "relation_facts", "section_outline",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(SQL[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
