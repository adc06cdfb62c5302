"""Registered queries on the smallest tables against their SQL, and the pipeline stage by stage."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm import decontaminate, near_dedup, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)


def test_toxicity_query(spark):
    got = queries.op10(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_pipeline(spark, tmp_path):
    first = docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark, seen = spark.read.parquet(f"{SF}/benchmark.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == first.columns
        out.write.parquet(f"{tmp_path}/{i}")
        seen[name] = (docs, out := spark.read.parquet(f"{tmp_path}/{i}"))
        docs = out
    for name, (before, after) in seen.items():
        if name != "best_fit_packing":
            assert 0.6 * before.count() < after.count() <= before.count()
            assert after.join(before, "doc_id", "left_anti").count() == 0
            assert after.where("n_chars != length(text)").count() == 0
    deduped = seen["minhash_near_dedup"][1]
    assert near_dedup.near_groups(deduped).where("not leader").count() == 0
    assert decontaminate.find_benchmark(seen["benchmark_decontamination"][1], benchmark).where("n_hit > 0").count() == 0
    assert docs.select("doc_id").distinct().count() == seen["best_fit_packing"][0].count()
