"""Documents to packed training sequences, stage by stage.

Every stage works on all rows that its predecessor kept and calls one operator of ``corpusloom.llm``.
``ORACLE_SQL`` is None: a network, an approximate-free similarity grouping and a tokenizer have no SQL; the
stages are tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from corpusloom.llm.queries import fold_of, table, tokenizer_path
from corpusloom.llm.tables import saved

TOXIC_FROM = 0.3
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below the threshold; every fourth labelled row is left out of its training."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=fold_of("doc_id", 4) != 2)
    return toxicity.keep_civil(docs, net, TOXIC_FROM)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go except for one occurrence each; a document that loses all its lines goes."""
    free = next(n for i in range(len(docs.columns) + 1) if (n := f"line_dedup_{i}") not in docs.columns)
    left = line_dedup.line_spread_dedup(docs, counts=free)
    left = left.where(f"{free}.n_left is null or {free}.n_left > 0")
    return _sized(docs, left)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out."""
    return _sized(docs, decontaminate.remove_benchmark(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


def _sized(docs: DataFrame, left: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``n_chars`` of the new text."""
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return left.select(*docs.columns)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is computed once into the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
