"""Catalogue of runnable queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is the equivalent DuckDB query."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    from corpusloom.plans import (  # noqa: F401
        catalogue_queries,
        conversation_queries,
        evaluation_queries,
        fusion_queries,
        grounding_queries,
        index_queries,
        knowledge_queries,
        lexical_queries,
        question_queries,
        reference_queries,
        resolver_queries,
        source_queries,
        stream_queries,
        structure_queries,
        text_queries,
        vector_queries,
    )
