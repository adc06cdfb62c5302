"""Derived inputs: whole tables of the given data, reshaped for the operators.

Every builder has a Spark form and a SQL twin with the same columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.scale import block_row_number, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- chunks: every document is a chunk, every source a file --------------------------------------


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table without positions: ``chunk_key, file_key, lang, text``; chunk_key is the corpus order."""
    return spread(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("chunk_key"), F.col("source").alias("file_key"), "lang", "text"
    )


CORPUS_SQL = "SELECT doc_id AS chunk_key, source AS file_key, lang, text FROM documents"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk table with 0-based ``chunk_id`` and ``total_chunks`` per file."""
    c = block_row_number(corpus(spark, sf), ["file_key"], "chunk_key", "rn", total="total_chunks")
    return c.withColumn("chunk_id", F.col("rn") - 1).drop("rn")


CHUNKS_SQL = """SELECT doc_id AS chunk_key, source AS file_key, lang, text,
 count(*) OVER (PARTITION BY source) AS total_chunks,
 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_id FROM documents"""


# ---- queries and relevance truth ---------------------------------------------------------------------


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


QUERIES_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"

# ---- questions: user turns put into question forms ---------------------------------------------------

QUESTION_FORMS = [
    "Who is {}?",
    "What can you tell me about {}?",
    "Explain {} and how does rule 8.4 relate?",
    "Sino si {}?",
    "Which HR dept can approve {} VL && SL?",
    "I am not sure whether {} or the other option applies here. Please check the policy.",
    "Compare {} with Section 4.2 of the manual.",
    "List the rules 8.7, 10.1 and 14.3 for {}",
    "Was {} signed before Article IV?",
    "Kailan itinatag ang {} at bakit mahalaga ito?",
    "Who is eligible for {}?",
    "What are the steps to configure {}?",
    "Is {} allowed in switch statements per Directive 4.1?",
    "{}",
    "Did {} create the treaty?",
    "Which came first: {} or the war?",
    "How many days of {} leave per yr?",
    "Who are the ladies with relationship with {}?",
    "use general knowledge about {}",
    "Who is the current president of {}?",
    "MISRA Rule abc.1x for {}",
    "{} eligibility",
    "What organization did {} found; please list its purpose",
    "Give me the latest MISRA rule release for {}",
]


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """``question_id, conv_id, turn, question``: one per user turn, in varied question forms."""
    t = spread(table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn")
    topic = T.squash(F.regexp_replace("text", "[.?!;:,]", " "))
    form = F.element_at(
        F.array(*[F.lit(f) for f in QUESTION_FORMS]),
        (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(QUESTION_FORMS))) + 1).cast("int"),
    )
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"),
        "conv_id",
        "turn",
        F.replace(form, F.lit("{}"), topic).alias("question"),
    )


def _sql_list(items: list[str]) -> str:
    return "[" + ",".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


QUESTIONS_SQL = f"""SELECT concat_ws('-', conv_id, turn) AS question_id, conv_id, turn,
 replace({_sql_list(QUESTION_FORMS)}[(conv_id + turn) % {len(QUESTION_FORMS)} + 1], '{{}}',
  trim(regexp_replace(regexp_replace(text, '[.?!;:,]', ' ', 'g'), '\\s+', ' ', 'g'))) AS question
 FROM conversations WHERE role = 'user'"""


def case_of(col: Column, values: list[str]) -> Column:
    """Pick one of the values by the sum of digits-like hash of an integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(col, F.lit(len(values))) + 1).cast("int"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
