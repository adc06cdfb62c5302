"""A persisted inverted index: block maxima for pruning, and statistics that add up under change.

An index is a list of layers.  A layer holds what one change brought: ``forward`` (terms and counts of its chunks),
``postings`` (blocks of a term's postings, best first, each with the largest count and the smallest length in it), a signed
``vocabulary`` and ``tombstones`` (keys whose rows in earlier layers are dead).  A change reads only its own chunks and the
forward rows of the keys it replaces; a query reads no text at all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V
from corpusloom.operators import lexical as L
from corpusloom.operators.products import plain_keys
from corpusloom.operators.scale import fits, materialized, top_k_per, union_rows

BLOCK = 128
#: Blocks per question whose chunks are scored first, to know what the k-th best is at least.
SEED_BLOCKS = 6
#: Sums of doubles in another order differ by less than this.
SLACK = 1e-9
#: Postings that all questions ask for together, up to which blocks are compared with bounds one by one.
FEW_POSTINGS = 2_000_000


class Layer(NamedTuple):
    forward: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    tombstones: DataFrame


def _signed(forward: DataFrame, sign: int) -> DataFrame:
    """Document and token counts that these rows add or take; the row with the empty term counts chunks and tokens."""
    terms = F.array_append(F.map_keys("counts"), F.lit(L._CORPUS))
    rows = forward.select("dl", F.explode(terms).alias("term"))
    own = F.when(F.col("term") == L._CORPUS, F.col("dl")).otherwise(0)
    return rows.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"), (F.sum(own) * sign).alias("n_tokens"))


def _packed(size: int):
    """Blocks of consecutive rows of one term, cut at ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            term = batch.column(0).dictionary_encode().indices.to_numpy()
            fresh = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            within = np.arange(n) - np.repeat(fresh, np.diff(np.r_[fresh, n]))
            at = np.flatnonzero(within % size == 0)
            ends = pa.array(np.r_[at, n].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, batch.column(i)) for i in (1, 2, 3)]
            tf, dl = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cols = [batch.column(0).take(pa.array(at)), pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(dl, at)), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=["term", "max_tf", "min_dl", "keys", "tfs", "dls"])

    return run


def posting_blocks(forward: DataFrame) -> DataFrame:
    """Postings in the order of falling count and rising length; a frequent term's blocks lie in many tasks."""
    kind = dict(forward.dtypes)["chunk_key"]
    rows = forward.select("chunk_key", "dl", F.explode("counts").alias("term", "tf")).select("term", "chunk_key", "tf", "dl")
    order = ["term", F.desc("tf"), "dl", "chunk_key"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(_packed(BLOCK), f"term string, max_tf int, min_dl long, keys array<{kind}>, tfs array<int>, dls array<long>")


def live_forward(layers: Sequence[Layer]) -> DataFrame:
    """Forward rows that no later layer replaced or removed; adds their ``layer``."""
    rows = union_rows([x.forward.withColumn("layer", F.lit(i)) for i, x in enumerate(layers)])
    if len(layers) == 1:
        return rows
    dead = union_rows([x.tombstones.withColumn("until", F.lit(i)) for i, x in enumerate(layers)]).groupBy("chunk_key").agg(F.max("until").alias("until"))
    dead = F.broadcast(dead) if fits(dead) else dead
    return rows.join(dead, "chunk_key", "left").where("until is null or until <= layer").drop("until")


def vocabulary(layers: Sequence[Layer]) -> DataFrame:
    """``term, df, n_tokens`` of the whole index: the layers' signed counts added up, as ``lexical.vocabulary`` gives them."""
    both = union_rows([x.vocabulary for x in layers]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("n_tokens"))
    return both.where((F.col("df") > 0) | (F.col("term") == L._CORPUS))


def first_layer(chunks: DataFrame, keep=materialized) -> Layer:
    """Indexes ``chunks(chunk_key, text)``; every text is read once.  ``keep(df)`` stores a table and reads it back."""
    forward = keep(L.term_counts(chunks))
    return Layer(forward, keep(posting_blocks(forward)), keep(_signed(forward, 1)), keep(forward.select("chunk_key").limit(0)))


def next_layer(layers: Sequence[Layer], fresh: DataFrame, removed: DataFrame | None = None, keep=materialized) -> Layer:
    """The layer of one change: ``fresh(chunk_key, text)`` are new or changed chunks, ``removed(chunk_key)`` deleted ones.

    Keys may come on several rows of ``removed``, and of keys on both sides the fresh text stays; fresh keys must be unique.
    What the old rows counted is taken off again from their forward rows, so no old text is needed.
    """
    forward = keep(L.term_counts(fresh))
    gone = fresh.select("chunk_key") if removed is None else union_rows([fresh.select("chunk_key"), removed.select("chunk_key")])
    gone = keep(gone.distinct())
    few = F.broadcast(gone) if fits(gone) else gone
    old = live_forward(layers).join(few, "chunk_key", "left_semi")
    signed = union_rows([_signed(forward, 1), _signed(old, -1)]).groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("n_tokens"))
    return Layer(forward, keep(posting_blocks(forward)), keep(signed), gone)


def compacted(layers: Sequence[Layer], keep=materialized) -> Layer:
    """All layers as one, from forward rows alone."""
    forward = keep(live_forward(layers).drop("layer"))
    return Layer(forward, keep(posting_blocks(forward)), keep(_signed(forward, 1)), keep(forward.select("chunk_key").limit(0)))


def write_layer(layer: Layer, path: str) -> Layer:
    """Stores a layer's tables under ``path`` and reads them back."""
    spark = layer.forward.sparkSession
    for name, df in layer._asdict().items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    return read_layer(spark, path)


def read_layer(spark: SparkSession, path: str) -> Layer:
    return Layer(*[spark.read.parquet(f"{path}/{name}") for name in Layer._fields])


def _part(tf: Column, dl: Column, mean: Column) -> Column:
    k1, b = V.BM25_K1, V.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))


def index_topk(layers: Sequence[Layer], queries: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """``query_id, chunk_key, score, rank``: what ``lexical.bm25_topk`` finds, from the index alone.

    A block's bound for a question is its best possible share plus the best shares of the question's other terms.  The chunks of
    a few best blocks are scored first; only blocks whose bound reaches the k-th of those scores can hold another result, and only
    their chunks are scored, from the forward rows.  Nothing is approximate.  Where the questions ask for more than ``FEW_POSTINGS``
    postings, bounds of many terms skip little: all forward rows are then multiplied with the questions, tile by tile.
    """
    vocab = materialized(vocabulary(layers))
    total = vocab.where(F.col("term") == L._CORPUS).first()
    if total is None or not total["n_tokens"]:
        return queries.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_key {dict(layers[0].forward.dtypes)['chunk_key']}, score double, rank int")
    mean = F.lit(total["n_tokens"] / total["df"])
    terms = L.query_terms(queries).join(L.term_stats(vocab), "term")
    terms = materialized(terms.select("query_id", "term", "df", (F.col("qf") * F.col("idf")).alias("w")))
    live = live_forward(layers).drop("layer")
    if (terms.agg(F.sum("df")).first()[0] or 0) > FEW_POSTINGS and plain_keys(live):
        return L.ranked_counts(live, queries, vocab, k)
    terms = terms.drop("df")
    small = fits(terms)
    near = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    heads = union_rows([x.postings for x in layers])
    best = F.greatest(F.col("w") * _part(F.col("max_tf"), F.col("min_dl"), mean), F.lit(0.0))
    # headers only: the lists of keys are not read here
    share = heads.select("term", "max_tf", "min_dl").distinct().join(near(terms), "term").select("query_id", "term", best.alias("b"))
    share = share.groupBy("query_id", "term").agg(F.max("b").alias("most"))
    sums = share.groupBy("query_id").agg(F.sum("most").alias("all"))
    terms = materialized(terms.join(share, ["query_id", "term"]).join(sums, "query_id").select("query_id", "term", "w", (F.col("all") - F.col("most")).alias("rest")))
    asked = heads.join(near(terms), "term").withColumn("bound", best + F.col("rest"))
    seeds = top_k_per(asked.select("query_id", "bound", "keys"), ["query_id"], [F.desc("bound")], SEED_BLOCKS, "r")
    forward = live
    words = terms.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("words"))
    words = materialized(words)

    def scored(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        rows = forward.join(F.broadcast(pairs) if fits(pairs) else pairs, "chunk_key").join(near(words), "query_id")
        score = F.aggregate(
            F.filter("words", lambda x: F.map_contains_key("counts", x["term"])), F.lit(0.0),
            lambda s, x: s + x["w"] * _part(F.element_at("counts", x["term"]), F.col("dl"), mean),
        )
        return materialized(rows.select("query_id", "chunk_key", score.alias("score")))

    first = scored(seeds.select("query_id", F.explode("keys").alias("chunk_key")))
    order = L.score_order("score", "chunk_key")
    kth = top_k_per(first, ["query_id"], order, k, "rank").where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    open_ = asked.join(near(kth), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    # of a surviving block only the rows that can still reach the least score by their own count and length
    rows = open_.select("query_id", "w", "rest", "least", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("e"))
    reach = F.greatest(F.col("w") * _part(F.col("e.tfs"), F.col("e.dls"), mean), F.lit(0.0)) + F.col("rest")
    rows = rows.where(F.col("least").isNull() | (reach >= F.col("least") - SLACK)).select("query_id", F.col("e.keys").alias("chunk_key"))
    more = rows.distinct().join(first, ["query_id", "chunk_key"], "left_anti")
    return top_k_per(union_rows([first, scored(more)]), ["query_id"], order, k, "rank")
