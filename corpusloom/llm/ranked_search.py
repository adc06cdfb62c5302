"""Ranked lexical search by dense blocked matrix products.

Only terms that some item asks for are kept of a document.  One scan turns each text into the numbers and
counts of such terms; Spark aggregates the corpus counts from that narrow table.  A second pass multiplies
tiles: the weights of a few hundred items for the terms that a tile of documents holds, times the impacts of
those terms in the documents, in double precision.  Weights are cut so that no partial sum reaches 2**53, so
every product is exact; the sums are added as 64-bit integers.  Each task keeps the best rows of each item,
ties included until the order by document id settles them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import need, saved

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of item terms that are sent to every task at a time; more items are asked in further blocks.
BLOCK_BYTES = 8 << 20
ITEM_TILE, DOC_TILE, TERM_TILE = 256, 512, 2048
#: No impact reaches this, whatever a document's counts are.
IMPACT = 1_000_000
EXACT = 1 << 53


class Vocabulary:
    """Distinct terms of a block of items, found in folded text by hash and confirmed byte by byte."""

    def __init__(self, terms: list[str]):
        data, off = A.strings(terms)
        h = A.word_hash(data, off[:-1], off[1:])
        order = np.argsort(h, kind="stable")
        h = h[order]
        fresh = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
        within = np.arange(len(h)) - np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else fresh
        self.data, self.off, self.size = data, off, len(terms)
        #: terms of equal hashes lie in different layers
        self.layers = [(h[within == i], order[within == i]) for i in range(int(within.max()) + 1 if len(h) else 0)]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each span's term, or -1."""
        found = np.full(len(starts), -1, np.int64)
        h = A.word_hash(data, starts, ends)
        for hashes, number in self.layers:
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            maybe = np.flatnonzero(hashes[at] == h)
            no = number[at[maybe]]
            same = self.off[no + 1] - self.off[no] == ends[maybe] - starts[maybe]
            maybe, no = maybe[same], no[same]
            if not len(maybe):
                continue
            size = ends[maybe] - starts[maybe]
            equal = data[A.ranges(starts[maybe], size)] == self.data[A.ranges(self.off[no], size)]
            whole = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(size)[:-1]])
            found[maybe[whole]] = no[whole]
        return found


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """int32 values as one binary cell per pair of bounds."""
    off = (bounds * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values.astype(np.int32).tobytes())])


_HELD = "doc_id long, n long, terms binary, counts binary"


def _held(vocabulary: Vocabulary):
    """Each document with a term: its number of terms, and numbers and counts of those that items ask for."""
    member = A.byte_class("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.text_bytes(batch.column(1))
            for lo, hi, part, ends_at in A.pieces(data, off):
                text = A.fold(part)
                starts, ends, bounds = A.words(text, ends_at, member)
                number = vocabulary.find(text, starts, ends)
                asked = number >= 0
                key, tf = np.unique(A.row_of(bounds)[asked] * np.int64(max(1, vocabulary.size)) + number[asked], return_counts=True)
                doc, term = np.divmod(key, max(1, vocabulary.size))
                at = np.searchsorted(doc, np.arange(hi - lo + 1))
                n = np.diff(bounds)
                rows = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), _packed(term, at), _packed(tf, at)], names=["doc_id", "n", "terms", "counts"]
                )
                yield rows.filter(pa.array(n > 0))

    return run


def _document_counts(size: int):
    """Documents of a task that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(A.text_bytes(batch.column(0))[0].view(np.int32), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    return run


class ItemTile:
    """Weights of consecutive items as a dense matrix over the terms that these items ask for.

    A weight too large for an exact sum is dealt out over several columns of its term.
    """

    def __init__(self, first: int, weights: list[dict[int, int]], largest: int = EXACT // IMPACT):
        cells = []
        for i, w in enumerate(weights):
            for term, value in sorted(w.items()):
                for part, lo in enumerate(range(0, value, largest)):
                    cells.append((term, part, i, min(largest, value - lo)))
        columns = {c: j for j, c in enumerate(sorted({(t, p) for t, p, _, _ in cells}))}
        self.first, self.items, self.largest = first, len(weights), largest
        self.terms = np.array([t for t, _ in columns], np.int64)
        self.weight = np.zeros((len(weights), len(columns)))
        for term, part, i, value in cells:
            self.weight[i, columns[term, part]] = value

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Exact integer scores (items, docs) from sparse impacts sorted by document."""
        out = np.zeros((self.items, docs), np.int64)
        present = np.unique(term)
        columns = np.flatnonzero(np.isin(self.terms, present, assume_unique=False))
        at = 0
        while at < len(columns):
            # as many columns as keep every item's largest possible sum below 2**53
            part = columns[at : at + TERM_TILE]
            within = np.cumsum(self.weight[:, part], axis=1).max(axis=0) <= self.largest
            part = part[: max(1, int(within.sum()))]
            at += len(part)
            tile = np.zeros((len(part), docs))
            names, back = np.unique(self.terms[part], return_inverse=True)
            where = np.minimum(np.searchsorted(names, term), len(names) - 1)
            mine = names[where] == term
            dense = np.zeros((len(names), docs))
            dense[where[mine], doc[mine]] = impact[mine]
            tile[:] = dense[back]
            out += (self.weight[:, part] @ tile).astype(np.int64)
        return out


class Best:
    """The best rows of each item so far: highest score, then smallest document id, a null id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4

    def offer(self, first: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        least = self.least[first : first + len(scores)]
        if scores.shape[1] >= self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= least[:, None])
        if not len(item):
            return
        new = item + first, scores[item, doc], nulls[doc].astype(np.int64), ids[doc]
        rows = [np.concatenate(c) for c in zip(self.rows, new)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        begin = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
        self.rows = [c[rank < self.k] for c in rows]
        full = rank == self.k - 1
        self.least[rows[0][full]] = rows[1][full]


_FOUND = "item long, doc_id long, score long"


def _ranked(tiles: list[ItemTile], n_docs: int, n_terms: int, k: int):
    items = sum(t.items for t in tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            if 75 * int(n.max(initial=0)) * n_docs < 1 << 62:
                m = 25 + 75 * n * n_docs // n_terms
            else:
                m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
            raw, at = A.text_bytes(batch.column(2))
            term, at = raw.view(np.int32).astype(np.int64), at // 4
            tf = A.text_bytes(batch.column(3))[0].view(np.int32).astype(np.int64)
            doc = A.row_of(at)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            for lo in range(0, len(n), DOC_TILE):
                hi = min(len(n), lo + DOC_TILE)
                own = slice(at[lo], at[hi])
                for tile in tiles:
                    found = tile.scores(doc[own] - lo, term[own], impact[own], hi - lo)
                    best.offer(tile.first, found, ids[lo:hi], nulls[lo:hi])
        item, score, null, doc_id = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=null.astype(bool)), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def _asked(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times, bytes): terms of each item row with their counts, in the checkpoint folder."""
    rows = items.select(F.col("item_id").alias("item_id"), F.expr(f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), r'{PATTERN}', 0)").alias("w"))
    rows = saved(rows.where("size(w) > 0").withColumn("item", F.monotonically_increasing_id()))
    terms = rows.select("item", "item_id", F.explode("w").alias("term")).groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return saved(terms.withColumn("bytes", F.octet_length("term") + 16))


def _in_blocks(asked: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """Deals items to blocks of at most ``limit`` bytes of terms (a single larger item is a block of its own size)."""
    total, most, items = asked.groupBy("item").agg(F.sum("bytes").alias("b")).agg(F.sum("b"), F.max("b"), F.count(F.lit(1))).first()
    blocks = -(-(total or 0) // limit)
    while blocks:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
        if blocks == 1 or dealt.groupBy("block").agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= max(limit, most) or blocks > 4 * items:
            return dealt, blocks
        blocks *= 2
    return asked.withColumn("block", F.lit(0)), 0


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` best ``docs`` (``doc_id``, ``text``) for each row of ``items`` (``item_id``, ``text``).

    Terms are maximal runs of digits, ASCII letters and characters beyond ASCII, only A-Z lower-cased.  A
    term's weight is floor(1000 ln((2N+2)/(2df+1))), a document's impact for it 10**9 tf div (1000 tf + 8 m) with
    m = 25 + 75 n N div L, and a score the sum of weight times impact over the item's terms, repeats included;
    N documents hold L terms.  Only scores above 0 count.

    Returns (item_id, rank, doc_id, score); ranks are 1, 2, ... by falling score, equal scores by ascending
    doc_id, null ids after all others.  Null and empty texts and texts without a term match nothing and do
    not count in N.  Rows repeating an id are rows of their own, of documents and of items; an item id on
    two rows has two rankings.  Empty tables give no rows; other columns are ignored.

    Bounded: item terms go to the tasks in blocks of ``block_bytes``, each block scans the documents once; a
    task holds one tile of 512 documents and k rows an item.  Documents reach the driver only as counts.
    """
    asked = _asked(need(items, "item_id", "text"))
    dealt, blocks = _in_blocks(asked, block_bytes)
    texts = need(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts, totals = [], None
    for block in range(blocks):
        rows = dealt.where(F.col("block") == block).select("item", "term", "times").collect()
        if not rows:
            continue
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        held = saved(texts.mapInArrow(_held(Vocabulary(terms)), _HELD))
        totals = totals or held.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not totals[0]:
            break
        df = dict(held.select("terms").mapInArrow(_document_counts(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
        names = sorted({r["item"] for r in rows})
        weights: dict[int, dict[int, int]] = {i: {} for i in names}
        for r in rows:
            t = number[r["term"]]
            if df.get(t, 0):
                weights[r["item"]][t] = r["times"] * _weight(totals[0], df[t])
        tiles = [ItemTile(i, [weights[x] for x in names[i : i + ITEM_TILE]]) for i in range(0, len(names), ITEM_TILE)]
        found = held.mapInArrow(_ranked(tiles, totals[0], totals[1], k), _FOUND)
        order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        ids = held.sparkSession.createDataFrame([(i, x) for i, x in enumerate(names)], "item long, name long")
        parts.append(found.join(F.broadcast(ids), "item").select(F.col("name").alias("item"), "rank", "doc_id", "score"))
    if not parts:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")
