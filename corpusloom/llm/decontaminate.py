"""Benchmark decontamination with an FM-index per training shard.

Windows of consecutive benchmark words are looked up by backward search through the wavelet ranks of
a shard's Burrows-Wheeler text, their occurrences are located by sampled suffix positions, and the
occurrences are merged into removal spans.  Words that no benchmark item has cannot be part of an
occurrence, nor can a run of benchmark words shorter than the shortest window: both are replaced by one
separator before the index is built, so the index holds every place where a window can occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import ROW, boxed, keyed, need, released, stable

WINDOW = 10
SHARD_BYTES = 1 << 19
SAMPLE = 8
#: Benchmark rows sent to every task at once; a larger benchmark is searched block by block.
BLOCK_ITEMS = 20_000
WORDS = A.byte_class("alnum")


class FMIndex:
    """Index of a symbol text whose last symbol is 0; symbols are 0..sigma."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank, h = text.astype(np.int64), 1
        while True:
            key = rank * (n + sigma + 2)
            key[: n - h] += rank[h:] + 1
            sa = np.argsort(key)
            sorted_key = key[sa]
            fresh = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            rank = np.empty(n, np.int64)
            rank[sa] = fresh
            if fresh[-1] == n - 1:
                break
            h *= 2
        self.n = n
        bwt = text[sa - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))]
        self.bits = max(1, int(sigma).bit_length())
        self.ones, self.zeros = [], []
        level = bwt.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)])
            self.zeros.append(int(n - bit.sum()))
            level = np.r_[level[bit == 0], level[bit == 1]]
        self.bwt = bwt
        # First symbols after a separator are samples too, so that no walk crosses a separator.
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.marked = np.r_[0, np.cumsum(sampled)]
        self.samples = sa[sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` in the first ``i`` symbols of the transformed text."""
        lo, hi = np.zeros_like(i), i.copy()
        for k in range(self.bits):
            one = ((c >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the phrases (rows, left-aligned)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(int(lengths.max(initial=0))):
            at = lengths - 1 - step
            live = np.flatnonzero((at >= 0) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, at[live]]
            lo[live] = self.first[c] + self.rank(c, lo[live])
            hi[live] = self.first[c] + self.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking to the next sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            hit = self.marked[r + 1] > self.marked[r]
            out[live[hit]] = self.samples[self.marked[r[hit]]] + steps[live[hit]]
            live = live[~hit]
            c = self.bwt[rows[live]]
            rows[live] = self.first[c] + self.rank(c, rows[live])
            steps[live] += 1
        return out


class Phrases:
    """The distinct windows of benchmark items as symbol rows, and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, off = A.strings([t for _, t in items])
        data = A.fold(data)
        starts, ends, bounds = A.words(data, off, WORDS)
        self.items = [i for i, _ in items]
        self.vocabulary, symbol = np.unique(A.word_hash(data, starts, ends), return_inverse=True)
        symbol = symbol.reshape(-1) + 1
        seen: dict[bytes, int] = {}
        rows, lengths, pairs = [], [], set()
        for item, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            size = min(window, b - a)
            for k in range(a, b - size + 1 if size else a):
                w = symbol[k : k + size]
                at = seen.setdefault(w.tobytes(), len(rows))
                if at == len(rows):
                    rows.append(np.r_[w, np.zeros(window - size, np.int64)])
                    lengths.append(size)
                pairs.add((at, item))
        self.rows = np.array(rows, np.int64).reshape(-1, window)
        self.lengths = np.array(lengths, np.int64)
        self.shortest = int(self.lengths.min()) if len(rows) else 0
        self.pair_phrase, self.pair_item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.pair_at = np.searchsorted(self.pair_phrase, np.arange(len(rows) + 1))


def shard_hits(data: np.ndarray, off: np.ndarray, p: Phrases):
    """Word bounds by document, word spans (start, end), and the (phrase, first word) of each occurrence."""
    data = A.fold(data)
    starts, ends, bounds = A.words(data, off, WORDS)
    none = np.zeros(0, np.int64)
    if not len(p.rows) or not len(starts):
        return starts, ends, bounds, none, none
    h = A.word_hash(data, starts, ends)
    at = np.minimum(np.searchsorted(p.vocabulary, h), len(p.vocabulary) - 1)
    symbol = np.where(p.vocabulary[at] == h, at + 1, 0)
    # runs of known words inside one document
    edge = np.zeros(len(symbol) + 1, bool)
    edge[bounds] = True
    known = symbol > 0
    run_start = np.flatnonzero(known & np.r_[True, ~known[:-1] | edge[1:-1]])
    run_end = np.flatnonzero(known & np.r_[~known[1:] | edge[1:-1], True]) + 1
    long = run_end - run_start >= p.shortest
    run_start, size = run_start[long], (run_end - run_start)[long]
    if not len(size):
        return starts, ends, bounds, none, none
    place = A.ranges(run_start, size)
    gap = np.cumsum(size)
    text = np.insert(symbol[place], gap, 0)
    word = np.insert(place, gap, -1)
    index = FMIndex(text, len(p.vocabulary))
    lo, hi = index.search(p.rows, p.lengths)
    phrase = np.repeat(np.arange(len(lo)), hi - lo)
    return starts, ends, bounds, phrase, word[index.locate(A.ranges(lo, hi - lo))]


_SPAN = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_HITS = (
    "__row long, doc_id long, n_words long, n_hit long, "
    "spans array<struct<word:long, words:long, first:long, last:long>>, items array<string>"
)


def _search(p: Phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.text_bytes(batch.column(2))
            for a, b, part, cut in A.pieces(data, off, SHARD_BYTES):
                starts, ends, bounds, phrase, first = shard_hits(part, cut, p)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + p.lengths[phrase], -1)
                hit = np.cumsum(cover)[:-1] > 0
                total = np.r_[0, np.cumsum(hit)]
                spans, items = [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                doc = np.searchsorted(bounds, first, "right") - 1
                for d in np.unique(doc):
                    edges = np.diff(np.r_[0, hit[bounds[d] : bounds[d + 1]].astype(np.int8), 0])
                    for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
                        at, to = starts[bounds[d] + i] - cut[d], ends[bounds[d] + j - 1] - cut[d]
                        spans[d].append({"word": i, "words": j - i, "first": int(at), "last": int(to)})
                    found = np.unique(phrase[doc == d])
                    which = np.unique(p.pair_item[A.ranges(p.pair_at[found], np.diff(p.pair_at)[found])])
                    items[d] = sorted({p.items[i] for i in which if p.items[i] is not None})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(np.diff(total[bounds]), pa.int64()),
                        pa.array(spans, pa.list_(_SPAN)),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=["__row", "doc_id", "n_words", "n_hit", "spans", "items"],
                )

    return run


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Benchmark occurrences in ``docs(doc_id, text)``: one row per row of ``docs``, other columns ignored.

    ``benchmark(item_id, text)``; an item shorter than ``window`` words is one window; items without
    words (null or empty texts) occur nowhere, documents without words hit nothing; equal rows are
    judged one by one; an empty table gives no rows, or no hits.  Occurrences of an item whose id is
    null count as hits but name no item.
    Returns __row (a row key), doc_id, n_words, n_hit, spans (merged runs of hit words: first word,
    words, first and last byte), items (ids of occurring items as sorted strings).
    """
    rows = keyed(need(docs, "doc_id", "text"))
    asked = need(benchmark, "item_id", "text").where("text is not null").select(F.col("item_id").cast("string"), "text")
    blocks = max(1, -(-asked.count() // BLOCK_ITEMS))
    found = None
    for k in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).sort("item_id", "text")
        phrases = Phrases([(r[0], r[1]) for r in mine.toLocalIterator()], window)
        hits = rows.select(ROW, "doc_id", "text").mapInArrow(released(_search(phrases)), _HITS)
        found = hits if found is None else found.unionByName(hits)
    return found if blocks == 1 else _union(found)


def _union(found: DataFrame) -> DataFrame:
    """Hits of several benchmark blocks in one document, merged."""
    step = """case when size(a) > 0 and element_at(a, -1).word + element_at(a, -1).words >= x.word
        then array_append(slice(a, 1, size(a) - 1), named_struct(
            'word', element_at(a, -1).word,
            'words', greatest(element_at(a, -1).word + element_at(a, -1).words, x.word + x.words) - element_at(a, -1).word,
            'first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))
        else array_append(a, x) end"""
    g = found.groupBy(ROW).agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    g = g.withColumn("spans", F.expr(f"aggregate(s, slice(s, 1, 0), (a, x) -> {step})"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + x.words)")
    return g.select(ROW, "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _cut(text, spans):
    """The text without the bytes of the spans; nothing where no word is left."""
    if spans is None:
        return None
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : s["first"]])
        at = s["last"]
    rest = b"".join([*out, raw[at:]])
    return rest.decode() if WORDS[A.fold(np.frombuffer(rest, np.uint8))].any() else None


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every removal span cut out of its ``text``; a text that loses all its words goes.

    Rows without hits stay as they are, null texts included; all columns stay.
    """
    docs = stable(docs)
    hits = find_benchmark(docs, benchmark, window).where("n_hit > 0").select(ROW, F.col("spans").alias("__spans"))
    left = boxed(docs).join(hits, ROW, "left")
    # otherwise the filter below would be evaluated with a second run of the function, in workers of its own
    cut = F.udf(_cut, "string").asNondeterministic()
    text = F.when(F.col("__spans").isNotNull(), F.col("__doc.text"))
    left = left.withColumn("__cut", cut(text, "__spans")).where("__spans is null or __cut is not null")
    return left.select(F.col("__doc").withField("text", F.coalesce("__cut", "__doc.text")).alias("__doc")).select("__doc.*")
