"""Removal of long strings that start more than once in a corpus, by a hash-compared suffix sort.

Sorting every suffix of a corpus moves many times its size, so suffixes meet by anchors.  A window of
``LENGTH`` bytes is anchored at the smallest hash of the ``GRAM``-byte strings inside it, which depends on the
window's bytes alone; equal windows have equal anchors at equal places, and neighbouring windows mostly share
one.  Per anchor occurrence there is one run of windows and one context, the bytes that these windows cover.

Runs whose anchor occurs once are unique.  Equal contexts make all their windows repeated.  The different
contexts of an anchor are suffix-sorted: a mergesort whose comparisons find the common extension of two
suffixes by binary search over polynomial prefix hashes, to the right and to the left of the anchor; common
extensions of neighbours are verified byte by byte.  A window is repeated if another context agrees with it on
enough bytes on either side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import ROW, keyed, need, saved, split_by_keys

LENGTH = 400
GRAM = 64
PIECE = 1 << 20
#: Contexts sorted at a time.
SORTED = 8192
#: An anchor with more different contexts is hot: its windows meet by their hashes, spread over all tasks.
HOT = 4096


def anchored_runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: (document, anchor, first window, last window, anchor key), in ``data``."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    n = len(data) - length + 1
    if n <= 0:
        return none
    h = A.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    key = A.mix(A.span_hash(h, at, at + gram))
    bits = max(20, int(len(key)).bit_length())
    low = np.uint64((1 << bits) - 1)
    ranked = (key & ~low) | at.astype(np.uint64)
    width = length - gram + 1
    blocks = -(-len(ranked) // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[: len(ranked)] = ranked
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
    size = np.diff(off)
    inside = np.zeros(n, bool)
    docs = np.flatnonzero(size >= length)
    inside[A.ranges(off[docs], size[docs] - length + 1)] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (anchor[1:] != anchor[:-1])
    i0, i1 = np.flatnonzero(first), np.flatnonzero(last)
    p = anchor[i0]
    return np.searchsorted(off, i0, "right") - 1, p, i0, i1, key[p]


_RUNS = "__row long, p long, i0 long, i1 long, m long, c long"


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            data, off = A.text_bytes(batch.column(1))
            for a, _, part, cut in A.pieces(data, off, PIECE):
                doc, p, i0, i1, m = anchored_runs(part, cut, length, gram)
                if not len(doc):
                    continue
                c = A.span_hash(A.prefix_hash(part), i0, i1 + length)
                c = A.mix(c + A.mix(((p - i0) * 65536 + (i1 - i0)).astype(np.uint64) + np.uint64(1)))
                base = cut[doc]
                cols = [rows[a + doc], p - base, i0 - base, i1 - base, m.view(np.int64), c.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["__row", "p", "i0", "i1", "m", "c"])

    return run


class Suffixes:
    """Contexts around their anchors, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.data, self.hash, self.anchor, self.sides = data, A.prefix_hash(data), anchor, {1: right, -1: left}

    def common(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        """Common extension of contexts x and y to one side of the anchor, by binary search."""
        ax, ay = self.anchor[x], self.anchor[y]
        low, high = np.zeros(len(x), np.int64), np.minimum(self.sides[side][x], self.sides[side][y])
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) // 2
            if side > 0:
                same = A.span_hash(self.hash, ax, ax + mid) == A.span_hash(self.hash, ay, ay + mid)
            else:
                same = A.span_hash(self.hash, ax - mid, ax) == A.span_hash(self.hash, ay - mid, ay)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)

    def before(self, x: np.ndarray, y: np.ndarray, side: int) -> np.ndarray:
        """Whether x sorts before y; a context that ends first sorts first, equal ones by number."""
        n = self.common(x, y, side)
        rx, ry = self.sides[side][x], self.sides[side][y]
        ended = n == np.minimum(rx, ry)
        step = n if side > 0 else -n - 1
        bx = self.data[np.clip(self.anchor[x] + step, 0, len(self.data) - 1)]
        by = self.data[np.clip(self.anchor[y] + step, 0, len(self.data) - 1)]
        return np.where(ended, np.where(rx == ry, x < y, rx < ry), bx < by)

    def sort(self, group: np.ndarray, side: int) -> np.ndarray:
        """Mergesort inside each group (``group`` is sorted): all runs of a level are merged at once."""
        start = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - start
        order = np.arange(len(group))
        width, most = 1, int(size.max(initial=0))
        while width < most:
            # an element's place after merging: its rank in its own run and its rank in the sibling run
            q = np.arange(len(group)) - start
            block = q // width
            sib = (block ^ 1) * width
            low = np.minimum(sib, size)
            high = np.minimum(sib + width, size)
            first = low.copy()
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) // 2
                smaller = self.before(order[start[live] + mid], order[live], side)
                low[live] = np.where(smaller, mid + 1, low[live])
                high[live] = np.where(smaller, high[live], mid)
            place = start + (block & ~1) * width + (q - block * width) + (low - first)
            moved = np.empty_like(order)
            moved[place] = order
            order, width = moved, width * 2
        return order

    def neighbours(self, order: np.ndarray, group: np.ndarray, side: int) -> np.ndarray:
        """Common extension of each context in ``order`` with the one before it (-1: none), verified on the bytes."""
        out = np.full(len(order), -1)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = order[at - 1], order[at]
        n = self.common(x, y, side)
        raw = self.data.tobytes()
        for i, (a, b, k) in enumerate(zip(self.anchor[x].tolist(), self.anchor[y].tolist(), n.tolist())):
            u, v = (raw[a : a + k], raw[b : b + k]) if side > 0 else (raw[a - k : a], raw[b - k : b])
            if u != v:  # equal hashes of different bytes
                u, v = (u, v) if side > 0 else (u[::-1], v[::-1])
                n[i] = next(j for j in range(k) if u[j] != v[j])
        out[at] = n
        return out


def repeated_windows(s: Suffixes, group: np.ndarray, near: np.ndarray, far: np.ndarray, length: int):
    """(context, first, last) of runs of window offsets before the anchor that occur in another context, too.

    A context's windows start ``near`` to ``far`` bytes before its anchor.
    """
    n = len(group)
    right, left = s.sort(group, 1), s.sort(group, -1)
    ext_r, ext_l = s.neighbours(right, group, 1), s.neighbours(left, group, -1)
    hit = np.zeros((n, int(far.max(initial=0)) + 3), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for j in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
        valid = np.flatnonzero((near <= j) & (j <= far))
        if len(valid) < 2:
            continue
        class_r[right] = np.cumsum(ext_r < length - j)
        class_l[left] = np.cumsum(ext_l < j)
        both = class_r[valid] * (n + 1) + class_l[valid]
        order = np.argsort(both)
        both = both[order]
        same = both[1:] == both[:-1]
        hit[valid[order[1:][same]], j + 1] = True
        hit[valid[order[:-1][same]], j + 1] = True
    edge = np.diff(hit.astype(np.int8), axis=1)
    x, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return x, a, b - 1


_CONTEXTS = "m long, __row long, p long, i0 long, i1 long, bytes binary"


def _contexts(length: int):
    """Contexts of the runs listed with each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                out += [(r["m"], row, r["p"], r["i0"], r["i1"], raw[r["i0"] : r["i1"] + length]) for r in runs]
            for a in range(0, len(out), 10_000):
                cols = list(zip(*out[a : a + 10_000]))
                kinds = [pa.int64()] * 5 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["m", "__row", "p", "i0", "i1", "bytes"])

    return run


def _window_hashes(length: int):
    """128-bit hashes of all windows of the listed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[r].as_py().encode(), np.uint8)
                runs = batch.column(2)[r].as_py()
                at = np.unique(np.concatenate([np.arange(x["i0"], x["i1"] + 1) for x in runs]))
                h = A.prefix_hash(data)
                k = A.prefix_hash(data[::-1])
                one, two = A.mix(A.span_hash(h, at, at + length)), A.mix(A.span_hash(k, len(data) - at - length, len(data) - at))
                rows = np.full(len(at), batch.column(0)[r].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows, at, one.view(np.int64), two.view(np.int64))], names=["__row", "i", "w1", "w2"])

    return run


_SPANS = "__row long, first long, last long"


def _sorted_spans(length: int):
    """Removal spans of contexts that come sorted by anchor key."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        m, row, p, i0, i1 = (rows.column(k).to_numpy() for k in range(5))
        data, off = A.text_bytes(rows.column(5))
        group = np.cumsum(np.r_[0, m[1:] != m[:-1]])
        s = Suffixes(data, off[:-1] + p - i0, p - i0, i1 + length - p)
        x, a, b = repeated_windows(s, group, p - i1, p - i0, length)
        return pa.RecordBatch.from_arrays([pa.array(row[x]), pa.array(p[x] - b), pa.array(p[x] - a + length)], names=["__row", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows >= SORTED + HOT:
                m = held.column(0).to_numpy()
                cut = int(np.searchsorted(m, m[SORTED]))  # groups stay whole
                cut = cut or int(np.searchsorted(m, m[SORTED], "right"))
                if cut >= held.num_rows:
                    break
                yield solve(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield solve(held.combine_chunks())

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, spans): bytes of ``docs(doc_id, text)`` covered by a string of ``length`` bytes that also starts elsewhere."""
    rows = keyed(need(docs, "doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    runs = rows.where(F.octet_length("text") >= length).select(ROW, "text").mapInArrow(_runs(length, gram), _RUNS)
    # Counts are written before they are joined: a join of two plain shuffles lets Spark split a hot anchor.
    often = saved(runs.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m"))
    runs = saved(runs.join(often, "m"))
    contexts = runs.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(ROW, "p", "i0", "i1")).alias("r"))
    contexts = saved(contexts)
    equal = runs.join(contexts.where("n > 1").select("m", "c"), ["m", "c"])
    spans = equal.select(ROW, F.col("i0").alias("first"), (F.col("i1") + length).alias("last"))
    # different contexts of one anchor, one run for each
    some = contexts.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    other = saved(contexts.join(some, "m").select("m", "k", "r.*"))
    listed = lambda df: df.groupBy(ROW).agg(F.collect_list(F.struct("m", "p", "i0", "i1")).alias("runs"))
    text, _ = split_by_keys(rows.select(ROW, "text"), other)
    plain = text.join(listed(other.where(F.col("k") <= HOT)), ROW).select(ROW, "text", "runs").mapInArrow(_contexts(length), _CONTEXTS)
    found = plain.repartition("m").sortWithinPartitions("m").mapInArrow(_sorted_spans(length), _SPANS)
    spans = spans.unionByName(found)
    hot = other.where(F.col("k") > HOT)
    if not hot.isEmpty():
        windows = text.join(listed(hot), ROW).select(ROW, "text", "runs").mapInArrow(_window_hashes(length), "__row long, i long, w1 long, w2 long")
        twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
        hit = windows.join(twice, ["w1", "w2"])
        spans = spans.unionByName(hit.select(ROW, F.col("i").alias("first"), (F.col("i") + length).alias("last")))
    return rows, spans


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for s in sorted((s["first"], s["last"]) for s in spans or ()):
                    if s[0] > end:
                        kept.append(raw[at : s[0]])
                        count += 1
                        at = end = s[0]
                    if s[1] > end:
                        removed += s[1] - end
                        at = end = s[1]
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), removed, count, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without its repeated bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the input, in the
    same text included; strings do not cross texts.  Null texts are empty; texts shorter than ``length`` lose
    nothing; equal rows repeat each other; an empty table gives no rows; other columns are ignored.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes, if asked).
    """
    rows, spans = repeated_spans(docs, length, gram)
    per = saved(spans.groupBy(ROW).agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    cut, whole = split_by_keys(rows, per)
    both = cut.join(per, ROW, "left").select("doc_id", "text", "spans")
    if whole is not None:
        both = both.unionByName(whole.select("doc_id", "text", F.lit(None).cast("array<struct<first:long, last:long>>").alias("spans")))
    return both.mapInArrow(_cut(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
