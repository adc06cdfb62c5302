"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: every task packs its own documents best fit, emits bins that are
nearly full, and hands the rest on as items.  Underfull bins then meet in groups of bounded size, in
``ROUNDS`` rounds with a new grouping each, and whatever is still underfull in the end is emitted as
it is.  A bin is one row that carries its pieces (at most ``capacity`` of them, as a piece has a token
at least), so no round joins anything and no group grows with the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import need, released, saved

CAPACITY = 2048
NEARLY_FULL = 8
GROUP_BINS = 20_000
ROUNDS = 3
CACHE_WORDS = 150_000
PIECE = 1 << 19

BIN = (
    "bin long, fill int, done boolean, "
    "items array<struct<doc_id:long, piece:int, start:long, length:int, crc:long>>"
)
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())])
_BIN = pa.schema([("bin", pa.int64()), ("fill", pa.int32()), ("done", pa.bool_()), ("items", pa.list_(_ITEM))])
#: Bytes that do not print stand for themselves in no vocabulary: byte-level tokenizers move them to 256 and up.
_VISIBLE = {b: 256 + i for i, b in enumerate(x for x in range(256) if not (0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or x >= 0xAE))}
_KIND = np.full(256, 2, np.uint8)  # other marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[0x61:0x7B] = _KIND[0x80:] = 1
_KIND[0x30:0x3A] = 3
_ODD = np.ones(256, bool)
_ODD[9:14] = _ODD[0x20:0x7F] = _ODD[0xC3] = False
_ODD[0x27] = True


class Tokenizer:
    """Token ids of whole documents, each distinct word tokenised once per worker.

    For tokenizers of this kind: lower-casing, white space dropped, runs of letters, single digits and runs
    of other marks tokenised each by itself.  Documents of ASCII and Latin letters are cut into such runs as
    arrays; any other document (other scripts, apostrophes, special tokens) goes through the library as it is.
    """

    held: dict[str, Tokenizer] = {}

    @classmethod
    def at(cls, path: str) -> Tokenizer:
        return cls.held.get(path) or cls.held.setdefault(path, cls(path))

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library, self.known = Library.from_file(path), {}
        self.model = self.library.model

    def word(self, raw: bytes) -> tuple[int, ...]:
        text = raw.decode("latin-1")
        ids = tuple([t.id for t in self.model.tokenize(text if raw.isascii() else text.translate(_VISIBLE))])
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[raw] = ids
        return ids

    def documents(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each document."""
        lower, odd = _plain(data)
        plain = np.ones(len(off) - 1, bool)
        plain[np.searchsorted(off, odd, "right") - 1] = False
        kind = _KIND[lower]
        kind[np.repeat(~plain, np.diff(off))] = 0
        start = kind > 0
        last = start.copy()
        if len(lower):
            cut = np.zeros(len(lower) + 1, bool)
            cut[off] = True
            same = (kind[1:] == kind[:-1]) & (kind[1:] != 3) & ~cut[1:-1]
            start[1:] &= ~same
            last[:-1] &= ~same
        starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
        bounds = np.searchsorted(starts, off)
        distinct, first, token = np.unique(A.word_hash(lower, starts, ends), return_index=True, return_inverse=True)
        raw, known = lower.tobytes(), self.known
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found = [known.get(w) or self.word(w) for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
        at, token = np.r_[0, np.cumsum(size)], token.reshape(-1)
        ids = flat[A.ranges(at[token], size[token])]
        stop = np.r_[0, np.cumsum(size[token])][bounds]
        out = [ids[a:b].tobytes() for a, b in zip(stop[:-1].tolist(), stop[1:].tolist())]
        for d in np.flatnonzero(~plain).tolist():
            text = data[off[d] : off[d + 1]].tobytes().decode()
            out[d] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out


A.KEPT.append(Tokenizer.held.clear)


def _plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and places where something stands that only the library handles."""
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    lower = A.fold(data)
    lower[after_c3 & (data >= 0x80) & (data <= 0x9E)] += 0x20
    odd = _ODD[data] & ~(after_c3 & (data >= 0x80) & (data != 0x97) & (data != 0xB7))
    odd[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
    return lower, np.flatnonzero(odd)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of ``sizes`` by bin."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - s
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


def _emit(bins: list[tuple[int, list]], capacity: int, first: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (fill, items) bins, numbered from ``first``."""
    for lo in range(0, len(bins), 5000):
        part = bins[lo : lo + 5000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([first + lo + i for i in range(len(part))], pa.int64()),
                pa.array([f for f, _ in part], pa.int32()),
                pa.array([last or f >= capacity - NEARLY_FULL for f, _ in part], pa.bool_()),
                pa.array([x for _, x in part], pa.list_(_ITEM)),
            ],
            schema=_BIN,
        )


def _number(round_no: int) -> int:
    from pyspark import TaskContext

    return (round_no << 58) + (TaskContext.get().partitionId() << 32)


def _cut_and_pack(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = Tokenizer.at(path), np.array([end_id], "<u4").tobytes()
        first, full, items = _number(1), [], []

        def flush():
            nonlocal first
            sizes = [x[3] for x in items]
            bins = full + [(sum(sizes[i] for i in b), [items[i] for i in b]) for b in best_fit(sizes, capacity)]
            yield from _emit(bins, capacity, first, False)
            first += len(bins)
            full.clear()
            items.clear()

        for batch in batches:
            data, off = A.text_bytes(batch.column(1))
            docs = iter(batch.column(0).to_pylist())
            for _, _, part, cuts in A.pieces(data, off, PIECE):
                for raw in tokens.documents(part, cuts):
                    doc, raw = next(docs), raw + end
                    for k in range(0, len(raw) // 4, capacity):
                        cut = raw[4 * k : 4 * (k + capacity)]
                        item = (doc, k // capacity, k, len(cut) // 4, zlib.crc32(cut))
                        if len(cut) == 4 * capacity:
                            full.append((capacity, [item]))
                        else:
                            items.append(item)
                if len(items) + len(full) >= GROUP_BINS:
                    yield from flush()
        yield from flush()

    return run


def _merge(capacity: int, round_no: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = _number(round_no), []

        def flush():
            nonlocal first
            sizes = [f for f, _ in held]
            bins = [(sum(sizes[i] for i in b), [x for i in b for x in held[i][1]]) for b in best_fit(sizes, capacity)]
            yield from _emit(bins, capacity, first, last)
            first += len(bins)
            held.clear()

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            held += [(f, [tuple(x.values()) for x in items]) for f, items in rows]
            if len(held) >= 2 * GROUP_BINS:
                yield from flush()
        yield from flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their places in sequences of at most ``capacity`` tokens.

    A document's ids are its tokens and then ``end_id``; a null or empty text is the end id alone, a
    null ``doc_id`` stays null, equal rows are packed once each, an empty table gives no rows, and
    columns besides the two are ignored.  Documents over ``capacity`` are cut into full pieces and a
    shorter last one; no other document is cut.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    local = need(docs, "doc_id", "text").mapInArrow(released(_cut_and_pack(tokenizer_path, capacity, end_id)), BIN)
    level, out = saved(local), []
    for r in range(2, 2 + ROUNDS):
        out.append(level.where("done"))
        rest = level.where("not done")
        groups = -(-rest.count() // GROUP_BINS)
        if not groups:
            break
        # Groups are dealt by a hash of the bin's number, so they are alike and stay bounded.
        dealt = rest.repartition(groups, F.xxhash64("bin")).sortWithinPartitions("bin").select("fill", "items")
        level = saved(dealt.mapInArrow(released(_merge(capacity, r, last=r == 1 + ROUNDS or groups == 1)), BIN))
    else:
        out.append(level)
    bins = out[0]
    for more in out[1:]:
        bins = bins.unionByName(more)
    return explode_bins(bins)


def explode_bins(bins: DataFrame) -> DataFrame:
    """One row per piece, with its gapless offset inside the sequence."""
    ends = F.expr("aggregate(items, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x.length))")
    rows = bins.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip(F.col("items").alias("i"), F.slice(ends, F.lit(1), F.size("items")).alias("o"))).alias("z"))
    return rows.select(
        F.col("z.i.doc_id").alias("doc_id"),
        F.col("z.i.piece").alias("piece"),
        F.col("z.i.start").alias("start"),
        F.col("z.i.length").cast("long").alias("length"),
        F.col("z.i.crc").alias("ids_crc32"),
        "sequence_id",
        F.col("z.o").alias("offset"),
    )
