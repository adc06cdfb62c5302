"""Hard negatives by angular triangle filtering.

A few reference directions are fixed, and every vector keeps its norm and its angles to them.  For an anchor and
a row the triangle inequality on the sphere puts their angle between the largest difference and the smallest sum of
their angles to one direction, so their cosine lies in an interval, and times the norms their inner product
does.  Only rows whose interval meets what is asked for get the inner product itself, which is exact.

Rows of one label that lie near each other are packed into blocks that carry the range of their norms and angles;
block pairs whose intervals miss are never shipped.  An anchor block meets row blocks one at a time, the most
promising first, so that the rows found so far narrow the next search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import bounded_batches, saved
from corpusloom.llm.vector_dedup import _matrix
from corpusloom.operators.scale import salted_join

DIRECTIONS = 8
#: Vectors, by hash order, on which the directions are placed; they change the speed, never the result.
SAMPLE = 1024
ROWS_IN_BLOCK, ANCHORS_IN_BLOCK, ANCHOR_TILE = 2048, 4096, 64
#: Row blocks that one task meets for an anchor block.
BLOCKS_IN_SLICE = 4
#: Stored angles are single precision; the slack covers their rounding and that of arccos.
ANGLE_SLACK = 4e-6
LONG = (1 << 63) - 1


def _whole(flat: np.ndarray, at: np.ndarray, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length ``dim`` with finite components only, and floor(scale * component) of them."""
    n = np.diff(at)
    rows = np.flatnonzero(n == dim)
    x = flat[A.ranges(at[:-1][rows], n[rows])].reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x[ok])
    finite = np.isfinite(x).all(axis=1)
    return rows[ok][finite], x[finite]


def _lengths(scale: float):
    """(length, rows, largest component) of the usable vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            flat, at = _matrix(batch.column(0))
            for dim in np.unique(np.diff(at)):
                if not dim:
                    continue
                rows, x = _whole(flat, at, int(dim), scale)
                if len(rows):
                    old = seen.setdefault(int(dim), [0, 0.0])
                    old[0] += len(rows)
                    old[1] = max(old[1], float(np.abs(x).max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.float64())],
            names=["dim", "n", "most"],
        )

    return run


def norms_of(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1)
    top[top == 0] = 1
    return np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)) * top


def angles_of(x: np.ndarray, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of each row to each unit direction; a zero vector has angle 0 (its norm makes every bound 0)."""
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ directions.T, -1, 1))


def place_directions(x: np.ndarray, count: int) -> np.ndarray:
    """Unit directions spread over a sample: farthest points first, then three rounds of means."""
    n = norms_of(x)
    u = (x / np.where(n > 0, n, 1)[:, None])[n > 0]
    if not len(u):
        return np.eye(1, x.shape[1])
    picked = [0]
    near = u @ u[0]
    while len(picked) < min(count, len(u)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, u @ u[picked[-1]])
    d = u[picked]
    for _ in range(3):
        own = (u @ d.T).argmax(axis=1)
        sums = np.zeros_like(d)
        np.add.at(sums, own, u)
        size = np.linalg.norm(sums, axis=1)
        d = np.where((size > 1e-9)[:, None], sums / np.where(size > 1e-9, size, 1)[:, None], d)
    return d


class Space:
    """What all tasks know of the vectors of one length."""

    def __init__(self, dim: int, most: float, scale: float, directions: np.ndarray):
        self.dim, self.scale, self.directions = dim, scale, directions
        self.kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
        largest = dim * int(most) ** 2
        # double precision is exact below 2**53, 64-bit integers below 2**63, beyond them Python's integers
        self.exact = np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 else object

    def numbers(self, x: np.ndarray) -> np.ndarray:
        if self.exact is object:
            return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
        return x.astype(self.exact)

    def products(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer inner products; what a long cannot hold becomes the nearest long."""
        s = rows @ anchor
        if self.exact is object:
            return np.array([max(-LONG, min(LONG, int(v))) for v in s], np.int64)
        return s.astype(np.int64)


_ROW = "vec_id long, label long, anchor boolean, cell int, near float, norm double, angles binary, x binary"


def _described(space: Space):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _matrix(batch.column(3))
            rows, x = _whole(flat, at, space.dim, space.scale)
            norms = norms_of(x) if len(x) else np.zeros(0)
            angles = angles_of(x, norms, space.directions).astype(np.float32)
            cell = angles.argmin(axis=1) if len(x) else np.zeros(0, int)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i).take(take) for i in range(3)],
                    pa.array(cell.astype(np.int32)),
                    pa.array(angles[np.arange(len(x)), cell]),
                    pa.array(norms),
                    pa.array([v.tobytes() for v in angles], pa.binary()),
                    pa.array([v.tobytes() for v in x.astype(space.kind)], pa.binary()),
                ],
                names=["vec_id", "label", "anchor", "cell", "near", "norm", "angles", "x"],
            )

    return run


_BLOCK = (
    "block long, n int, label_lo long, label_hi long, norm_lo double, norm_hi double, lo array<double>, hi array<double>, "
    "ids binary, labels binary, norms binary, angles binary, x binary"
)


def _blocks(size: int, directions: int):
    """Consecutive rows as one packed row with the ranges of their labels, norms and angles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def close(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            col = {c: t.column(c).to_numpy() for c in ("vec_id", "label", "norm")}
            raw = [A.text_bytes(t.column(c))[0] for c in ("angles", "x")]
            angles = raw[0].view(np.float32).reshape(-1, directions).astype(float)
            one = [
                number, len(t), int(col["label"].min()), int(col["label"].max()), float(col["norm"].min()), float(col["norm"].max()),
                angles.min(axis=0).tolist(), angles.max(axis=0).tolist(),
                *[col[c].tobytes() for c in ("vec_id", "label", "norm")], *[r.tobytes() for r in raw],
            ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())] + [pa.binary()] * 5
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)], names=names)

        for batch in batches:
            held.append(batch)
            count += len(batch)
            while count >= size:
                t = pa.Table.from_batches(held)
                yield close(t.slice(0, size))
                number, held, count = number + 1, t.slice(size).to_batches(), count - size
        if count:
            yield close(pa.Table.from_batches(held))

    return run


def _packed(rows: DataFrame, size: int, directions: int) -> DataFrame:
    """Blocks of at most ``size`` rows in the order of label, nearest direction and angle to it.

    Equal vectors are told apart by id, so that a group of copies spreads over tasks.
    """
    order = ["label", "cell", "near", "vec_id"]
    blocks = max(1, -(-rows.count() // size))
    parts = rows.repartitionByRange(*order).coalesce(blocks).sortWithinPartitions(*order)
    return saved(parts.mapInArrow(_blocks(size, directions), _BLOCK))


_PARTS = ("ids", "labels", "norms", "angles", "x")


class Block:
    def __init__(self, space: Space, cells: dict[str, bytes]):
        self.ids, self.labels = (np.frombuffer(cells[c], np.int64) for c in ("ids", "labels"))
        self.norms = np.frombuffer(cells["norms"], np.float64)
        self.angles = np.frombuffer(cells["angles"], np.float32).reshape(len(self.ids), -1)
        self.x = space.numbers(np.frombuffer(cells["x"], space.kind).reshape(-1, space.dim))


def score_bounds(a: Block, tile: slice, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Safe lower and upper bounds of the inner products of some rows of ``a`` with all of ``b``."""
    apart = np.zeros((len(a.ids[tile]), len(b.ids)), np.float32)
    within = np.full(apart.shape, np.float32(np.pi))
    for r in range(b.angles.shape[1]):
        u, v = a.angles[tile, r, None], b.angles[None, :, r]
        np.maximum(apart, np.abs(u - v), out=apart)
        both = u + v
        np.minimum(within, np.minimum(both, np.float32(2 * np.pi) - both), out=within)
    with np.errstate(over="ignore", invalid="ignore"):
        size = a.norms[tile, None] * b.norms[None, :]
        slack = 1 + 1e-9 * size
        high = size * np.cos(np.maximum(0.0, apart.astype(float) - ANGLE_SLACK)) + slack
        low = size * np.cos(np.minimum(np.pi, within.astype(float) + ANGLE_SLACK)) - slack
    # norms beyond doubles bound nothing
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


def _best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
    return order[rank < k]


class Positives:
    """The k + 1 best rows of an anchor's own label, itself among them; ``slot`` 1 marks rows equal to it."""

    out = "anchors long, at int, anchor_id long, slot int, id long, score long"

    def __init__(self, space: Space, a: Block, k: int, windows: bytes | None):
        self.space, self.a, self.k = space, a, k + 1
        self.least = np.full(len(a.ids), -np.inf)
        self.rows = [np.zeros(0, np.int64)] * 4

    def meet(self, b: Block) -> None:
        found = []
        for lo in range(0, len(self.a.ids), ANCHOR_TILE):
            tile = slice(lo, lo + ANCHOR_TILE)
            alike = self.a.labels[tile, None] == b.labels[None, :]
            if not alike.any():
                continue
            _, high = score_bounds(self.a, tile, b)
            ask = alike & (high >= self.least[tile, None])
            for i in np.flatnonzero(ask.any(axis=1)):
                at = np.flatnonzero(ask[i])
                own = (b.ids[at] == self.a.ids[lo + i]).astype(np.int64)
                for j in np.flatnonzero(own):
                    own[j] = np.array_equal(b.x[at[j]], self.a.x[lo + i])
                found.append((lo + i, self.space.products(b.x[at], self.a.x[lo + i]), b.ids[at], own))
        self.keep(found)

    def keep(self, found: list[tuple]) -> None:
        """Merges (group, scores, ids, marks) into the best rows of each group."""
        if not found:
            return
        new = [np.concatenate([np.full(len(f[1]), f[0], np.int64) for f in found]), *[np.concatenate(c) for c in list(zip(*found))[1:]]]
        rows = [np.concatenate(c) for c in zip(self.rows, new)]
        best = _best(rows[0], rows[1], rows[2], self.k)
        self.rows = [c[best] for c in rows]
        n = np.bincount(self.rows[0], minlength=len(self.least))
        last = np.cumsum(n) - 1
        full = n >= self.k
        self.least[full] = self.rows[1][last[full]]

    def result(self):
        at, score, ids, own = self.rows
        return at, own, ids, score


class Negatives:
    """For each positive of an anchor the k best rows of other labels in the positive's window."""

    out = Positives.out

    def __init__(self, space: Space, a: Block, k: int, windows: bytes | None):
        self.space, self.a, self.k = space, a, k
        # one row a window: anchor, slot, low, high; sorted by anchor
        self.asked = np.frombuffer(windows, np.int64).reshape(-1, 4) if windows else np.zeros((0, 4), np.int64)
        self.least = self.asked[:, 2].copy()
        self.rows = [np.zeros(0, np.int64)] * 3

    def meet(self, b: Block) -> None:
        found = []
        first = np.searchsorted(self.asked[:, 0], np.arange(len(self.a.ids) + 1))
        for lo in range(0, len(self.a.ids), ANCHOR_TILE):
            hi = min(len(self.a.ids), lo + ANCHOR_TILE)
            tile, mine = slice(lo, hi), slice(first[lo], first[hi])
            if mine.start == mine.stop:
                continue
            other = self.a.labels[tile, None] != b.labels[None, :]
            if not other.any():
                continue
            low, high = score_bounds(self.a, tile, b)
            of = self.asked[mine, 0] - lo
            # a window is open from the k-th score found so far up to its end
            meets = other[of] & (high[of] >= self.least[mine, None]) & (low[of] <= self.asked[mine, 3, None])
            for i in np.flatnonzero(np.bincount(of, weights=meets.any(axis=1), minlength=hi - lo)):
                own = slice(first[lo + i], first[lo + i + 1])
                at = np.flatnonzero(meets[own.start - mine.start : own.stop - mine.start].any(axis=0))
                score = self.space.products(b.x[at], self.a.x[lo + i])
                for w in range(own.start, own.stop):
                    inside = (score >= self.least[w]) & (score <= self.asked[w, 3])
                    if inside.any():
                        found.append((w, score[inside], b.ids[at[inside]]))
        Positives.keep(self, found)

    def result(self):
        at, score, ids = self.rows
        return self.asked[at, 0], self.asked[at, 1], ids, score


def _search(kind: type, space: Space, k: int):
    """Rows of a task, sorted by anchor block and slice: first the anchors, then the row blocks that they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search, block = None, None, None

        def close() -> pa.RecordBatch:
            at, slot, ids, score = search.result()
            n = len(at)
            cols = [pa.array(np.full(n, block, np.int64)), pa.array(at.astype(np.int32)), pa.array(search.a.ids[at]), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)]
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in kind.out.split(", ")])

        for batch in batches:
            for row in range(len(batch)):
                r = {c: batch.column(c)[row].as_py() for c in ("anchors", "slice", "windows", *_PARTS)}
                if (r["anchors"], r["slice"]) != now:
                    if search is not None:
                        yield close()
                    now, block = (r["anchors"], r["slice"]), r["anchors"]
                    search = kind(space, Block(space, r), k, r["windows"])
                else:
                    search.meet(Block(space, r))
        if search is not None:
            yield close()

    return run


def _bound(highest: bool):
    """The largest or smallest possible inner product of two blocks' rows, from the ranges of their angles and norms."""
    gap = F.zip_with(F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("lo", "hi"), lambda p, q: F.greatest(q["lo"] - p["a_hi"], p["a_lo"] - q["hi"], F.lit(0.0)))
    both = F.zip_with(
        F.arrays_zip("a_lo", "a_hi"),
        F.arrays_zip("lo", "hi"),
        lambda p, q: F.least(p["a_hi"] + q["hi"], F.lit(2 * np.pi) - (p["a_lo"] + q["lo"]), F.lit(np.pi)),
    )
    angle = F.greatest(F.array_max(gap) - ANGLE_SLACK, F.lit(0.0)) if highest else F.least(F.array_min(both) + ANGLE_SLACK, F.lit(np.pi))
    sizes = [F.col("a_norm_lo") * F.col("norm_lo"), F.col("a_norm_hi") * F.col("norm_hi")]
    ends = [F.cos(angle) * s for s in sizes]
    slack = F.lit(1.0) + F.lit(1e-9) * sizes[1]
    return F.greatest(*ends) + slack if highest else F.least(*ends) - slack


_SUMMARY = ("block", "n", "label_lo", "label_hi", "norm_lo", "norm_hi", "lo", "hi")


def _pairs(anchors: DataFrame, rows: DataFrame, meets) -> DataFrame:
    """Pairs of summaries that may hold a result; a few hundred bytes a block."""
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in _SUMMARY], *[c for c in anchors.columns if c.startswith("win_")], F.lit(1).alias("all"))
    b = rows.select(*_SUMMARY, F.lit(1).alias("all"))
    pairs = salted_join(b, a, ["all"], ["block"]).withColumn("low", _bound(False)).withColumn("high", _bound(True))
    return pairs.where(meets)


def _met(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, kind: type, space: Space, k: int) -> DataFrame:
    """Ships the blocks of ``pairs`` to their anchor blocks and searches there.

    An anchor block that meets many row blocks does so in slices, each with the anchors of its own.
    """
    ranked = pairs.select(F.col("a_block").alias("anchors"), "block", "high")
    sizes = ranked.groupBy("anchors").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCKS_IN_SLICE)).cast("int").alias("slices"))
    ranked = salted_join(ranked, sizes, ["anchors"], ["block"]).withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int"))
    cells = [F.col(c) for c in _PARTS]
    windows = F.col("windows") if "windows" in anchors.columns else F.lit(None).cast("binary").alias("windows")
    first = anchors.withColumn("anchors", F.col("block")).join(sizes, "anchors").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    first = first.select("anchors", "slice", F.lit(0).alias("kind"), F.lit(0.0).alias("high"), windows, *cells)
    then = ranked.join(rows.select("block", *cells), "block")
    then = then.select("anchors", "slice", F.lit(1).alias("kind"), "high", F.lit(None).cast("binary").alias("windows"), *cells)
    dealt = first.union(then).repartition("anchors", "slice").sortWithinPartitions("anchors", "slice", "kind", F.desc("high"))
    return dealt.mapInArrow(_search(kind, space, k), kind.out)


def mine_hard_negatives(
    vectors: DataFrame, anchor, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: float = 256.0
) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (``vec_id``, ``label``, ``embedding``) for which ``anchor`` holds.

    A component becomes floor(scale * component); a score is the integer inner product with the anchor.  An anchor's
    positives are its ``positives`` best other rows of its label; for each of them the ``negatives`` best rows of other
    labels are returned whose score is from window[0] to window[1] percent of the positive's.  Higher scores
    come first, equal ones by smaller vec_id.

    Returns (anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all that exist.

    Rows with a null id or label, a null or empty vector, or a null, NaN or infinite component (also after scaling) take no
    part; labels are integers.  Only vectors of one length are compared with each other.  A zero vector scores 0; a
    positive with a score below 0 has an empty window.  Rows repeating an id are rows of their own: an anchor's other rows
    include its repeats, and an anchor id on two rows has two results.  Scores beyond a long become the nearest long.
    Empty tables give no rows; other columns are ignored.

    The result is exact; the directions, placed on a bounded sample, decide only how much is skipped.
    """
    given = bounded_batches(vectors).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("embedding")
    )
    given = given.where("vec_id is not null and label is not null and embedding is not null and not exists(embedding, v -> v is null)")
    lengths = given.select("embedding").mapInArrow(_lengths(scale), "dim long, n long, most double").groupBy("dim").agg(F.max("most").alias("most")).orderBy("dim")
    out = None
    for dim, most in lengths.collect():
        found = _of_one_length(given, int(dim), most, positives, negatives, window, scale)
        out = found if out is None else out.union(found)
    if out is None:
        out = given.sparkSession.createDataFrame([], _RESULT)
    return out


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _of_one_length(given: DataFrame, dim: int, most: float, positives: int, negatives: int, window: tuple[int, int], scale: float) -> DataFrame:
    mine = given.where(F.size("embedding") == dim)
    sample = mine.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    flat = np.array([r["embedding"] for r in sample], float).reshape(-1, dim)
    _, x = _whole(flat.reshape(-1), np.arange(len(flat) + 1) * dim, dim, scale)
    directions = place_directions(x, DIRECTIONS)
    space = Space(dim, most, scale, directions)
    rows = saved(mine.mapInArrow(_described(space), _ROW))
    blocks = _packed(rows.drop("anchor"), ROWS_IN_BLOCK, len(directions))
    anchors = _packed(rows.where("anchor").drop("anchor"), ANCHORS_IN_BLOCK, len(directions))
    alike = (F.col("label_lo") <= F.col("a_label_hi")) & (F.col("a_label_lo") <= F.col("label_hi"))
    near = saved(_met(anchors, blocks, _pairs(anchors, blocks, alike), Positives, space, positives))
    best = Window.partitionBy("anchors", "at").orderBy(F.desc("score"), "id")
    # of the rows equal to an anchor one is the anchor
    own = Window.partitionBy("anchors", "at", "slot").orderBy("id")
    near = near.withColumn("own", F.when(F.col("slot") == 1, F.row_number().over(own)).otherwise(0)).where("own != 1")
    near = saved(near.withColumn("slot", F.row_number().over(best)).where(F.col("slot") <= positives))
    p = F.col("score")
    low, high = _percent(p, window[0], True), _percent(p, window[1], False)
    asked = near.select("anchors", "at", "slot", low.alias("low"), high.alias("high")).where("low <= high")
    wanted = asked.groupBy("anchors").agg(
        F.array_sort(F.collect_list(F.struct("at", "slot", "low", "high"))).alias("w"), F.min("low").alias("win_lo"), F.max("high").alias("win_hi")
    )
    wanted = saved(wanted.mapInArrow(_bytes_of_windows, "block long, windows binary, win_lo long, win_hi long"))
    asking = anchors.join(wanted, "block")
    unlike = (F.col("label_lo") != F.col("a_label_lo")) | (F.col("label_hi") != F.col("a_label_hi")) | (F.col("label_lo") != F.col("label_hi"))
    touch = (F.col("high") >= F.col("win_lo")) & (F.col("low") <= F.col("win_hi"))
    far = _met(asking, blocks, _pairs(asking, blocks, unlike & (touch | F.isnan("low") | F.isnan("high"))), Negatives, space, negatives)
    best = Window.partitionBy("anchors", "at", "slot").orderBy(F.desc("score"), "id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    of = near.select("anchors", "at", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(of, ["anchors", "at", "slot"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _percent(score, percent: int, up: bool):
    """percent * score / 100 rounded up or down, without overflow: whole hundreds apart from the rest."""
    whole = F.expr("score div 100")
    rest = (score - whole * 100) * percent
    step = F.ceil(rest / F.lit(100.0)) if up else F.floor(rest / F.lit(100.0))
    return (whole * percent + step).cast("long")


def _bytes_of_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [np.array([[w["at"], w["slot"], w["low"], w["high"]] for w in ws], np.int64).tobytes() for ws in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), batch.column(2), batch.column(3)], names=["block", "windows", "win_lo", "win_hi"])
