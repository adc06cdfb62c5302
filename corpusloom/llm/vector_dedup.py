"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned into principal coordinates and sorted by the grid cells of the leading ones.  The
sorted sequence is cut into intervals; two intervals meet only when their bounding boxes are nearer than
the radius that the cosine allows, and inside a task they are halved recursively, skipping what is provably
distant.  Equal vectors are one row with a count, so a group of copies costs as much as one vector, and a
task returns link counts and a spanning forest, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import ROW, components, keyed, need, saved

COSINE = 0.95
GRID_DIMS = 4
BLOCK = 2048
LEAF = 256
SLACK = 1e-6


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat double values and bounds of a list column; null components become NaN, null lists are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat, np.r_[0, np.cumsum(sizes)]


def _described(dim: int):
    """Validity and a 128-bit content key of each vector, and the vector as bytes of doubles."""
    salt = A.mix(np.arange(1, 2 * dim + 1, dtype=np.uint64)).reshape(2, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _matrix(batch.column(2))
            n = np.diff(at)
            ok = n == dim
            x = np.zeros((len(n), dim))
            if ok.any():
                x[ok] = flat[A.ranges(at[:-1][ok], n[ok])].reshape(-1, dim)
            ok &= np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x[~ok] = 0
            top = np.abs(x).max(axis=1, keepdims=True)
            x /= np.where(top > 0, top, 1)  # no overflow or underflow in the norm
            x /= np.where(ok, np.linalg.norm(x, axis=1), 1)[:, None]
            bits = (x + 0.0).view(np.uint64)
            h = [A.mix(A.mix(bits + s) ^ s).sum(axis=1, dtype=np.uint64).view(np.int64) for s in salt]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ok), pa.array(h[0]), pa.array(h[1]), pa.array([v.tobytes() if k else None for v, k in zip(x, ok)], pa.binary())],
                names=["__row", "vec_id", "ok", "h1", "h2", "x"],
            )

    return run


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim))
        for batch in batches:
            x = A.text_bytes(batch.column(0))[0].view(np.float64).reshape(-1, dim)
            total[:dim] += x.T @ x
            total[dim] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["m"])

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes of the vectors' scatter around their mean, by falling variance; sums are aggregated by Spark."""
    sums = vectors.select("x").mapInArrow(_moments(dim), "m array<double>").select(F.posexplode("m").alias("i", "v"))
    got = {r[0]: r[1] for r in sums.groupBy("i").agg(F.sum("v")).collect()}
    m = np.array([got.get(i, 0.0) for i in range((dim + 1) * dim)]).reshape(dim + 1, dim)
    n = max(1, vectors.count())
    scatter = m[:dim] - np.outer(m[dim], m[dim]) / n
    return np.linalg.eigh((scatter + scatter.T) / 2)[1][:, ::-1].copy()


def _turned(axes: np.ndarray, width: float):
    dim = len(axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = A.text_bytes(batch.column(2))[0].view(np.float64).reshape(-1, dim) @ axes
            cells = np.zeros((len(x), GRID_DIMS), np.int32)  # short vectors have fewer axes
            cells[:, :dim] = np.floor(x[:, :GRID_DIMS] / width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(cells[:, i]) for i in range(GRID_DIMS)], pa.array([v.tobytes() for v in x], pa.binary())],
                names=["c", "n", *[f"g{i}" for i in range(GRID_DIMS)], "x"],
            )

    return run


_BLOCKS = "block long, lo array<double>, hi array<double>, ids binary, counts binary, x binary"


def _blocks(dim: int):
    """Consecutive intervals of the grid order, with their bounding boxes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close(rows: pa.Table):
            x = A.text_bytes(rows.column("x"))[0].view(np.float64).reshape(-1, dim)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]),
                    pa.array([x.min(axis=0)], pa.list_(pa.float64())),
                    pa.array([x.max(axis=0)], pa.list_(pa.float64())),
                    pa.array([rows.column("c").to_numpy().tobytes()], pa.binary()),
                    pa.array([rows.column("n").to_numpy().tobytes()], pa.binary()),
                    pa.array([x.tobytes()], pa.binary()),
                ],
                names=["block", "lo", "hi", "ids", "counts", "x"],
            )

        for batch in batches:
            held.append(batch.select(["c", "n", "x"]))
            size += batch.num_rows
            if size >= BLOCK:
                rows = pa.Table.from_batches(held)
                while rows.num_rows >= BLOCK:
                    yield close(rows.slice(0, BLOCK))
                    number, rows = number + 1, rows.slice(BLOCK)
                held, size = rows.to_batches(), rows.num_rows
        if size:
            yield close(pa.Table.from_batches(held))

    return run


def join_intervals(x: np.ndarray, y: np.ndarray | None, radius: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs of two intervals, or of one with itself (y is None: each pair once)."""
    z = x if y is None else y
    found_i, found_j = [], []
    box = {}

    def bounds(side: int, a: int, b: int):
        key = (side, a, b)
        if key not in box:
            part = (x if side == 0 else z)[a:b]
            box[key] = part.min(axis=0), part.max(axis=0)
        return box[key]

    stack = [(0, len(x), 0, len(z))]
    while stack:
        a, b, c, d = stack.pop()
        (l1, h1), (l2, h2) = bounds(0, a, b), bounds(0 if y is None else 1, c, d)
        gap = np.maximum(0, np.maximum(l1 - h2, l2 - h1))
        if gap @ gap > radius * radius:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ z[c:d].T >= cosine)
            i, j = i + a, j + c
            if y is None:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
            continue
        m, n = (a + b) // 2, (c + d) // 2
        if y is None and (a, b) == (c, d):
            stack += [(a, m, a, m), (a, m, m, b), (m, b, m, b)]
        elif b - a >= d - c:
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            stack += [(a, b, c, n), (a, b, n, d)]
    none = [np.zeros(0, np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions by links (i, j)."""
    label = np.arange(n)
    while len(i):
        old = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (old == label).all():
            break
    return label


def _joined(dim: int, cosine: float):
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same = batch.column(0)[r].as_py() == batch.column(1)[r].as_py()
                ids, counts, x = (np.frombuffer(batch.column(k)[r].as_py(), t) for k, t in ((2, np.int64), (3, np.int64), (4, np.float64)))
                other = (np.frombuffer(batch.column(k)[r].as_py(), t) for k, t in ((5, np.int64), (6, np.int64), (7, np.float64)))
                ids2, counts2, y = other
                x, y = x.reshape(-1, dim), y.reshape(-1, dim)
                i, j = join_intervals(x, None if same else y, radius, cosine)
                if not same:
                    j = j + len(x)
                    ids, counts = np.r_[ids, ids2], np.r_[counts, counts2]
                n = len(ids)
                links = np.bincount(i, counts[j], n) + np.bincount(j, counts[i], n)
                order = np.argsort(ids)
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                low = ids[order][_smallest(n, rank[i], rank[j])[rank]]
                hit = links > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(low[hit])], names=["c", "links", "low"]
                )

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links and groups of ``vectors(vec_id, embedding)`` with a cosine of at least ``cosine``.

    Vectors that are null, empty, zero or hold a null or non-finite component are linked with nothing; only vectors
    of one length are compared with each other, each length by itself; equal rows are linked; a null vec_id is
    never the smallest; an empty table gives no rows; other columns are ignored.  Every row is compared, nothing is approximate.
    Returns vec_id, n_links, component_id (smallest vec_id reachable, itself included).
    """
    rows = keyed(need(vectors, "vec_id", "embedding"))
    size = F.coalesce(F.size("embedding"), F.lit(0))
    lengths = [r[0] for r in rows.select(size.alias("d")).where("d > 0").distinct().orderBy("d").collect()]
    out = _alone(rows.where(size <= 0))
    for dim in lengths:
        out = out.unionByName(_of_one_length(rows.where(size == dim), dim, cosine))
    return out


def _alone(table: DataFrame) -> DataFrame:
    return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def _of_one_length(rows: DataFrame, dim: int, cosine: float) -> DataFrame:
    table = saved(rows.select(ROW, "vec_id", "embedding").mapInArrow(_described(dim), "__row long, vec_id long, ok boolean, h1 long, h2 long, x binary"))
    classes = saved(table.where("ok").groupBy("h1", "h2").agg(F.min(ROW).alias("c"), F.count(F.lit(1)).alias("n"), F.first("x").alias("x")))
    axes = principal_axes(classes, dim)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    schema = "c long, n long, " + ", ".join(f"g{i} int" for i in range(GRID_DIMS)) + ", x binary"
    turned = classes.select("c", "n", "x").mapInArrow(_turned(axes, radius), schema)
    order = [f"g{i}" for i in range(GRID_DIMS)] + ["c"]
    parts = max(1, -(-classes.count() // (4 * BLOCK)))
    blocks = saved(turned.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(dim), _BLOCKS))
    # Intervals meet through the cells of the first axis that they span; boxes decide.
    cell = lambda c: F.floor(c / F.lit(radius + SLACK))
    box = blocks.select("block", "lo", "hi", F.sequence(cell(F.col("lo")[0]), cell(F.col("hi")[0])).alias("cells"))
    left = box.select(F.col("block").alias("a"), F.col("lo").alias("l1"), F.col("hi").alias("h1"), F.explode("cells").alias("cell"))
    near = F.sequence(cell(F.col("lo")[0]) - 1, cell(F.col("hi")[0]) + 1)
    right = box.select(F.col("block").alias("b"), F.col("lo").alias("l2"), F.col("hi").alias("h2"), F.explode(near).alias("cell"))
    gap = F.expr(
        "aggregate(arrays_zip(l1, h1, l2, h2), 0d, (s, z) -> s + pow(greatest(0d, z.l1 - z.h2, z.l2 - z.h1), 2))"
    )
    pairs = left.join(right, "cell").where("a <= b").where(gap <= (radius + SLACK) ** 2).select("a", "b").distinct()
    one = blocks.select(F.col("block").alias("a"), "ids", "counts", "x")
    two = blocks.select(F.col("block").alias("b"), F.col("ids").alias("ids2"), F.col("counts").alias("counts2"), F.col("x").alias("x2"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "ids", "counts", "x", "ids2", "counts2", "x2")
    links = saved(met.mapInArrow(_joined(dim, cosine), "c long, links long, low long"))
    groups = components(links.select(F.col("c").alias("a"), F.col("low").alias("b")))
    per = links.groupBy("c").agg(F.sum("links").alias("links"))
    known = table.select(ROW, "vec_id", "ok", "h1", "h2").join(classes.select("c", "n", F.col("h1"), F.col("h2")), ["h1", "h2"], "left")
    known = known.where("ok").join(per, "c", "left").join(groups.select(F.col("node").alias("c"), "component"), "c", "left")
    known = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("p"))
    low = known.groupBy("p").agg(F.min("vec_id").alias("component_id"))
    linked = known.join(low, "p").select("vec_id", "n_links", "component_id")
    return linked.unionByName(_alone(table.where("not ok")))
