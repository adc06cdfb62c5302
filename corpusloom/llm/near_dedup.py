"""Near-duplicate documents by SuperMinHash signatures, banding, verification and components.

SuperMinHash gives every element one correlated permutation of the signature's slots: step j of the
permutation offers the value ``j + u`` to its slot, so signatures have a lower variance than independent
minima and an element stops as soon as every slot of its document holds a value of an earlier step.

Documents with equal shingle sets form one class and only classes are compared.  In a bucket of a band
each class is paired with one centre, never with all others; pairs are confirmed on the full shingle sets,
confirmed pairs give components.  Components that still share a bucket and have alike signatures form a
family, and the classes of a family are compared across its components on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import ROW, boxed, components, fitted, keyed, need, released, saved, stable

SHINGLE = 5
THRESHOLD = (80, 100)
SLOTS = 128
BANDS = 32
#: Fewer equal slots than this are 4.5 deviations below a similarity at the threshold of 0.8.
LEAST_EQUAL = 82
#: Row keys sent to every task at once when texts are fetched for verification; more go through a join.
KEYS_SENT = 2_000_000
#: Rows of a bucket or family that meet in one task.
BLOCK = 2048
WORDS = A.byte_class("space")
PIECE = 1 << 18
_PLACE = A.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
_STEP = A.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes document by document, and n+1 bounds."""
    data = A.fold(data)
    starts, ends, bounds = A.words(data, off, WORDS)
    h = A.word_hash(data, starts, ends)
    if len(h) >= size:
        acc = h[: len(h) - size + 1] * _PLACE[0]
        for j in range(1, size):
            acc = acc + h[j : len(h) - size + 1 + j] * _PLACE[j]
        acc = A.mix(acc)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(acc[a : b - size + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                sets.append(A.mix(np.array([np.sum(h[a:b] * _PLACE[: b - a]) + np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    n = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(n)]


def _offer(s: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Step j of each element: the 25-bit value and the place the permutation swaps with."""
    z = A.mix(s + _STEP[j])
    return (z >> np.uint64(39)).astype(np.uint32), j + (((z & _LOW) * np.uint64(slots - j)) >> _32).astype(np.int64)


def signatures(s: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each document's set: (documents, slots) values, step in the top 7 bits."""
    docs = len(bounds) - 1
    full = np.uint32(0xFFFFFFFF)
    sig = np.full(docs * slots, full, np.uint32)
    doc = A.row_of(bounds)
    swaps: list[np.ndarray] = []
    perm = None
    for j in range(slots):
        if not len(s):
            break
        value, k = _offer(s, j, slots)
        if perm is None and j == 4:
            # elements still needed keep their whole permutation from here on
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(s), 1))
            at = np.arange(len(s))
            for t, w in enumerate(swaps):
                held = perm[at, t].copy()
                perm[at, t] = perm[at, w]
                perm[at, w] = held
        if perm is None:
            slot = k.copy()
            for t in range(j - 1, -1, -1):
                w = swaps[t]
                slot = np.where(slot == w, t, np.where(slot == t, w, slot))
            swaps.append(k)
        else:
            at = np.arange(len(s))
            slot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = slot
        np.minimum.at(sig, doc * slots + slot, value | np.uint32(j << 25))
        unfilled = (sig.reshape(docs, slots) == full).any(axis=1)
        live = unfilled[doc]
        if not live.all():
            s, doc = s[live], doc[live]
            swaps = [w[live] for w in swaps]
            perm = perm[live] if perm is not None else None
    return sig.reshape(docs, slots)


_SIGNED = "__row long, doc_id long, n long, h1 long, h2 long, sig binary"


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.text_bytes(batch.column(2))
            for a, b, part, cut in A.pieces(data, off, PIECE):
                s, bounds = shingle_sets(part, cut, size)
                n = np.diff(bounds)
                sig = signatures(s, bounds)
                sums = []
                for salt in (0x1234567, 0x7654321):
                    c = np.zeros(len(s) + 1, np.uint64)
                    np.cumsum(A.mix(s ^ np.uint64(salt)), out=c[1:])
                    sums.append((c[bounds[1:]] - c[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        batch.column(1)[a:b],
                        pa.array(n, pa.int64()),
                        pa.array(sums[0], pa.int64()),
                        pa.array(sums[1], pa.int64()),
                        pa.array([x.tobytes() if k else b"" for x, k in zip(sig, n)], pa.binary()),
                    ],
                    names=["__row", "doc_id", "n", "h1", "h2", "sig"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = SLOTS // BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        body, off = A.text_bytes(batch.column(1))
        sig = body.view(np.uint32).reshape(len(off) - 1, BANDS, rows).astype(np.uint64)
        acc = np.broadcast_to(_STEP[:BANDS], sig.shape[:2]).copy()
        for j in range(rows):
            acc = A.mix(acc + sig[:, :, j] * _PLACE[j])
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(acc.reshape(-1).view(np.int64)), pa.array(ids)], names=["band", "c"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (A.text_bytes(batch.column(i))[0].view(np.uint32).reshape(-1, SLOTS) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _confirm(size: int, least: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a = batch.column(0).to_numpy()
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != last:
                    last = a[i]
                    left, _ = shingle_sets(*A.text_bytes(batch.column(2)[i : i + 1]), size)
                right, _ = shingle_sets(*A.text_bytes(batch.column(3)[i : i + 1]), size)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep[i] = of * common >= least * (len(left) + len(right) - common)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = A.text_bytes(batch.column(1))[0].view(np.uint32).reshape(-1, SLOTS).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in sig], pa.binary())], names=["c", "sig"])


def _in_blocks(df: DataFrame, key: str, member: str) -> DataFrame:
    """Rows in groups ``k`` of a bounded size, in which each asking row of a ``key`` meets all rows of it.

    ``df`` has a column ``asks``.  Asking rows are dealt into parts and so are all rows; a group is a part of
    the ones (``role`` true) and a part of the others.  Sorted by ``k``.
    """
    count = lambda c: F.ceil(F.sum(c) / F.lit(BLOCK)).cast("int")
    parts = df.groupBy(key).agg(count(F.lit(1)).alias("__all"), count(F.col("asks").cast("int")).alias("__ask"))
    rows = df.join(parts.where("__ask > 0"), key)
    spot = F.xxhash64(member)
    rows = rows.withColumn("__a", F.pmod(spot, F.col("__ask")).cast("int")).withColumn("__b", F.pmod(spot, F.col("__all")).cast("int"))
    places = F.expr(
        "concat(transform(sequence(0, __ask - 1), x -> struct(x as a, __b as b, false as role)),"
        " if(asks, transform(sequence(0, __all - 1), x -> struct(__a as a, x as b, true as role)), array()))"
    )
    rows = rows.withColumn("__at", F.explode(places)).withColumn("k", F.xxhash64(key, "__at.a", "__at.b")).withColumn("role", F.col("__at.role"))
    return rows.drop("__all", "__ask", "__a", "__b", "__at").repartition("k").sortWithinPartitions("k")


def _asking(df: DataFrame, key: str, label: str) -> DataFrame:
    """``df`` with ``asks``: whether the row's label is not the most frequent one of its ``key``."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("__n"))
    most = n.groupBy(key).agg(F.max_by(label, F.struct("__n", label)).alias("__most"))
    return df.join(most, key).withColumn("asks", F.col(label) != F.col("__most")).drop("__most")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of the rows of one ``k`` each, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(0).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(k)].tolist()):
            if a == b:
                continue
            if held and held[-1].column(0)[-1].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _alike_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest over the families of a bucket that have classes with alike signatures.

    The slots come as their lowest bytes: equal slots stay equal, so no alike pair is lost, and what is joined in
    excess is told apart later on full sets.
    """
    for rows in _groups(batches):
        p, at = np.unique(rows.column("p").to_numpy(), return_inverse=True)
        role = rows.column("role").to_numpy(zero_copy_only=False)
        sig = A.text_bytes(rows.column("sig"))[0].reshape(-1, SLOTS)
        at = at.reshape(-1)
        label, members, home = np.arange(len(p)), sig[~role], at[~role]
        for i in np.flatnonzero(role).tolist():
            near = home[(members == sig[i]).sum(axis=1) >= LEAST_EQUAL]
            seen = np.unique(label[np.r_[near, at[i]]])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
        far = np.flatnonzero(label != np.arange(len(p)))
        yield pa.RecordBatch.from_arrays([pa.array(p[label[far]]), pa.array(p[far])], names=["a", "b"])


def _linked(size: int, least: int, of: int):
    """Links across components inside a family: each asking class against all, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            s, at = shingle_sets(*A.text_bytes(rows.column("text")), size)
            ids, p = rows.column("c").to_numpy(), rows.column("p").to_numpy()
            label = p.copy()
            n = np.diff(at)
            distinct, code = np.unique(s, return_inverse=True)
            code, mark = code.reshape(-1), np.zeros(len(distinct), np.int64)
            a, b = [], []
            for i in np.flatnonzero(rows.column("role").to_numpy(zero_copy_only=False)).tolist():
                mine = code[at[i] : at[i + 1]]
                mark[mine] = 1
                common = np.add.reduceat(mark[code], at[:-1])
                mark[mine] = 0
                new = (of * common >= least * (n + n[i] - common)) & (label != label[i])
                for j in np.flatnonzero(new).tolist():
                    if label[j] != label[i]:
                        a.append(ids[i])
                        b.append(ids[j])
                        label[label == label[j]] = label[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _only(keys: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = batch.column(0).to_numpy()
            at = np.minimum(np.searchsorted(keys, r), len(keys) - 1)
            yield batch.filter(pa.array(keys[at] == r))

    return run


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(__row, text) of the wanted row keys; their keys go to every task only when there are few."""
    wanted = wanted.distinct()
    some = wanted.limit(KEYS_SENT + 1).toPandas()[ROW].to_numpy()
    if len(some) > KEYS_SENT:
        return rows.select(ROW, "text").join(wanted, ROW, "left_semi")
    if not len(some):
        return rows.select(ROW, "text").limit(0)
    return rows.select(ROW, "text").mapInArrow(released(_only(np.sort(some))), "__row long, text string")


def _labelled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(c, p): each class with its component."""
    return nodes.join(parts.select(F.col("node").alias("c"), "component"), "c", "left").select("c", F.coalesce("component", "c").alias("p"))


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, threshold: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes with alike signatures, and those of them whose full shingle sets are similar enough."""
    sig = classes.select("c", "sig")
    both = pairs.join(sig.select(F.col("c").alias("a"), F.col("sig").alias("x")), "a")
    both = both.join(sig.select(F.col("c").alias("b"), F.col("sig").alias("y")), "b")
    near = fitted(saved(both.select("a", "b", "x", "y").mapInArrow(released(_alike), "a long, b long")))
    text = _texts_of(rows, near.select(F.col("a").alias(ROW)).union(near.select(F.col("b").alias(ROW))))
    both = near.join(text.select(F.col(ROW).alias("b"), F.col("text").alias("y")), "b")
    both = both.join(text.select(F.col(ROW).alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
    return near, fitted(saved(both.mapInArrow(released(_confirm(size, *threshold)), "a long, b long")))


def near_groups(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Groups of ``docs(doc_id, text)`` linked by a shingle similarity of at least ``threshold`` (a, b: a/b).

    Words are runs without white space, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; null and empty texts have none and are linked with nothing; equal rows are linked like
    other copies; an empty table gives no rows; a null doc_id is never the smallest; other columns are
    ignored.  Returns __row (a row key), doc_id, n_shingles, component_id (smallest doc_id reachable by
    links), leader (true for one row of each group, the one with the smallest doc_id).
    """
    rows = keyed(need(docs, "doc_id", "text"))
    signed = saved(rows.select(ROW, "doc_id", "text").mapInArrow(released(_sign(shingle)), _SIGNED))
    full = signed.where("n > 0")
    classes = saved(full.groupBy("h1", "h2").agg(F.min(ROW).alias("c"), F.first("sig").alias("sig"), F.min("doc_id").alias("low")))
    bands = classes.select("c", "sig").mapInArrow(released(_bands), "band long, c long")
    shared = bands.groupBy("band").agg(F.min("c").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "a")
    bands = saved(bands.join(shared, "band"))
    pairs = bands.where("c > a").select("a", F.col("c").alias("b")).distinct()
    alike, edges = _verified(rows, classes, pairs, shingle, threshold)
    parts = components(edges)
    # A family holds the components whose signatures are alike; buckets show which families are.
    families = _labelled(classes.select("c"), components(alike))
    placed = _asking(bands.select("band", "c").join(families, "c"), "band", "p")
    open_ = placed.where("asks").select("band").distinct()
    short = fitted(saved(classes.select("c", "sig").mapInArrow(released(_low_bytes), "c long, sig binary")))
    placed = placed.join(open_, "band").join(short, "c")
    joined = fitted(saved(_in_blocks(placed, "band", "c").select("k", "p", "sig", "role").mapInArrow(released(_alike_parts), "a long, b long")))
    if not joined.isEmpty():
        families = _labelled(classes.select("c"), components(alike.union(joined)))
    # The classes of a family are compared across its components on their full sets.
    home = _labelled(classes.select("c"), parts).join(families.withColumnRenamed("p", "f"), "c")
    home = _asking(home, "f", "p")
    home = fitted(saved(home.join(home.where("asks").select("f").distinct(), "f")))
    text = _texts_of(rows, home.select(F.col("c").alias(ROW)))
    met = _in_blocks(home.join(text.withColumnRenamed(ROW, "c"), "c"), "f", "c").select("k", "p", "c", "role", "text")
    found = fitted(saved(met.mapInArrow(released(_linked(shingle, *threshold)), "a long, b long")))
    if not found.isEmpty():
        parts = components(edges.union(found))
    group = classes.join(parts.select(F.col("node").alias("c"), "component"), "c", "left").select("h1", "h2", "low", F.coalesce("component", "c").alias("p"))
    low = group.groupBy("p").agg(F.min("low").alias("component_id"))
    label = group.join(low, "p").select("h1", "h2", "p", "component_id")
    out = signed.select(ROW, "doc_id", "n", "h1", "h2").join(label, ["h1", "h2"], "left")
    first = out.where("n > 0 and p is not null").groupBy("p").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col(ROW).alias("r"))).alias("f"))
    out = out.join(first.select("p", F.col("f.r").alias("__first")), "p", "left")
    alone = F.col("n") == 0
    return out.select(
        ROW,
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col(ROW) == F.col("__first"))).alias("leader"),
    )


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group kept, the one with the smallest doc_id; all columns stay."""
    docs = stable(docs)
    gone = near_groups(docs, shingle, threshold).where("not leader").select(ROW)
    return boxed(docs).join(gone, ROW, "left_anti").select("__doc.*")
