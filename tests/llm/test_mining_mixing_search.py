"""Hard negatives, source mixing and ranked search against brute force, with nulls, ties, repeats and clashing columns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import hard_negatives as HN
from corpusloom.llm import mixing as MX
from corpusloom.llm import ranked_search as RS

# ---- hard negatives ---------------------------------------------------------------------------------------------

VEC = "vec_id long, label int, embedding array<double>, anchors long, kind string"


def mined(rows, anchor, positives=5, negatives=3, scale=256):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2])]
    ok = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v, *_ in ok]
    dot = lambda a, b: max(-HN.LONG, min(HN.LONG, sum(x * y for x, y in zip(a, b))))
    out = []
    for n, (i, lab, v) in enumerate(ok):
        if not anchor(i):
            continue
        scored = [(-dot(v, w), j, m == lab) for k, (j, m, w) in enumerate(ok) if k != n and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2])[:positives]:
            inside = sorted(s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)
            out += [(i, pid, r + 1, s[1], -p, -s[0]) for r, s in enumerate(inside[:negatives])]
    return sorted(out)


def run_mining(spark, rows, anchor_sql="vec_id % 3 = 0", **k):
    df = spark.createDataFrame(rows, VEC)
    return sorted(tuple(r) for r in HN.mine_hard_negatives(df, F.expr(anchor_sql), **k).collect())


def test_mining_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(HN, "ROWS_IN_BLOCK", 16)
    monkeypatch.setattr(HN, "ANCHORS_IN_BLOCK", 8)
    monkeypatch.setattr(HN, "ANCHOR_TILE", 3)
    monkeypatch.setattr(HN, "BLOCKS_IN_SLICE", 2)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = [(i, i % 4, [float(x) for x in centre[i % 4] + rng.normal(size=6)], 0, "x") for i in range(150)]
    rows += [(200 + i, i % 2, list(rows[7][2]), 0, "x") for i in range(9)]  # copies: ties in both roles
    rows += [(300, 1, [0.0] * 6, 0, "x"), (303, 2, [-0.5] * 6, 0, "x"), (306, None, [1.0] * 6, 0, "x"), (309, 1, None, 0, "x"), (None, 1, [1.0] * 6, 0, "x")]
    rows += [(312, 1, [math.nan] + [1.0] * 5, 0, "x"), (315, 1, [math.inf] + [1.0] * 5, 0, "x"), (318, 1, [None] + [1.0] * 5, 0, "x"), (321, 1, [], 0, "x")]
    rows += [(330 + i, i % 2, [float(i), 2.0, 1.0], 0, "x") for i in range(8)]  # another length
    rows += [rows[3], rows[3], rows[6]]  # repeated rows
    got = run_mining(spark, rows)
    assert got == mined(rows, lambda i: i % 3 == 0) and len(got) > 100


def test_mining_of_huge_and_empty(spark):
    assert run_mining(spark, []) == []
    rows = [(i, i % 2, [1e9 * (1 + i % 5), -1e9, float(i)], 0, "x") for i in range(20)]
    assert run_mining(spark, rows) == mined(rows, lambda i: i % 3 == 0)
    rows = [(i, i % 2, [1e150 * (1 + i % 5), float(i)], 0, "x") for i in range(12)]
    assert run_mining(spark, rows) == mined(rows, lambda i: i % 3 == 0)


def test_score_bounds_hold():
    rng = np.random.default_rng(2)
    x = np.floor(256 * np.r_[rng.normal(size=(200, 5)), rng.normal(size=(1, 5)).repeat(3, 0), np.zeros((1, 5))])
    space = HN.Space(5, float(np.abs(x).max()), 256, HN.place_directions(x, 4))
    n = HN.norms_of(x)
    cells = {"ids": np.arange(len(x)), "labels": np.zeros(len(x), np.int64), "norms": n, "angles": HN.angles_of(x, n, space.directions).astype(np.float32), "x": x.astype(space.kind)}
    b = HN.Block(space, {c: v.tobytes() for c, v in cells.items()})
    low, high = HN.score_bounds(b, slice(0, len(x)), b)
    exact = x @ x.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * np.abs(exact).max()


# ---- mixing -----------------------------------------------------------------------------------------------------

DOC = "doc_id long, text string, source string, q double, size string, rest long, slice int, before int"


def mixed(rows, quality):
    import hashlib

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by, best = defaultdict(list), {}
    for r in rows:
        best[r[0]] = max([q for q in (best.get(r[0]), quality(r)) if q is not None], default=None)
    for r in rows:
        u = (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        w = 1.0 if r[0] is None or best[r[0]] is None else best[r[0]]
        by[r[2]].append((-math.log(u) / w if w > 0 else math.inf, (r[0] is not None, r[0] or 0), size(r[1]), r[0]))
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(d[2] for d in by[s]) for s in names}
    target, goal, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        rate = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= rate * weight[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    out = []
    for s in names:
        budget = min(math.floor(target[s] + 0.5), 2 * total[s])
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        for _, _, n, i in sorted(by[s]):
            part = max(0, min(n, rest))
            rest -= part
            out.append((i, s, n, total[s], round(target[s], 6), epochs * n + part))
    return sorted(out, key=repr)


def test_mixing_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    sources = ["b", "a", "é", "Z", None, "hot", "\U0001F600", "ﬁ"]
    rows = []
    for i in range(400):
        s = "hot" if i % 3 == 0 else sources[int(rng.integers(len(sources)))]
        rows.append((i, " \t".join("word" for _ in range(int(rng.integers(0, 30)))), s, [None, 2.0, 0.0, -1.0, 0.5][i % 5], "x", 1, 1, 1))
    rows += [(None, "a b c", "a", None, "x", 1, 1, 1)] * 3 + [(7, None, "a", 1.0, "x", 1, 1, 1), (8, "", "b", 1.0, "x", 1, 1, 1), rows[1], rows[1]]
    rows += [(9000, "w " * 50000, "long", 1.0, "x", 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOC)
    for slices in (10_000, 7):
        got = MX.mix_sources(docs, quality=docs.select("doc_id", F.col("q").alias("weight")), slice_docs=slices).collect()
        have = sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in got), key=repr)
        assert have == mixed(rows, lambda r: r[3])
        assert all(r.taken <= 2 * r.size for r in got)
    assert MX.mix_sources(docs.limit(0)).collect() == []
    assert [r.taken for r in MX.mix_sources(docs.where("size is null or text is null")).collect()] == [0]


def test_better_documents_are_sampled_more(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), (F.col("id") % 2).alias("good"))
    got = MX.mix_sources(docs, quality=docs.select("doc_id", F.when(F.col("good") == 1, 4.0).otherwise(1.0).alias("weight")), share=0.5, slice_docs=100)
    n = {r[0]: r[1] for r in got.where("taken > 0").groupBy((F.col("doc_id") % 2).alias("g")).count().collect()}
    assert n[0] + n[1] == 2000 and n[1] > 1.8 * n[0]


# ---- ranked search ----------------------------------------------------------------------------------------------


def searched(docs, items, k=10):
    term = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(term(t))) for i, t in docs if term(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in term(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_search_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(RS, "ITEM_TILE", 3)
    monkeypatch.setattr(RS, "DOC_TILE", 7)
    monkeypatch.setattr(RS, "TERM_TILE", 5)
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta2", "GAMMA", "naïve", "日本", "x", "É", "zeta", "7", "rare"]
    docs = [(i, " ".join(rng.choice(words[:9], int(rng.integers(0, 25))))) for i in range(60)]
    docs += [(None, "rare alpha"), (70, None), (71, ""), (72, "-- !!"), docs[3], docs[3], (80, "alpha " * 30000 + "rare"), (-5, "zeta zeta")]
    items = [("a", "alpha Beta2 alpha"), ("b", "rare, rare; rare"), ("c", None), ("d", ""), ("e", "unseen"), ("f", "é 日本 NAÏVE zeta 7"), ("a", "gamma"), ("g", "x-x_x " * 40)]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, n int, terms string")
    q = spark.createDataFrame([(*r, 5) for r in items], "item_id string, text string, item int")
    got = sorted((tuple(r) for r in RS.rank_documents(d, q, block_bytes=block).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == searched(docs, items)


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for x, y in ((d.limit(0), q), (d, q.limit(0)), (d.withColumn("text", F.lit(None).cast("string")), q)):
        got = RS.rank_documents(x, y)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_products_stay_exact_beyond_doubles():
    """Weights too large for one exact sum are cut over several columns and tiles."""
    tile = RS.ItemTile(0, [{0: 30_000_000_001, 1: 7}, {1: 9_007_199_253}], largest=RS.EXACT // RS.IMPACT)
    doc, term, impact = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([999_999, 999_983, 3])
    want = [[30_000_000_001 * 999_999 + 7 * 999_983, 21], [9_007_199_253 * 999_983, 9_007_199_253 * 3]]
    assert tile.scores(doc, term, impact, 2).tolist() == want
