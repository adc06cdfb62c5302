"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its vocabulary embedding and the mean embedding of its character trigrams; a forward and
a backward gated recurrent layer read each window of words, attention pools their states, and a document's
logit is the largest of its overlapping windows, which cover the whole text.  The network is fitted on a
bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_CLEAN``), its scores are calibrated on the
same rows weighted back to their share of all labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import bounded_batches, need, released

MOST_TOXIC = 700
MOST_CLEAN = 1400
WINDOW = 48
STRIDE = 36
VOCABULARY = 20_000
TRIGRAMS = 4096
WORD_DIM, CHAR_DIM, STATE = 12, 8, 8
ROUNDS = 6
PIECE = 1 << 18
WORDS = A.byte_class("alnum")


class Words:
    """Tokens of some documents: distinct words with their inputs, and each token's distinct word."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        data = A.fold(data)
        starts, ends, self.bounds = A.words(data, off, WORDS)
        hashes = [np.zeros(0, np.uint64)]
        for lo, hi, part, _ in A.pieces(data, off, PIECE):
            w = slice(self.bounds[lo], self.bounds[hi])
            hashes.append(A.word_hash(part, starts[w] - off[lo], ends[w] - off[lo]))
        self.hash, first, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        self.token = inverse.reshape(-1)
        s, e = starts[first], ends[first]
        n = e - s
        at = A.ranges(s, n)
        left = np.where(at == np.repeat(s, n), 0, data[np.maximum(at - 1, 0)]).astype(np.uint64)
        right = np.where(at == np.repeat(e, n) - 1, 0, data[np.minimum(at + 1, len(data) - 1)] if len(data) else 0).astype(np.uint64)
        code = (left * np.uint64(65537) + data[at].astype(np.uint64) * np.uint64(257) + right) if len(at) else np.zeros(0, np.uint64)
        self.trigram = (A.mix(code + np.uint64(77)) % np.uint64(TRIGRAMS)).astype(np.int64)
        self.trigram_at, self.size = np.r_[0, np.cumsum(n)], n

    def lookup(self, vocabulary: np.ndarray) -> np.ndarray:
        """1-based vocabulary numbers of the distinct words, 0 for others."""
        at = np.minimum(np.searchsorted(vocabulary, self.hash), len(vocabulary) - 1)
        return np.where(vocabulary[at] == self.hash, at + 1, 0) if len(vocabulary) else np.zeros(len(self.hash), np.int64)

    def chars(self, table: np.ndarray) -> np.ndarray:
        """Mean trigram embedding of each distinct word."""
        if not len(self.hash):
            return np.zeros((0, table.shape[1]), np.float32)
        return np.add.reduceat(table[self.trigram], self.trigram_at[:-1], axis=0) / self.size[:, None].astype(np.float32)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token, length and document of overlapping windows over every token; a document has one at least."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = A.ranges(np.zeros(len(n), np.int64), count)
    start = np.minimum(k * STRIDE, np.maximum(n[doc] - WINDOW, 0))
    return bounds[:-1][doc] + start, np.minimum(n[doc], WINDOW), doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_gru(x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of one direction; x (steps, n, 3 states) holds the inputs' part of the gates."""
    steps, n, k = len(x), x.shape[1], u.shape[0]
    h, out, cache = np.zeros((n, k), x.dtype), np.empty((steps, n, k), x.dtype), []
    for t in range(steps):
        hu = h @ u
        zr = _sigmoid(x[t, :, : 2 * k] + hu[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = np.tanh(x[t, :, 2 * k :] + r * hu[:, 2 * k :])
        new = c + z * (h - c)
        m = mask[t][:, None]
        if keep:
            cache.append((h, z, r, c, hu[:, 2 * k :], m))
        h = h + m * (new - h)
        out[t] = h
    return out, cache


def back_gru(cache: list, u: np.ndarray, d_out: np.ndarray):
    """Gradients of the inputs' part of the gates and of ``u``."""
    k = u.shape[0]
    du, dx = np.zeros_like(u), np.zeros((len(cache), d_out.shape[1], 3 * k), u.dtype)
    dh = np.zeros_like(d_out[0])
    for t in range(len(cache) - 1, -1, -1):
        h, z, r, c, hc, m = cache[t]
        dh = dh + d_out[t]
        dn = dh * m
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        dhu = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ dhu
        dh = dh * (1 - m) + dn * z + dhu @ u.T
    return dx, du


class Network:
    """Parameters, window logits and gradients."""

    def __init__(self, vocabulary: np.ndarray, prior: np.ndarray, seed: int = 7):
        g = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (g.standard_normal(s) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": f(len(vocabulary) + 1, WORD_DIM),
            "char": f(TRIGRAMS, CHAR_DIM),
            "w": f(WORD_DIM + CHAR_DIM, 6 * STATE, scale=0.3),
            "b": np.zeros(6 * STATE, np.float32),
            "uf": f(STATE, 3 * STATE, scale=0.3),
            "ub": f(STATE, 3 * STATE, scale=0.3),
            "att": f(2 * STATE, scale=0.5),
            "out": f(2 * STATE, scale=0.5),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][:, 0] = prior
        self.scale = np.array([1.0, 0.0])

    def inputs(self, words: Words) -> np.ndarray:
        """Inputs of the distinct words; one more row of zeros stands for no word."""
        x = np.concatenate([self.p["word"][words.lookup(self.vocabulary)], words.chars(self.p["char"])], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]).astype(np.float32)

    def grid(self, words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct-word numbers (steps, windows) and their mask."""
        step = np.arange(WINDOW)[:, None]
        mask = step < size[None, :]
        if not len(words.token):
            return np.full(mask.shape, len(words.hash)), mask.astype(np.float32)
        at = np.minimum(start[None, :] + step, len(words.token) - 1)
        return np.where(mask, words.token[at], len(words.hash)), mask.astype(np.float32)

    def logits(self, words: Words, start: np.ndarray, size: np.ndarray, block: int = 2048) -> np.ndarray:
        gates = self.inputs(words) @ self.p["w"] + self.p["b"]
        out = np.empty(len(start), np.float32)
        k = 3 * STATE
        for a in range(0, len(start), block):
            ids, mask = self.grid(words, start[a : a + block], size[a : a + block])
            f, _ = run_gru(gates[:, :k][ids], mask, self.p["uf"])
            b, _ = run_gru(gates[:, k:][ids[::-1]], mask[::-1], self.p["ub"])
            out[a : a + block] = self.pool(f, b[::-1], mask)[0]
        return out

    def pool(self, f: np.ndarray, b: np.ndarray, mask: np.ndarray):
        half = STATE
        score = f @ self.p["att"][:half] + b @ self.p["att"][half:]
        score = np.where(mask > 0, score, -1e4)
        e = np.exp(score - score.max(axis=0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        value = f @ self.p["out"][:half] + b @ self.p["out"][half:]
        return (weight * value).sum(axis=0) + self.p["bias"][0], weight, value

    def gradients(self, words: Words, start: np.ndarray, size: np.ndarray, target: np.ndarray, loss_weight: np.ndarray):
        """Loss and gradients of weighted cross entropy over windows."""
        p, k, half = self.p, 3 * STATE, STATE
        number = words.lookup(self.vocabulary)
        ids, mask = self.grid(words, start, size)
        x = self.inputs(words)
        gates = x @ p["w"] + p["b"]
        f, cf = run_gru(gates[:, :k][ids], mask, p["uf"], True)
        b, cb = run_gru(gates[:, k:][ids[::-1]], mask[::-1], p["ub"], True)
        b = b[::-1]
        logit, weight, value = self.pool(f, b, mask)
        q = _sigmoid(logit)
        total = loss_weight.sum()
        loss = -(loss_weight * (target * np.log(q + 1e-9) + (1 - target) * np.log(1 - q + 1e-9))).sum() / total
        d = (loss_weight * (q - target) / total).astype(x.dtype)
        g = {"bias": np.array([d.sum()], x.dtype)}
        dv = weight * d
        ds = weight * (value - (weight * value).sum(axis=0)) * d
        g["out"] = np.concatenate([(f * dv[..., None]).sum((0, 1)), (b * dv[..., None]).sum((0, 1))])
        g["att"] = np.concatenate([(f * ds[..., None]).sum((0, 1)), (b * ds[..., None]).sum((0, 1))])
        df = dv[..., None] * p["out"][:half] + ds[..., None] * p["att"][:half]
        db = dv[..., None] * p["out"][half:] + ds[..., None] * p["att"][half:]
        dxf, g["uf"] = back_gru(cf, p["uf"], df)
        dxb, g["ub"] = back_gru(cb, p["ub"], db[::-1])
        dg = np.zeros_like(gates)
        both = np.concatenate([dxf, dxb[::-1]], axis=2)
        np.add.at(dg, ids.reshape(-1), both.reshape(-1, 2 * k))
        g["w"], g["b"] = x.T @ dg, dg.sum(axis=0)
        dx = (dg @ p["w"].T)[:-1]
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], number, dx[:, :WORD_DIM])
        g["char"] = np.zeros_like(p["char"])
        share = dx[:, WORD_DIM:] / np.maximum(words.size, 1)[:, None]
        np.add.at(g["char"], words.trigram, np.repeat(share, words.size, axis=0))
        return loss, g

    def document_logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        words = Words(data, off)
        start, size, doc = windows(words.bounds)
        out = np.full(len(off) - 1, -np.inf)
        np.maximum.at(out, doc, self.logits(words, start, size))
        return out

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale[0] * self.document_logits(data, off) + self.scale[1])


def fit(texts: list[str | None], toxic: np.ndarray, row_weight: np.ndarray, seed: int = 7) -> Network:
    """A network for labelled texts; ``row_weight`` is how many labelled rows each of them stands for."""
    data, off = A.strings(texts)
    words = Words(data, off)
    toxic = np.asarray(toxic, np.float64)
    docs = A.row_of(words.bounds)
    pair = np.unique(docs * (len(words.hash) + 1) + words.token)
    word, doc = pair % (len(words.hash) + 1), pair // (len(words.hash) + 1)
    df = np.bincount(word, minlength=len(words.hash))
    bad = np.bincount(word, toxic[doc], minlength=len(words.hash))
    order = np.argsort(-df, kind="stable")[:VOCABULARY]
    order = np.sort(order[df[order] >= 3])
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((df - bad + 0.5) / (n0 + 1))
    prior = np.r_[0, np.clip(odds[order], -1, 4) * np.minimum(1, df[order] / 10)]
    net = Network(words.hash[order], prior.astype(np.float32), seed)
    if not len(toxic) or not n1 or not n0:
        share = (n1 + 0.5) / (len(toxic) + 1)
        net.scale = np.array([0.0, np.log(share / (1 - share))])
        return net
    start, size, doc = windows(words.bounds)
    # first choice of a document's window: where the words speak most for the label
    evidence = np.r_[0, np.cumsum(np.maximum(net.p["word"][words.lookup(net.vocabulary), 0], 0)[words.token])]
    view = evidence[start + size] - evidence[start]
    rng, step = np.random.default_rng(seed), 0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    for turn in range(ROUNDS):
        if turn > 1:
            view = net.logits(words, start, size)
        best = np.lexsort((view, doc))
        best = best[np.r_[doc[best][1:] != doc[best][:-1], True]]
        extra = rng.permutation(np.flatnonzero(toxic[doc] == 0))[: len(best) // 2]
        chosen = rng.permutation(np.r_[best, extra])
        for a in range(0, len(chosen), 128):
            w = chosen[a : a + 128]
            tokens = np.unique(words.token[np.minimum(A.ranges(start[w], size[w]), len(words.token) - 1)]) if len(words.token) else np.zeros(0, np.int64)
            part = _subset(words, tokens)
            loss, g = net.gradients(part, start[w], size[w], toxic[doc[w]], np.ones(len(w)))
            step += 1
            rate = 0.02 * 0.7**turn
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.01 * (d * d - v2[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    logit = net.document_logits(data, off)
    net.scale = _calibrate(logit, toxic, row_weight)
    return net


def _subset(words: Words, keep: np.ndarray) -> Words:
    """The same tokens with only the kept distinct words described."""
    part = Words.__new__(Words)
    number = np.full(len(words.hash) + 1, len(keep))
    number[keep] = np.arange(len(keep))
    part.hash, part.token, part.bounds, part.size = words.hash[keep], number[words.token], words.bounds, words.size[keep]
    part.trigram = words.trigram[A.ranges(words.trigram_at[keep], part.size)]
    part.trigram_at = np.r_[0, np.cumsum(part.size)]
    return part


def _calibrate(logit: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic fit of label on logit, with a little ridge."""
    x = np.stack([np.clip(logit, -20, 20), np.ones(len(y))], axis=1)
    t = np.array([1.0, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ t)
        g = x.T @ (w * (q - y)) + 1e-2 * (t - [1.0, 0.0])
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        t = t - np.clip(np.linalg.solve(h, g), -2, 2)
    return t


def train(docs: DataFrame, labels: DataFrame, usable=None) -> Network:
    """Fits on at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled rows of ``docs``, picked by a hash of the id.

    ``labels(doc_id, toxic)``; a document with several labels has the largest, null labels count as none.
    """
    known = need(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if usable is not None:
        known = known.where(usable)
    totals = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") > 0).count().collect()}
    picked = [
        known.where((F.col("toxic") > 0) == F.lit(flag)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for flag, most in ((True, MOST_TOXIC), (False, MOST_CLEAN))
    ]
    sample = picked[0].unionByName(picked[1])
    rows = need(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    got = sorted(rows.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] > 0 for r in got], bool)
    counts = {f: max(1, int((y == f).sum())) for f in (True, False)}
    weight = np.array([totals.get(bool(t), 0) / counts[bool(t)] for t in y])
    net = fit([r["text"] for r in got], y, weight)
    del got, rows
    A.release()
    return net


def _score(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.text_bytes(batch.column(1))
            got = [net.scores(part, cut) for _, _, part, cut in A.pieces(data, off, PIECE)]
            score = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], pa.array(score, pa.float64())], names=["key", "score"])

    return run


def score_documents(docs: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """(key, score) for every row of ``docs(key, text)``, whole texts.

    Null and empty texts get the score of a text without words; repeated rows are scored each; very long
    texts are all covered by windows; other columns are ignored; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[key]
    return bounded_batches(docs).select(F.col(key).alias("key"), "text").mapInArrow(released(_score(net)), f"key {kind}, score double").withColumnRenamed("key", key)


def keep_civil(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; all columns stay."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.text_bytes(batch.column(names.index("text")))
            got = [net.scores(part, cut) for _, _, part, cut in A.pieces(data, off, PIECE)]
            yield batch.filter(pa.array(np.concatenate(got) < threshold if got else np.zeros(0, bool)))

    return bounded_batches(docs).mapInArrow(released(run), docs.schema)
