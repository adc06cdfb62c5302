"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of lower-cased words, each word closed by a blank and each text by an end symbol, so a
context runs across words.  Contexts of up to ``DEPTH`` symbols are counted over the whole training part by
Spark.  A context stays in the tree if its next-symbol distribution diverges from its suffix's: the
likelihood it gains over the suffix, judged with one occurrence held out, must pay for itself.  A retained
context's distribution is smoothed by absolute discounting towards its suffix; scoring takes the longest
retained suffix of what was read.  Words are symbols of the root as wholes, too: a token's probability mixes
that with its spelled one.  The unigram base over whole words is scored along, from exact counts.

The tree is a Spark table per context length and grows with the corpus.  Documents are scored in shards of bounded
size; the distinct grams and words of a shard are looked up by joins and meet its documents in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import arrays as A
from corpusloom.llm.tables import ROW, keyed, need, saved

DEPTH = 5
#: Weight of the root's whole-word symbols beside the spelled ones.
WHOLE = 0.15
DISCOUNT = 0.75
#: Log-likelihood that a context must gain over its suffix.
GAIN = 4.0
#: Grams seen less often are left to their suffixes, at any size of the corpus.
LEAST = 2
#: Bytes of text that are scored together against their own part of the tree.
SHARD_BYTES = 32 << 20
HOLD = 1_000_000
BLANK, END = 32, 10
WORDS = A.byte_class("space")
END_WORD = int(A.word_hash(np.array([END], np.uint8), np.array([0]), np.array([1])).view(np.int64)[0])
_LN10 = float(np.log(10))


class Symbols(NamedTuple):
    grams: np.ndarray  # the last DEPTH symbols and the symbol itself, for every symbol
    gram_at: np.ndarray  # bounds by document
    words: np.ndarray  # word hashes
    word_at: np.ndarray
    token_at: np.ndarray  # first symbol of each token: a document's words and then its end


def symbols(data: np.ndarray, off: np.ndarray) -> Symbols:
    """Grams and word hashes of documents; before a text stand DEPTH end symbols."""
    data = A.fold(data)
    s, e, bounds = A.words(data, off, WORDS)
    n, docs = e - s, len(off) - 1
    before = np.r_[0, np.cumsum(n + 1)]
    # a document's symbols start DEPTH after its pads; keys of pads are left out
    first = before[bounds[:-1]] + np.arange(docs) * (DEPTH + 1)
    size = before[bounds[1:]] - before[bounds[:-1]] + 1
    whole = int(before[-1]) + docs * (DEPTH + 1)
    blanks = before[:-1] + A.row_of(bounds) * (DEPTH + 1) + DEPTH + n
    out, letter = np.full(whole + 8, END, np.uint8), np.ones(whole, bool)
    letter[blanks] = letter[first + size - 1 + DEPTH] = letter[np.add.outer(first, np.arange(DEPTH))] = False
    out[:whole][letter] = data[WORDS[data]]
    out[blanks] = BLANK
    m = max(0, whole - DEPTH)
    # eight bytes at every place, of which the first DEPTH + 1 are the key
    key = np.ndarray(m, ">u8", out, strides=(1,)).astype(np.uint64) >> np.uint64(8 * (7 - DEPTH))
    own = np.ones(m, bool)
    own[np.add.outer((first + size)[:-1], np.arange(DEPTH))] = False
    return Symbols(key[own], np.r_[0, np.cumsum(size)], A.word_hash(data, s, e), bounds, np.r_[0, np.cumsum(np.insert(n + 1, bounds[1:], 1))[:-1]])


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in ascending order, by sorting."""
    k = np.sort(keys)
    return k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k


def _found(table: tuple[np.ndarray, np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Values of grams that the table has: 2**16 are sorted at a time, with their places in the bits that a gram leaves free."""
    out = np.empty(len(grams))
    for a in range(0, len(grams), 1 << 16):
        part = grams[a : a + (1 << 16)]
        part = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
        place, key = (part & np.uint64(0xFFFF)).astype(np.int64), part >> np.uint64(16)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        value = table[1][np.searchsorted(table[0], key[first].view(np.int64))]
        out[a + place] = np.repeat(value, np.diff(np.r_[first, len(key)]))
    return out


class _Counter:
    """Counts of keys, merged now and then."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size > HOLD and len(self.keys) > 1:
            self.merge()

    def merge(self) -> None:
        if self.keys:
            k = np.concatenate(self.keys)
            order = np.argsort(k)
            k, n = k[order], np.concatenate(self.counts)[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            self.keys, self.counts = [k[first]], [np.add.reduceat(n, first) if len(first) else n]
            self.size = len(first)

    def take(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for k, n in zip(self.keys, self.counts):
            for a in range(0, len(k), 100_000):
                part = k[a : a + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(n[a : a + 100_000].astype(np.int64))], names=["kind", "key", "n"]
                )
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word, gram, docs = _Counter(), _Counter(), 0
    for batch in batches:
        data, off = A.text_bytes(batch.column(0))
        docs += batch.num_rows
        for _, _, part, cut in A.pieces(data, off):
            x = symbols(part, cut)
            word.add(x.words)
            gram.add(x.grams)
            for kind, c in ((0, word), (1, gram)):
                if c.size > 2 * HOLD:
                    yield from c.take(kind)
    yield from word.take(0)
    yield from gram.take(1)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([END_WORD]), pa.array([docs], pa.int64())], names=["kind", "key", "n"])


def _fitted(length: int):
    """Smoothed distribution of each context of this length, and whether it stays in the tree.

    Takes (context, total, grams of symbol, count and suffix's log probability); ``logs`` are the grams' own log
    probabilities where the context stays and their suffix's elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, grams = batch.column(1).to_numpy().astype(float), batch.column(2)
            at = A.row_of(np.r_[0, np.cumsum(grams.value_lengths().to_numpy())].astype(np.int64))
            symbol, n, below = (grams.flatten().field(i).to_numpy() for i in range(3))
            n, suffix, size = n.astype(float), np.exp(below.astype(float)), len(total)
            all_n = total[at]
            left = 1 - np.bincount(at, n - DISCOUNT, size) / np.maximum(total, 1)
            p = (n - DISCOUNT) / all_n + left[at] * suffix
            # likelihood over the suffix with one occurrence held out; grams that were left out count with the suffix's weight
            held = np.maximum(n - 1 - DISCOUNT, 0) / np.maximum(all_n - 1, 1) + left[at] * suffix
            gain = np.bincount(at, n * np.log(held / suffix), size)
            gain = gain + (total - np.bincount(at, n, size)) * np.log(np.maximum(left, 1e-12))
            stays = gain > GAIN if length else np.ones(size, bool)
            logs = np.where(stays[at], np.log(p), below).astype(np.float32)
            bounds = pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=size))], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(stays),
                    pa.array(np.log(np.maximum(left, 1e-12)).astype(np.float32)),
                    pa.ListArray.from_arrays(bounds, pa.array(symbol, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(logs)),
                ],
                names=["context", "stays", "weight", "symbols", "logs"],
            )

    return run


def _cut(length: int):
    """A gram's last ``length`` symbols."""
    return F.col("key").bitwiseAND(F.lit((1 << (8 * length)) - 1).cast("long"))


class Tree(NamedTuple):
    """A table of contexts for each length: context, stays, log weight of the suffix, symbols and their log probabilities."""

    levels: list[DataFrame]

    def spelled(self, keys: DataFrame) -> DataFrame:
        """(key, v): natural log of the last symbol's probability after the longest retained suffix of the others."""
        asked, met = keys.select("key").distinct(), []
        for length in range(DEPTH, -1, -1):
            kept = self.levels[length].where("stays").select("context", "weight", "symbols", "logs")
            found = asked.withColumn("context", F.shiftright("key", 8)).join(kept, "context", "left")
            place = F.array_position("symbols", F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int")).cast("int")
            found = found.select("key", F.get("logs", place - 1).cast("double").alias("v"), F.coalesce("weight", F.lit(0)).cast("double").alias("weight"))
            met.append(saved(found))
            asked = met[-1].where("v is null").select(_cut(length).alias("key")).distinct()
        out = met[-1].select("key", F.coalesce("v", F.col("weight") - F.lit(float(np.log(256)))).alias("v"))
        for length in range(1, DEPTH + 1):
            here = met[DEPTH - length]
            shorter = out.select(F.col("key").alias("suffix"), F.col("v").alias("below"))
            rest = here.where("v is null").select("key", "weight", _cut(length).alias("suffix")).join(shorter, "suffix")
            out = here.where("v is not null").select("key", "v").unionByName(rest.select("key", (F.col("weight") + F.col("below")).alias("v")))
        return out

    def log_probability(self, key: np.ndarray) -> np.ndarray:
        """``spelled`` of a few keys."""
        spark = self.levels[0].sparkSession
        got = {r[0]: r[1] for r in self.spelled(spark.createDataFrame([(int(k),) for k in key], "key long")).collect()}
        return np.array([got[int(k)] for k in key])


def grow(level: DataFrame) -> Tree:
    """Tree from the counts (key, n) of the longest grams, all occurrences of them."""
    levels = [level]
    for length in range(DEPTH - 1, -1, -1):
        levels.insert(0, saved(levels[0].groupBy(_cut(length + 1).alias("key")).agg(F.sum("n").alias("n"))))
    tree, below = [], None
    for length, grams in enumerate(levels):
        grams = grams.select("key", "n", F.shiftright("key", 8).alias("context"))
        if length:
            often = grams.where(F.col("n") >= LEAST).withColumn("suffix", _cut(length)).join(below, "suffix").drop("suffix")
            grams = often.unionByName(grams.where(F.col("n") < LEAST).withColumn("below", F.lit(None).cast("float")))
        else:
            grams = grams.withColumn("below", F.lit(-float(np.log(256))).cast("float"))
        one = F.struct(F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int").alias("symbol"), "n", "below")
        own = grams.groupBy("context").agg(F.sum("n").alias("total"), F.collect_list(F.when(F.col("below").isNotNull(), one)).alias("grams"))
        fit = own.where(F.size("grams") > 0).mapInArrow(_fitted(length), "context long, stays boolean, weight float, symbols array<int>, logs array<float>")
        tree.append(saved(fit))
        each = tree[-1].select("context", F.explode(F.arrays_zip("symbols", "logs")).alias("g"))
        below = each.select(F.shiftleft("context", 8).bitwiseOR(F.col("g.symbols").cast("long")).alias("suffix"), F.col("g.logs").alias("below"))
    return Tree(tree)


class Model(NamedTuple):
    tree: Tree
    tokens: int
    distinct: int


def learn(docs: DataFrame) -> tuple[Model, DataFrame]:
    """Counts all of ``docs(text)`` and returns the model and the table (key, n) of word counts.

    Null and empty texts add an end token; equal rows count each; an empty table gives a uniform model.
    """
    counts = need(docs, "text").mapInArrow(_count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    words = counts.where("kind = 0").select("key", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    return Model(grow(counts.where("kind = 1").select("key", "n")), int(tokens), int(distinct)), words


def _mixed(share: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 of WHOLE * share + (1 - WHOLE) * 10**spelled, for any small spelled probability."""
    low = np.log10(1 - WHOLE) + spelled
    high = np.log10(np.maximum(WHOLE * share, 1e-300))
    top = np.maximum(low, high)
    return np.where(share > 0, top + np.log10(10 ** (low - top) + 10 ** (high - top)), low)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(shard, consecutive rows of it): a scan task's texts are cut at every ``SHARD_BYTES``, at the same rows in every scan."""
    before = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.diff(A.text_bytes(batch.column(2))[1])
        start = before + np.cumsum(size) - size
        before += int(size.sum())
        shard = (batch.column(0).to_numpy() >> 33 << 33) + start // SHARD_BYTES
        cut = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(shard[a]), batch.slice(a, b - a)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, kind, key): the distinct words (kind 0) and grams (kind 1) of each shard."""
    now, held = None, ([np.array([END_WORD])], [])

    def closed():
        for kind, keys in enumerate(held):
            k = _distinct(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            for a in range(0, len(k), 100_000):
                part = k[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), now, np.int64)), pa.array(np.full(len(part), kind, np.int8)), pa.array(part)], names=["shard", "kind", "key"]
                )

    for shard, part in _dealt(batches):
        if shard != now:
            if now is not None:
                yield from closed()
            now, held = shard, ([np.array([END_WORD])], [])
        for _, _, data, cut in A.pieces(*A.text_bytes(part.column(2))):
            x = symbols(data, cut)
            held[0].append(_distinct(x.words.view(np.int64)))
            held[1].append(_distinct(x.grams.view(np.int64)))
    if now is not None:
        yield from closed()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, kind 2, documents): doc_id and text of consecutive rows of a shard, compressed."""
    for shard, part in _dealt(batches):
        for a, b, _, _ in A.pieces(*A.text_bytes(part.column(2))):
            docs, sink = part.slice(a, b - a).select(["doc_id", "text"]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.array([2], pa.int8()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "kind", "docs"]
            )


def _scored(tokens: int, distinct: int):
    """Scores of each shard's documents, which come after the values of its words and grams."""
    whole = tokens + distinct + 1

    def table(parts):
        key = np.concatenate([p[0] for p in parts])
        order = np.argsort(key)
        return key[order], np.concatenate([p[1] for p in parts])[order]

    def scores(docs: pa.RecordBatch, words, grams) -> pa.RecordBatch:
        x = symbols(*A.text_bytes(docs.column(1)))
        logs = _found(grams, x.grams) / _LN10
        # every document's words and then its end
        token = np.insert(x.words.view(np.int64), x.word_at[1:], END_WORD)
        key, inverse = np.unique(token, return_inverse=True)
        n = words[1][np.searchsorted(words[0], key)][inverse.reshape(-1)]
        first = x.word_at[:-1] + np.arange(docs.num_rows)
        mixed = _mixed(n / max(1, tokens), np.add.reduceat(logs, x.token_at))
        total = lambda v: np.add.reduceat(v, first)
        return pa.RecordBatch.from_arrays(
            [
                docs.column(0),
                pa.array(np.diff(x.word_at) + 1, pa.int64()),
                pa.array(total((n > 0).astype(np.int64)), pa.int64()),
                pa.array(total(np.log10((n + 1) / whole))),
                pa.array(total(mixed)),
            ],
            names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tables = None, ([], []), None
        for batch in batches:
            shard, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.r_[0, np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1, len(shard)]
            for a, b in zip(cut[:-1], cut[1:]):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, tables = shard[a], ([], []), None
                if kind[a] < 2:
                    held[kind[a]].append((batch.column(2).slice(a, b - a).to_numpy().copy(), batch.column(3).slice(a, b - a).to_numpy().copy()))
                    continue
                if tables is None:
                    tables, held = (table(held[0]), table(held[1])), ([], [])
                for packed in batch.column(4).slice(a, b - a):
                    for docs in pa.ipc.open_stream(packed.as_buffer()):
                        yield scores(docs, *tables)

    return run


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text)``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of the whole text; null and empty texts are the end token alone; rows
    are scored one by one, however long; an empty table gives no rows; other columns are ignored.
    """
    rows = keyed(need(docs, "doc_id", "text")).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = saved(rows.mapInArrow(_asked, "shard long, kind byte, key long"))
    grams = asked.where("kind = 1")
    grams = grams.join(model.tree.spelled(grams), "key").select("shard", "kind", "key", "v")
    known = asked.where("kind = 0").join(words, "key", "left").select("shard", "kind", "key", F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    values = grams.unionByName(known).withColumn("docs", F.lit(None).cast("binary"))
    packed = rows.mapInArrow(_packed, "shard long, kind byte, docs binary")
    packed = packed.select("shard", "kind", F.lit(0).cast("long").alias("key"), F.lit(0.0).alias("v"), "docs")
    met = values.unionByName(packed).repartition("shard").sortWithinPartitions("shard", "kind")
    out = met.mapInArrow(_scored(model.tokens, model.distinct), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
