"""Texts come to Python tasks in small batches, whatever their length."""

import numpy as np
import pyarrow as pa

from corpusloom.llm import arrays as A
from corpusloom.llm import lm_score, tables


def test_batches_of_long_texts_are_small(spark):
    docs = spark.range(12, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 80000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in tables.need(docs, "doc_id", "text").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 12 * 400_000 and max(got) < 3 << 20


def test_grams_find_their_values_whatever_their_order():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 48, 5_000))
    values = rng.standard_normal(len(keys))
    pick = rng.integers(0, len(keys), 200_000)
    assert np.array_equal(lm_score._found((keys, values), keys[pick].astype(np.uint64)), values[pick])
    assert not len(lm_score._found((keys, values), np.zeros(0, np.uint64)))


def test_symbols_are_the_bytes_of_words_with_pads_before_each_text():
    data, off = A.strings(["aB  c", None, " ", "é"])
    x = lm_score.symbols(data, off)
    want = []
    for text in ("ab c ", "", "", "é "):
        raw = b"\n" * lm_score.DEPTH + text.encode() + b"\n"
        want.append([int.from_bytes(raw[i : i + lm_score.DEPTH + 1], "big") for i in range(len(raw) - lm_score.DEPTH)])
    assert x.grams.tolist() == sum(want, []) and np.diff(x.gram_at).tolist() == [len(w) for w in want]
    assert lm_score._distinct(x.grams).tolist() == sorted(set(sum(want, [])))
