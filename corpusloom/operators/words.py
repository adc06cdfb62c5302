"""Index words of whole texts counted inside tasks: the tokens of ``T.tokenize`` and ``T.meaningful_tokens``, in a fraction of the time.

``text_marks`` and ``pair_marks`` do the same for the evidence of candidates.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V

#: Rows of one batch that a task gives at once.
ROWS = 500
_FOLDED = dict(zip(T.FOLD_FROM, T.FOLD_TO)) | {a: b.lower().encode("ascii", "ignore").decode() for a, b in T.MULTI_FOLD.items()}
_WORD = b"abcdefghijklmnopqrstuvwxyz0123456789"
_BLANKS = bytes(c if c in _WORD else 32 for c in range(256))
_STOP = frozenset(w.encode() for w in V.COVERAGE_STOP_WORDS)


def tokenize(text: str) -> list[bytes]:
    """``T.tokenize`` of one text."""
    low = text.lower()
    if not low.isascii():
        # a few letters of a text are no ASCII: each is replaced everywhere at once
        for c in _FOLDED.keys() & set(low):
            low = low.replace(c, _FOLDED[c])
    return low.encode("ascii", "ignore").translate(_BLANKS).split()


@lru_cache(1 << 17)
def _stem(t: bytes) -> bytes | None:
    """``T.light_stem`` of a content word, None for other words."""
    n = len(t)
    if n <= 2 or t in _STOP:
        return None
    if n > 5 and t.endswith(b"ies"):
        t = t[:-3] + b"y"
    elif n > 6 and t.endswith(b"ing"):
        t = t[:-3]
    elif n > 5 and t.endswith(b"ed"):
        t = t[:-3] + b"y" if t[-3:-2] == b"i" else t[:-2]
    elif n > 5 and t.endswith(b"es"):
        t = t[:-2]
    elif n > 4 and t.endswith((b"s", b"e")):
        t = t[:-1]
    return t if len(t) > 2 and t not in _STOP else None


def meaningful(text: str | None) -> dict[bytes, None]:
    """``T.meaningful_tokens`` of one text as the keys of a dict; none for null."""
    if text is None:
        return {}
    out = dict.fromkeys(map(_stem, dict.fromkeys(tokenize(text))))
    out.pop(None, None)
    return out


def _lists(rows: Sequence[Iterable], kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = [x for r in rows for x in r]
    values = pa.array(flat, pa.binary()).cast(pa.string()) if kind == pa.string() else pa.array(flat, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``chunk_key, text`` -> ``chunk_key, dl, counts``."""
    for batch in _slices(batches):
        found = [tokenize(t) for t in batch.column(1).to_pylist()]
        rows = [Counter(t) for t in found]
        terms = _lists(rows, pa.string())
        counts = pa.MapArray.from_arrays(terms.offsets, terms.values, pa.array([n for r in rows for n in r.values()], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in found], pa.int64()), counts], names=["chunk_key", "dl", "counts"])


def covered(worth: Callable[[int, int], float]):
    """``chunk_key, title, text`` -> ``chunk_key, terms, parts``: content words, those of the title once more as ``title word``.

    ``worth(in_text, in_title)`` is a word's part.
    """
    only_text, both, only_title = worth(1, 0), worth(1, 1), worth(0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            terms, parts = [], []
            for title, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                head, body = meaningful(title), meaningful(text)
                extra = [w for w in head if w not in body]
                terms.append([*body, *extra, *(b"title " + w for w in head)])
                parts.append([both if w in head else only_text for w in body] + [only_title] * len(extra) + [both if w in body else only_title for w in head])
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(terms, pa.string()), _lists(parts, pa.float64())], names=["chunk_key", "terms", "parts"])

    return run


def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``title, text`` -> ``token``: the content words of a few rows at a time, each once."""
    for batch in _slices(batches):
        words: dict[bytes, None] = {}
        for column in batch.columns:
            for text in column.to_pylist():
                words |= meaningful(text)
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string())], names=["token"])


# ---- evidence of candidates ------------------------------------------------------------------------------

#: Headings of sections that introduce nobody.
CLOSING_HEADINGS = frozenset(["references", "bibliography", "notes", "citations", "external links", "further reading", "marriages", "marriage", "personal life"])
_CITED = re.compile(r"\[[0-9]+\]")
_BULLET = re.compile(r"^[ \t]*(?:[-*+][ \t]+|[0-9]+[.)][ \t]+)", re.M)
_LIST_CUE = re.compile(rf"\b({V.LIST_CUE_PATTERN})\b", re.A)


def normalized(text: str | None) -> str:
    """``T.normalize_text`` of one text."""
    low = (text or "").lower()
    if not low.isascii():
        for c in _FOLDED.keys() & set(low):
            low = low.replace(c, T.MULTI_FOLD[c].lower() if c in T.MULTI_FOLD else _FOLDED[c])
        for c in [c for c in set(low) if unicodedata.category(c) == "Mn"]:
            low = low.replace(c, "")
    return b" ".join(low.encode("ascii", "replace").translate(_BLANKS).split()).decode()


def _padded(phrases: Iterable[str]) -> list[str]:
    return [f" {p} " for p in phrases]


_NOISE, _IDENTITY_NOISE, _DEFINES = _padded(V.REFERENCE_NOISE_TERMS), _padded(V.IDENTITY_NOISE_TERMS), _padded(V.DEFINITION_SIGNALS)
_INTRO, _STRONG, _BIO = _padded(V.INTRO_SIGNALS), _padded(V.STRONG_INTRO_SIGNALS), _padded(V.BIOGRAPHY_SIGNALS)
_RELATION, _RELATION_SECTION, _NEGATIVE = [(f" {p} ", float(w)) for p, w in V.RELATIONSHIP_WEIGHTS.items()], _padded(V.RELATIONSHIP_SECTION_SIGNALS), _padded(V.RELATIONSHIP_NEGATIVE_TERMS)


def _hits(phrases: list[str], pad: str) -> int:
    return sum([p in pad for p in phrases])


def _any(phrases: list[str], pad: str) -> bool:
    return any(p in pad for p in phrases)


def _reference_heading(line: str) -> bool:
    return any(line == h or line.startswith(h + " ") for h in V.REFERENCE_HEADINGS)


#: Marks of a text alone and those that need the text itself, which are null where it is null.
MARKS = (
    "nt string, id_noise long, has_def boolean, is_ref boolean, closing boolean, intro_cue boolean, strong_cue boolean, bio boolean, list_cue boolean,"
    " relation_words boolean, relation_section boolean, relation_weight double, relation_negative long,"
    " n_words long, n_sentences long, noise long, citation long, cites_first boolean, many_lines boolean, has_bullet boolean, enumerates boolean"
)
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
_FIELDS = [(n, _KINDS[k]) for n, k in (f.split() for f in MARKS.split(","))]


def _marks(text: str | None) -> tuple:
    nt = normalized(text)
    pad = f" {nt} "
    line = normalized(text.lstrip(" \t\n\x0b\f\r").split("\n", 1)[0]) if text else ""
    weight = 0.0  # added one by one: sum() would round otherwise than Spark
    for p, w in _RELATION:
        weight += w if p in pad else 0.0
    own = (
        nt, _hits(_IDENTITY_NOISE, pad), _any(_DEFINES, pad), _reference_heading(line), line in CLOSING_HEADINGS, _any(_INTRO, f" {nt[:1000]} "), _any(_STRONG, f" {nt[:700]} "),
        _any(_BIO, f" {nt[:900]} "), _LIST_CUE.search(nt) is not None, weight > 0, _any(_RELATION_SECTION, pad), weight, _hits(_NEGATIVE, pad),
    )
    if text is None:
        return (*own, *[None] * (len(_FIELDS) - len(own)))
    low, raw, bare = text.lower(), text.encode(), text.strip(" ")
    first = _CITED.match(bare) is not None
    return (
        *own, len(raw.split()), text.count(".") + text.count("!") + text.count("?"), _hits(_NOISE, pad) + min(low.count("http") + low.count("www."), 5),
        min(len(_CITED.findall(bare)), 8) + 5 * first, first, sum(not not x.strip() for x in raw.split(b"\n")) >= 3, _BULLET.search(text) is not None,
        text.count(",") >= 2 or text.count(";") >= 2,
    )


def _struct(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def text_marks(text: Column) -> Column:
    """What a text alone shows, as a struct of ``MARKS``."""

    def run(t: pa.Array) -> pa.Array:
        return _struct([_marks(x) for x in t.to_pylist()], _FIELDS)

    return F.arrow_udf(run, f"struct<{','.join(f.strip().replace(' ', ':').replace('long', 'bigint') for f in MARKS.split(','))}>")(text)


def meaningful_words(text: Column) -> Column:
    """``T.meaningful_tokens`` of the texts that are not null; none for null."""

    def run(t: pa.Array) -> pa.Array:
        return _lists([meaningful(x) for x in t.to_pylist()], pa.string())

    return F.arrow_udf(run, "array<string>")(text)


_PAIR = [("match", pa.float64()), ("topic_hits", pa.int64()), ("strong_hits", pa.int64()), ("quoted", pa.bool_())]
_FILLER = frozenset(V.STRONG_INTRO_FILLER)


def _pair(nq: str, topic: str, nt: str) -> tuple:
    head = nt[:900]
    found = [t for t in dict.fromkeys(nq.split(" ")) if len(t) > 2 and t in nt]
    match = 0.0
    for t in found:
        match += 0.25 if t in head else 0.08
    return min(match, 1.25), len(set(topic.split(" ")).intersection(found)), sum([t not in _FILLER and t in nt[:700] for t in found]), nq != "" and nq in nt[:1000]


def pair_marks(nq: Column, topic_words: Column, nt: Column) -> Column:
    """Of a question and a text, both normalised: the score of the question's words in the text (near its start they count more, 1.25 at most), how
    many topic words it has, how many words its first 700 characters, and whether its first 1,000 hold the question."""

    def run(q: pa.Array, w: pa.Array, t: pa.Array) -> pa.Array:
        return _struct([_pair(a or "", b or "", c or "") for a, b, c in zip(q.to_pylist(), w.to_pylist(), t.to_pylist())], _PAIR)

    return F.arrow_udf(run, "struct<match:double,topic_hits:bigint,strong_hits:bigint,quoted:boolean>")(nq, topic_words, nt)
