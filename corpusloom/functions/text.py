"""Text expressions: ``Column -> Column``, built-in functions only (whole-stage codegen friendly)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold_tables() -> tuple[str, str]:
    """Lower-case letters whose compatibility decomposition is one ASCII character plus marks."""
    src, dst = [], []
    spans = [(0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2000, 0x2064), (0x2070, 0x209D), (0x3000, 0x3001), (0xFF01, 0xFF5F)]
    for lo, hi in spans:
        for cp in range(lo, hi):
            ch = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
            if len(base) == 1 and ord(base) < 128 and ch != base:
                src.append(ch)
                dst.append(base)
    # The ellipsis decomposes to dots: one dot separates words just as well.
    src.append("…")
    dst.append(".")
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _fold_tables()
# Characters that decompose to several ASCII characters.
MULTI_FOLD = {
    ch: "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
    for ch in "¼½¾ĳǆǉǌǳ™№ﬀﬁﬂﬃﬄﬅﬆ"
}


def _fold(col: Column) -> Column:
    low = F.translate(F.lower(col), FOLD_FROM, FOLD_TO)
    multi = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1].lower())), MULTI_FOLD.items(), low)
    return F.when(low.rlike("[" + "".join(MULTI_FOLD) + "]"), multi).otherwise(low)


def fold_drop(col: ColumnOrName) -> Column:
    """Lower-case ASCII text; characters without an ASCII base disappear and join their neighbours."""
    return F.regexp_replace(_fold(_c(col)), r"[^\x00-\x7F]", "")


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with every ``\b`` between ASCII words only, whatever the regex engine takes for a letter."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def upper(col: ColumnOrName) -> Column:
    """Upper case that keeps one letter one letter: the sharp s becomes its capital, not two letters."""
    return F.array_join(F.transform(F.split(_c(col), "ß"), F.upper), "ẞ")


def tokenize(col: ColumnOrName) -> Column:
    """Index tokens: runs of ASCII letters and digits."""
    return F.regexp_extract_all(fold_drop(col), F.lit("([a-z0-9]+)"), F.lit(1))


def normalize_text(col: ColumnOrName) -> Column:
    """Lower-case, marks removed, everything but letters and digits becomes one blank."""
    bare = F.regexp_replace(_fold(_c(col)), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.coalesce(bare, F.lit("")), r"[^a-z0-9]+", " "))


def normalize_grounding(col: ColumnOrName) -> Column:
    """Case-folded text without marks; punctuation stays."""
    bare = F.regexp_replace(_fold(_c(col)), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.replace(bare, F.lit("ß"), F.lit("ss")), r"\s+", " "))


def squash(col: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(_c(col), r"\s+", " "))


def clean_text(col: ColumnOrName) -> Column:
    """Normalise line ends, quotes and dashes; drop page-number lines, rules and surplus blanks."""
    t = F.translate(_c(col), "\u0000\r‘’“”–—• ", " \n''\"\"--- ")
    t = F.regexp_replace(t, r"(?im)^page\s+\d+\s*$", "")
    t = F.regexp_replace(t, r"(?im)^page\s+\d+\s+of\s+\d+\s*$", "")
    t = F.regexp_replace(t, r"[-_=]{5,}", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\s+\n", "\n")
    t = F.regexp_replace(t, r"\n\s+\n", "\n\n")
    return F.coalesce(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def _cut(tok: Column, n: int) -> Column:
    return F.substring(tok, F.lit(1), F.length(tok) - F.lit(n))


def light_stem(tok: Column) -> Column:
    """First matching suffix rule wins."""
    n = F.length(tok)
    ed = _cut(tok, 2)
    return (
        F.when(n <= 3, tok)
        .when(tok.endswith("ies") & (n > 5), F.concat(_cut(tok, 3), F.lit("y")))
        .when(tok.endswith("ing") & (n > 6), _cut(tok, 3))
        .when(tok.endswith("ed") & (n > 5), F.when(ed.endswith("i"), F.concat(_cut(tok, 3), F.lit("y"))).otherwise(ed))
        .when(tok.endswith("es") & (n > 5), _cut(tok, 2))
        .when(tok.endswith("s") & (n > 4), _cut(tok, 1))
        .when(tok.endswith("e") & (n > 4), _cut(tok, 1))
        .otherwise(tok)
    )


def catalog_stem(tok: Column) -> Column:
    n = F.length(tok)
    ed = _cut(tok, 2)
    return (
        F.when(tok.endswith("ies") & (n > 4), F.concat(_cut(tok, 3), F.lit("y")))
        .when(tok.endswith("ing") & (n > 6), _cut(tok, 3))
        .when(tok.endswith("ed") & (n > 5), F.when(ed.endswith("i"), F.concat(_cut(tok, 3), F.lit("y"))).otherwise(ed))
        .when(tok.endswith("s") & (n > 4) & ~tok.endswith("ss"), _cut(tok, 1))
        .otherwise(tok)
    )


def _keep(words: Iterable[str]):
    listed = list(words)
    return lambda t: (F.length(t) > 2) & ~t.isin(listed)


def meaningful_tokens(col: ColumnOrName) -> Column:
    """Distinct stemmed content tokens in order of first occurrence."""
    keep = _keep(V.COVERAGE_STOP_WORDS)
    # Distinct before the stemming lambdas: long texts repeat few words.
    raw = F.filter(F.array_distinct(tokenize(col)), keep)
    return F.array_distinct(F.filter(F.transform(raw, light_stem), keep))


def _topic_words(normalized: Column, stop: Iterable[str]) -> Column:
    return F.array_distinct(F.filter(F.split(normalized, " "), _keep(stop)))


def query_topic_tokens(col: ColumnOrName, n: Column | None = None) -> Column:
    """``n``: the normalised question, where the caller has it."""
    return _topic_words(normalize_text(col) if n is None else n, V.QUERY_FILLER_WORDS)


def file_stem(col: ColumnOrName) -> Column:
    t = F.regexp_replace(F.trim(_c(col)), r"\.[^.]+$", "")
    t = F.regexp_replace(t, r"(?i)\s*-\s*Wikipedia$", "")
    t = F.regexp_replace(t, r"(?i)[_\s-]*FromInternet$", "")
    return F.regexp_replace(t, r"\([^)]*\)", " ")


def file_topic_tokens(col: ColumnOrName) -> Column:
    return _topic_words(normalize_text(file_stem(col)), V.FILE_FILLER_WORDS)


def canonical_topic(col: ColumnOrName) -> Column:
    """Readable topic from a file name; NULL when nothing is left."""
    t = F.regexp_replace(F.trim(_c(col)), r"\.[^.]+$", "")
    t = F.regexp_replace(t, r"(?i)\s*-\s*Wikipedia$", "")
    t = squash(F.regexp_replace(t, r"(?i)[\s_-]*FromInternet$", ""))
    return F.nullif(t, F.lit(""))


# ---- shape metrics -------------------------------------------------------------------------


def word_count(col: ColumnOrName) -> Column:
    return F.regexp_count(_c(col), F.lit(r"\S+")).cast("bigint")


def sentence_count(col: ColumnOrName) -> Column:
    return F.regexp_count(_c(col), F.lit("[.!?]")).cast("bigint")


def line_count(col: ColumnOrName) -> Column:
    return F.regexp_count(_c(col), F.lit(r"[^\n]*\S[^\n]*")).cast("bigint")


def bullet_count(col: ColumnOrName) -> Column:
    return F.regexp_count(_c(col), F.lit(r"(?m)^[ \t]*(?:[-*+][ \t]+|[0-9]+[.)][ \t]+)")).cast("bigint")


def citation_score(col: ColumnOrName) -> Column:
    t = F.trim(_c(col))
    marks = F.least(F.regexp_count(t, F.lit(r"\[[0-9]+\]")), F.lit(8))
    return (marks + F.when(t.rlike(r"^\[[0-9]+\]"), 5).otherwise(0)).cast("bigint")


def padded(normalized: Column) -> Column:
    return F.concat(F.lit(" "), normalized, F.lit(" "))


def _phrases(phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(f" {p} ") for p in phrases])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` as a lambda variable: inside another lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def phrase_hits(pad: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur."""
    return _bound(pad, lambda t: F.size(F.filter(_phrases(phrases), lambda p: t.contains(p)))).cast("bigint")


def any_phrase(pad: Column, phrases: Sequence[str]) -> Column:
    return pad.rlike(" (" + "|".join(phrases) + ") ")


def phrase_weight(pad: Column, weights: dict[str, float]) -> Column:
    pairs = F.array(*[F.struct(F.lit(f" {p} ").alias("p"), F.lit(float(w)).alias("w")) for p, w in weights.items()])
    return _bound(pad, lambda t: F.aggregate(F.filter(pairs, lambda x: t.contains(x["p"])), F.lit(0.0), lambda acc, x: acc + x["w"]))


def reference_noise(col: ColumnOrName, pad: Column | None = None) -> Column:
    t = F.lower(_c(col))
    urls = F.regexp_count(t, F.lit("http")) + F.regexp_count(t, F.lit(r"www\."))
    return (
        phrase_hits(pad if pad is not None else padded(normalize_text(col)), V.REFERENCE_NOISE_TERMS)
        + F.least(urls, F.lit(5))
    ).cast("bigint")


def identity_noise(pad: Column) -> Column:
    return phrase_hits(pad, V.IDENTITY_NOISE_TERMS)


def has_definition(pad: Column) -> Column:
    return any_phrase(pad, V.DEFINITION_SIGNALS)


def is_reference_heading(value: Column) -> Column:
    return value.rlike("^(" + "|".join(V.REFERENCE_HEADINGS) + ")( |$)")


def first_line(col: ColumnOrName) -> Column:
    return F.substring_index(F.regexp_replace(_c(col), r"^\s+", ""), "\n", 1)


def is_reference_section(text: ColumnOrName, title: Column | None = None) -> Column:
    line = is_reference_heading(normalize_text(first_line(text)))
    return line if title is None else line | is_reference_heading(normalize_text(title))


# ---- keys and vectors --------------------------------------------------------------------------


def doc_key(path: ColumnOrName, root: str = "") -> Column:
    """Corpus-relative, slash-separated, lower-case key of a path."""
    p = F.lower(F.regexp_replace(F.translate(_c(path), "\\", "/"), "/+", "/"))
    if root:
        base = root.replace("\\", "/").rstrip("/").lower() + "/"
        p = F.when(p.startswith(base), F.substring(p, F.lit(len(base) + 1), F.length(p))).otherwise(p)
    return F.regexp_replace(p, r"^(\./|/)+", "")


def content_hash(col: ColumnOrName) -> Column:
    return F.sha2(_c(col), 256)


URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def record_id(path: ColumnOrName, chunk_id: ColumnOrName) -> Column:
    """Name-based UUID (version 5, URL namespace) of ``path|chunk_id``."""
    name = F.concat(_c(path), F.lit("|"), _c(chunk_id).cast("string"))
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lower(F.lpad(F.hex(variant), 2, "0")), F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def l2_normalize(a: ColumnOrName) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda v: v.cast("double") / n)).otherwise(
        F.transform(_c(a), lambda v: v.cast("double"))
    )


def decode_unicode_markers(col: ColumnOrName) -> Column:
    """``#U00e9`` -> the character; markers past the last code point stay as they are."""
    pieces = F.split(_c(col), r"(?=#U[0-9A-Fa-f]{4})")

    def decode(piece: Column) -> Column:
        code = F.regexp_extract(piece, r"^#U([0-9A-Fa-f]{4,6})", 1)
        point = F.conv(code, 16, 10).cast("int")
        rest = F.substring(piece, F.length(code) + F.lit(3), F.length(piece))
        valid = (code != "") & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), rest)).otherwise(piece)

    return F.array_join(F.transform(pieces, decode), "")


SCRIPTS = {
    "CJK": "Han", "HIRAGANA": "Hiragana", "KATAKANA": "Katakana", "HANGUL": "Hangul", "CYRILLIC": "Cyrillic",
    "ARABIC": "Arabic", "HEBREW": "Hebrew", "DEVANAGARI": "Devanagari", "THAI": "Thai", "GREEK": "Greek",
    "ARMENIAN": "Armenian", "GEORGIAN": "Georgian", "BENGALI": "Bengali", "TAMIL": "Tamil", "TELUGU": "Telugu",
    "ETHIOPIC": "Ethiopic", "KHMER": "Khmer", "LAO": "Lao", "MYANMAR": "Myanmar", "TIBETAN": "Tibetan",
}


def script_families(col: ColumnOrName) -> Column:
    """Non-Latin scripts of the letters in a text."""
    found = [F.when(_c(col).rlike(rf"[\p{{Is{s}}}&&\p{{L}}]"), F.lit(name)) for name, s in SCRIPTS.items()]
    return F.array_compact(F.array(*found))
