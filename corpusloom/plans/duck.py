"""Snippets of DuckDB SQL used to write the oracle queries."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from corpusloom.functions import vocab as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws: Iterable[str]) -> str:
    return "(" + ",".join(lit(w) for w in ws) + ")"


def arr(ws: Iterable[str]) -> str:
    return "[" + ",".join(lit(w) for w in ws) + "]"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(regexp_replace({fold(x)}, '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def rsub(x: str, pattern: str, repl: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, {lit(flags)})"


def rx(x: str, pattern: str, flags: str = "") -> str:
    extra = f", {lit(flags)}" if flags else ""
    return f"regexp_matches({x}, {lit(pattern)}{extra})"


def count_rx(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {lit(pattern)}))"


def stem(t: str) -> str:
    cut = lambda n: f"left({t}, length({t})-{n})"
    return (
        f"CASE WHEN length({t})<=3 THEN {t} WHEN {t} LIKE '%ies' AND length({t})>5 THEN {cut(3)}||'y' "
        f"WHEN {t} LIKE '%ing' AND length({t})>6 THEN {cut(3)} "
        f"WHEN {t} LIKE '%ied' AND length({t})>5 THEN {cut(3)}||'y' "
        f"WHEN {t} LIKE '%ed' AND length({t})>5 THEN {cut(2)} "
        f"WHEN {t} LIKE '%es' AND length({t})>5 THEN {cut(2)} WHEN {t} LIKE '%s' AND length({t})>4 THEN {cut(1)} "
        f"WHEN {t} LIKE '%e' AND length({t})>4 THEN {cut(1)} ELSE {t} END"
    )


def catalog_stem(t: str) -> str:
    cut = lambda n: f"left({t}, length({t})-{n})"
    return (
        f"CASE WHEN {t} LIKE '%ies' AND length({t})>4 THEN {cut(3)}||'y' "
        f"WHEN {t} LIKE '%ing' AND length({t})>6 THEN {cut(3)} "
        f"WHEN {t} LIKE '%ied' AND length({t})>5 THEN {cut(3)}||'y' "
        f"WHEN {t} LIKE '%ed' AND length({t})>5 THEN {cut(2)} "
        f"WHEN {t} LIKE '%s' AND length({t})>4 AND {t} NOT LIKE '%ss' THEN {cut(1)} ELSE {t} END"
    )


def ordered_distinct(lst: str) -> str:
    """Distinct in first-occurrence order."""
    return f"list_filter({lst}, lambda v_, i_: list_position({lst}, v_) = i_)"


def meaningful(x: str) -> str:
    """Distinct stemmed content tokens, unordered."""
    stop = words(V.COVERAGE_STOP_WORDS)
    raw = f"list_filter(list_distinct({tokens(x)}), lambda t_: length(t_)>2 AND t_ NOT IN {stop})"
    stems = f"list_transform({raw}, lambda t_: {stem('t_')})"
    return f"list_distinct(list_filter({stems}, lambda t_: length(t_)>2 AND t_ NOT IN {stop}))"


def topic_words(normalized: str, stop: Sequence[str]) -> str:
    kept = f"list_filter(string_split({normalized}, ' '), lambda t_: length(t_)>2 AND t_ NOT IN {words(stop)})"
    return kept


def phrase_hits(pad: str, phrases: Sequence[str]) -> str:
    return "(" + "+".join(f"contains({pad}, {lit(' ' + p + ' ')})::INT" for p in phrases) + ")"


def any_phrase(pad: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({pad}, {lit(' ' + p + ' ')})" for p in phrases) + ")"


def phrase_weight(pad: str, weights: dict[str, float]) -> str:
    return "(" + "+".join(f"(CASE WHEN contains({pad}, {lit(' ' + p + ' ')}) THEN {w} ELSE 0 END)" for p, w in weights.items()) + ")"


def pad(x: str) -> str:
    return f"(' '||{norm(x)}||' ')"


def first_line(x: str) -> str:
    return f"string_split(regexp_replace({x}, '^\\s+', ''), chr(10))[1]"


def is_reference_section(x: str) -> str:
    pattern = "^(" + "|".join(V.REFERENCE_HEADINGS) + ")( |$)"
    return rx(norm(first_line(x)), pattern)


def reference_noise(x: str, padded: str | None = None) -> str:
    low = f"lower({x})"
    urls = f"({count_rx(low, 'http')} + {count_rx(low, 'www[.]')})"
    return f"({phrase_hits(padded or pad(x), V.REFERENCE_NOISE_TERMS)} + least({urls}, 5))"


def citation_score(x: str) -> str:
    t = f"trim({x})"
    marks = count_rx(t, r"\[[0-9]+\]")
    return f"(least({marks}, 8) + CASE WHEN {rx(t, chr(94) + chr(92) + '[[0-9]+' + chr(92) + ']')} THEN 5 ELSE 0 END)"
