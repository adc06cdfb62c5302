"""Structured references (rule, directive, section, article, chapter, part) in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vocab as V

ROMAN = r"^[ivxlcdm]+$"


def plausible_section_id(ident: Column) -> Column:
    compact = F.replace(ident, F.lit("."), F.lit(""))
    return compact.rlike("[0-9]") | compact.rlike("^[a-z]$") | compact.rlike(ROMAN)


SINGLE = f"(?:{V.RULE_REFERENCE}|{V.SECTION_REFERENCE})"
GROUPED = f"(?:{V.GROUPED_REFERENCE})"


def _matches(low: Column, pattern: str, source: int) -> Column:
    """Array of (pos, source, hit) for one pattern; positions come from the pieces between hits."""
    hits = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    gaps = F.split(low, pattern)

    def one(hit: Column, i: Column) -> Column:
        before = F.concat(F.array_join(F.slice(gaps, F.lit(1), i + 1), ""), F.array_join(F.slice(hits, F.lit(1), i), ""))
        return F.struct(F.length(before).alias("pos"), F.lit(source).alias("source"), hit.alias("hit"))

    return F.transform(hits, one)


def explode_references(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct reference of each text, numbered by first position.

    Columns: ``key, ref_no, kind, identifier``.  Each text is handled on its own row, so
    the window below only ever sees the references of a single text.
    """
    low = F.lower(F.col(text))
    found = F.concat(_matches(low, SINGLE, 0), _matches(low, GROUPED, 1))
    rows = df.where(low.rlike("rule|dir|section|article|chapter|part")).select(
        F.col(key), F.explode(found).alias("m")
    )
    is_group = F.col("m.source") == 1
    raw = F.regexp_extract("m.hit", "^([a-z]+)", 1)
    raw = F.regexp_extract(raw, "^(rule|dir|section|article|chapter|part)", 1)
    kind = F.when(raw == "dir", "directive").otherwise(raw)
    single_id = F.regexp_extract("m.hit", r"^[a-z]+\s*(?:no\.?\s*|number\s*)?([a-z0-9]+(?:\.[0-9]+)*[a-z]?)$", 1)
    ids = F.when(is_group, F.regexp_extract_all("m.hit", F.lit(r"([0-9]+(?:\.[0-9]+)*[a-z]?)"), F.lit(1))).otherwise(
        F.array(single_id)
    )
    refs = (
        rows.select(
            key, "m.pos", "m.source", kind.alias("kind"), F.posexplode(ids).alias("off", "identifier")
        )
        .where(F.col("identifier") != "")
        .where(~F.col("kind").isin(V.SECTION_LIKE_KINDS) | plausible_section_id(F.col("identifier")))
    )
    first = refs.groupBy(key, "kind", "identifier").agg(F.min(F.struct("pos", "source", "off")).alias("p"))
    w = Window.partitionBy(key).orderBy("p", "kind", "identifier")
    return first.select(key, F.row_number().over(w).cast("bigint").alias("ref_no"), "kind", "identifier")


def has_malformed_reference(text: Column) -> Column:
    return F.lower(text).rlike(V.MALFORMED_REFERENCE)


def reference_label(kind: Column, identifier: Column) -> Column:
    return F.concat(F.when(kind == "directive", F.lit("Dir")).otherwise(F.initcap(kind)), F.lit(" "), identifier)


def requirement_statement(text: Column) -> Column:
    """Lines between the heading line and the first label line, as one line of text."""
    body = F.regexp_replace(text, r"^[^\n]*\n?", "")
    label = r"(?is)(?:^|\n)[ \t]*(?:category|analysis|applies to|amplification|rationale|exceptions?|examples?|see also)\b.*$"
    return F.trim(F.regexp_replace(F.regexp_replace(body, label, ""), r"\s+", " "))


LABELS = "category|analysis|applies to|amplification|rationale|exceptions?|examples?|see also|note"


def labeled_block(text: Column, label: str) -> Column:
    """Body of the block that starts at a line holding ``label`` and ends at the next label line."""
    start = rf"(?is)^(?:.*?\n)?[ \t]*{label}[ \t]*:?[ \t]*(?:\n|$)"
    has = text.rlike(rf"(?i)(?:^|\n)[ \t]*{label}[ \t]*:?[ \t]*(?:\n|$)")
    tail = F.regexp_replace(text, start, "")
    body = F.regexp_replace(tail, rf"(?is)(?:^|\n)[ \t]*(?:{LABELS})[ \t]*:?[ \t]*(?:\n.*)?$", "")
    return F.when(has, F.trim(F.regexp_replace(body, r"\s+", " "))).otherwise(F.lit(""))
