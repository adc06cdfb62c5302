"""Document structure: layout lines -> sections -> units -> chunks.

Line tables carry ``doc_key`` and a unique integer ``line_no``.  Ordered state (open
heading, category seen, inherited parent) is carried by two-level scans, so one huge
document does not become one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators.scale import block_row_number, block_scan, bounded_batches, computed_once, materialized, top_k_per, two_level_count

# Heading patterns and terms.
RULE_HEADING = r"(?i)^\s*Rule\s+([0-9]+(?:\.[0-9]+)*)(?:\s*[-:–—]\s*.*)?\s*$"
DIRECTIVE_HEADING = r"(?i)^\s*(?:Dir|Directive)\s+([0-9]+(?:\.[0-9]+)*)(?:\s*[-:–—]\s*.*)?\s*$"
NAMED_HEADING = r"(?i)^\s*(?:Section|Article|Chapter|Part)\s+([A-Za-z0-9]+(?:\.[0-9]+)*)\b.*$"
NUMBERED_HEADING = r"^\s*([0-9]+(?:\.[0-9]+){0,4})[.)]?\s+[A-Za-z][^\n]{1,100}$"
PAGE_NUMBER = r"(?i)^\s*(?:page\s*)?[0-9]+(?:\s*(?:of|/)\s*[0-9]+)?\s*$"
HEADING_TERMS = (
    "policy|procedure|purpose|scope|definitions|responsibilities|eligibility|requirements|exceptions|guidelines"
    "|approval|benefits|entitlement"
)
ROLE_BY_TITLE = {
    "amplification": "amplification", "rationale": "rationale", "example": "example", "examples": "example",
    "exception": "exception", "exceptions": "exception", "note": "note", "notes": "note", "see also": "cross_reference",
}


def body_font_size(lines: DataFrame) -> DataFrame:
    """``doc_key, body_size``: most common font of lines with three words or more (ties: first seen)."""
    f = lines.where((F.col("font") > 0) & (T.word_count("text") >= 3))
    g = f.groupBy("doc_key", F.round("font", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    best = top_k_per(g, ["doc_key"], [F.col("n").desc(), F.col("first").asc()], 1, "r")
    docs = lines.select("doc_key").distinct()
    return docs.join(best, "doc_key", "left").select("doc_key", F.coalesce("size", F.lit(10.0)).alias("body_size"))


def decoration_key(text: Column) -> Column:
    t = F.regexp_replace(F.lower(text), r"\bpage\s+[0-9]+(?:\s+of\s+[0-9]+)?\b", "page #")
    return F.regexp_replace(T.squash(t), r"^[ \-|\t]+|[ \-|\t]+$", "")


def repeated_decorations(lines: DataFrame) -> DataFrame:
    """``doc_key, deco``: top/bottom lines that repeat on half of a document's pages (at least three)."""
    h = F.greatest(F.col("page_height"), F.lit(1.0))
    edge = (F.col("y0") / h <= 0.12) | (F.col("y1") / h >= 0.88)
    pages = two_level_count(lines, ["doc_key"], ["page"], "n_pages")
    k = lines.where(edge).withColumn("deco", decoration_key(F.col("text")))
    k = k.where((F.col("deco") != "") & (F.length("deco") <= 160))
    seen = two_level_count(k, ["doc_key", "deco"], ["page"], "n_seen")
    j = seen.join(pages, "doc_key")
    need = F.greatest(F.lit(3), F.ceil(F.col("n_pages") * 0.5))
    return j.where((F.col("n_pages") >= 3) & (F.col("n_seen") >= need)).select("doc_key", "deco")


def drop_decorations(lines: DataFrame) -> DataFrame:
    l = lines.where(~F.col("text").rlike(PAGE_NUMBER)).withColumn("deco", decoration_key(F.col("text")))
    return l.join(repeated_decorations(lines), ["doc_key", "deco"], "left_anti").drop("deco")


def classify_heading(text: Column, font: Column, bold: Column, body: Column) -> Column:
    """``struct(type, rule_id, section_id)`` of a heading line, NULL otherwise."""
    t = F.trim(text)
    prominent = (F.length(text) <= 140) & ((font >= body * 1.20) | (bold & (font >= body * 1.03)))
    made = lambda ty, rid, sid: F.struct(F.lit(ty).alias("type"), rid.alias("rule_id"), sid.alias("section_id"))
    none = F.lit("")
    letters = F.regexp_count(t, F.lit(r"\p{L}"))
    upper = F.regexp_count(t, F.lit(r"\p{Lu}"))
    words = F.regexp_count(t, F.lit(r"\S+"))
    titled = F.regexp_count(t, F.lit(r"(?:^|\s)[\p{Lu}0-9]"))
    loose = (
        (words <= 16) & ~t.rlike(r"[.?!;]$")
        & (((letters > 0) & (upper / letters >= 0.70)) | F.lower(t).rlike(f"^({HEADING_TERMS})")
           | ((titled >= F.greatest(F.lit(1), F.ceil(words * 0.6))) & (letters > 0)))
    )
    return (
        F.when((t == "") | (F.length(t) > 180) | ~prominent, None)
        .when(t.rlike(RULE_HEADING), made("rule", F.regexp_extract(t, RULE_HEADING, 1), none))
        .when(t.rlike(DIRECTIVE_HEADING), made("directive", F.regexp_extract(t, DIRECTIVE_HEADING, 1), none))
        .when(t.rlike(NAMED_HEADING), made("section", none, F.regexp_extract(t, NAMED_HEADING, 1)))
        .when(t.rlike(NUMBERED_HEADING), made("section", none, F.regexp_extract(t, NUMBERED_HEADING, 1)))
        .when(loose, made("section", none, none))
    )


def headings(lines: DataFrame) -> DataFrame:
    """Content lines with a ``heading`` struct."""
    content = materialized(drop_decorations(lines))  # sizes and headings read it
    sizes = body_font_size(content)
    l = content.join(sizes, "doc_key")
    return l.withColumn("heading", classify_heading(F.col("text"), F.col("font"), F.col("bold"), F.col("body_size")))


def assign_sections(lines: DataFrame) -> DataFrame:
    """Content lines with ``start`` (line that opens their section) and the section's heading fields.

    An unnumbered heading inside a rule is only text until the rule's Category line was seen;
    before the first heading, sections break where the page changes.
    """
    h = headings(lines)
    ty, named = F.col("heading.type"), (F.col("heading.rule_id") != "") | (F.col("heading.section_id") != "")
    strong = F.when(F.col("heading").isNotNull() & (ty.isin("rule", "directive") | named), F.struct(F.col("line_no").alias("at"), ty.alias("type")))
    category = F.when(F.col("text").rlike(r"(?i)^\s*Category\s*$"), F.col("line_no"))
    h = block_scan(h, ["doc_key"], "line_no", fill_before={"last_strong": strong, "last_category": category}, lag={"prev_page": F.col("page")})
    inside_rule = F.coalesce(F.col("last_strong.type").isin("rule", "directive"), F.lit(False))
    no_category = F.coalesce(F.col("last_category") < F.col("last_strong.at"), F.lit(True))
    weak = F.col("heading").isNotNull() & ~ty.isin("rule", "directive") & ~named
    opens = F.col("heading").isNotNull() & ~(weak & inside_rule & no_category)
    h = h.withColumn("opens", opens)
    h = block_scan(h, ["doc_key"], "line_no", total={"n_open": F.col("opens").cast("int")})
    page_break = (F.col("n_open") == 0) & (F.col("prev_page").isNull() | (F.col("prev_page") != F.col("page")))
    h = h.withColumn("begins", F.col("opens") | page_break)
    first = F.when(
        F.col("begins"),
        F.struct(F.col("line_no").alias("start"), F.when(F.col("opens"), F.col("heading")).alias("head"),
                 F.when(F.col("opens"), F.col("text")).alias("title")),
    )
    h = block_scan(h, ["doc_key"], "line_no", fill={"sec": first})
    return h.select(
        "doc_key", "line_no", "page", "text", F.col("sec.start").alias("start"),
        F.coalesce("sec.head.type", F.lit("background")).alias("section_type"), F.coalesce("sec.head.rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("sec.head.section_id", F.lit("")).alias("section_id"), F.coalesce("sec.title", F.lit("")).alias("section_title"),
    )


def sections(lines: DataFrame) -> DataFrame:
    """One row per non-empty section with its text and page range, keyed by ``doc_key, start``."""
    g = assign_sections(lines).groupBy("doc_key", "start", "section_type", "rule_id", "section_id", "section_title").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls"), F.min("page").alias("page_start"), F.max("page").alias("page_end")
    )
    g = g.withColumn("text", F.regexp_replace(F.array_join(F.transform("ls", lambda x: x["text"]), "\n"), r"^\s+|\s+$", ""))
    return g.drop("ls").where("text <> ''")


def split_see_also(text: Column) -> Column:
    """``struct(main, cross)``: the part before the first See-also line and the cross references."""
    p = r"(?im)^\s*see\s+also\s*$"
    has = text.rlike(p)
    t = F.trim(text)
    parts = F.split(t, p, 2)
    after = F.regexp_replace(F.get(parts, F.lit(1)), r"^\s+|\s+$", "")
    cross = F.when(after != "", F.concat(F.lit("See also\n"), after)).otherwise("See also")
    main = F.regexp_replace(F.get(parts, F.lit(0)), r"^\s+|\s+$", "")
    return F.struct(F.when(has, main).otherwise(t).alias("main"), F.when(has, cross).otherwise("").alias("cross"))


def role_of(title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ROLE_BY_TITLE.items() for x in kv])
    return F.coalesce(F.element_at(table, F.lower(T.squash(title))), F.lit(""))


def anchored(parent: Column, text: Column) -> Column:
    return F.when((parent == "") | (text == "") | F.lower(text).startswith(F.lower(parent)), text).otherwise(
        F.concat(parent, F.lit("\n"), text))


def inherit_parent(secs: DataFrame) -> DataFrame:
    """Units: rules open a parent, role sections inherit it, any other section closes it."""
    s = secs.withColumns({"role": role_of(F.col("section_title")), "is_rule": F.col("section_type").isin("rule", "directive")})
    label = F.when(F.trim("section_title") != "", F.trim("section_title")).otherwise(F.concat(F.initcap("section_type"), F.lit(" "), F.col("rule_id")))
    state = F.when(
        F.col("is_rule"), F.struct(F.col("section_type").alias("ptype"), F.col("rule_id").alias("pid"), label.alias("ptitle"))
    ).when(F.col("role") == "", F.struct(F.lit("").alias("ptype"), F.lit("").alias("pid"), F.lit("").alias("ptitle")))
    s = block_scan(s, ["doc_key"], "start", fill={"parent": state})
    blank = lambda c: F.coalesce(c, F.lit(""))
    s = s.withColumns({
        "parent_type": blank(F.col("parent.ptype")), "parent_identifier": blank(F.col("parent.pid")), "parent_title": blank(F.col("parent.ptitle")),
        "cut": split_see_also(F.col("text")),
    })
    plain = F.col("is_rule") | (F.col("role") == "")
    own_role = F.when(F.col("is_rule"), "requirement").when(F.col("role") == "", "document_section").otherwise(F.col("role"))
    unit = lambda no, text, title, role: F.struct(
        F.lit(no).alias("unit_part"), text.alias("text"), title.alias("section_title"), role.alias("section_role"))
    title = F.col("section_title")
    whole = F.array(unit(0, F.trim("text"), title, own_role))
    both = F.filter(F.array(unit(0, F.col("cut.main"), title, own_role), unit(1, F.col("cut.cross"), F.lit("See also"), F.lit("cross_reference"))), lambda u: u["text"] != "")
    s = s.withColumn("u", F.explode(F.when(plain, whole).otherwise(both)))
    text = F.when(plain, F.col("u.text")).otherwise(anchored(F.col("parent_title"), F.col("u.text")))
    return s.select(
        "doc_key", "start", "u.unit_part", text.alias("text"), "u.section_title", "section_type", "rule_id", "section_id", "u.section_role",
        "parent_type", "parent_identifier", "parent_title", "page_start", "page_end")


def sentence_bounds(words: list[str], size: int) -> list[int]:
    """Word positions at which a window may begin or end: sentence ends, and every ``size`` words of a longer sentence."""
    out, last = [0], 0
    for i, w in enumerate(words, 1):
        if i - last == size or i == len(words) or w.endswith((".", "!", "?")):
            out.append(i)
            last = i
    return out


def sentence_windows(words: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges of windows over whole sentences, in time linear in the text.

    A window takes sentences while they fit into ``size`` words.  The next one begins with the last sentences of it that have
    at most ``overlap`` words and leave room for the sentence that did not fit.
    """
    b = sentence_bounds(words, size)
    out, start, end, begin = [], 0, 0, 0
    while True:
        while end + 1 < len(b) and b[end + 1] - b[start] <= size:
            end += 1
        out.append((b[start], b[end]))
        if end + 1 >= len(b):
            return out
        begin = max(b[end] - overlap, b[end + 1] - size)
        while b[start] < begin:
            start += 1


def window_chunks(df: DataFrame, text: str = "text", size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows of whole sentences: adds ``part`` (0-based), ``parts`` and ``chunk_text``.

    Words are what single spaces part after squashing white space; a sentence ends at a word that ends in ``.``, ``!`` or ``?``,
    and one of more than ``size`` words is cut.  An empty text is one empty window, a null text none.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None):
            if t is None:
                return None
            words = t.split(" ")
            return [" ".join(words[a:b]) for a, b in sentence_windows(words, size, overlap)]

        return texts.map(one, na_action="ignore")

    d = bounded_batches(df).withColumn("__c", cut(T.squash(F.col(text))))
    d = d.withColumn("parts", F.size("__c").cast("bigint"))
    d = d.select(*[c for c in d.columns if c != "__c"], F.posexplode("__c").alias("part", "chunk_text"))
    return d.withColumn("part", F.col("part").cast("bigint"))


def number_chunks(df: DataFrame, file_key: str, doc_no: str, part: str) -> DataFrame:
    """0-based contiguous ``chunk_id`` and ``total_chunks`` per file, in (document, part) order."""
    pos = df.withColumn("__pos", F.col(doc_no) * F.lit(1 << 20) + F.col(part))
    r = block_row_number(pos, [file_key], "__pos", "__rn", width=1 << 36, total="total_chunks")
    return r.withColumn("chunk_id", F.col("__rn") - 1).drop("__rn", "__pos")


def min_length_gate(df: DataFrame, text: str, min_chars: int = V.MIN_DOCUMENT_CHARS) -> DataFrame:
    kept = df.columns
    df = df.withColumn("__n", computed_once(F.length(T.clean_text(text))))
    n = F.col("__n")
    reason = F.when(n == 0, "empty document").when(n < min_chars, F.concat(F.lit("text too short: "), n.cast("string")))
    return df.select(*kept, reason.alias("skip_reason"))


def ingest_corpus(docs: DataFrame) -> DataFrame:
    """Clean, gate, window and number documents (``doc_id, source, text``); skipped ones are left out."""
    d = docs.select("doc_id", "source", computed_once(T.clean_text("text")).alias("cleaned"))
    d = d.where(F.length("cleaned") >= V.MIN_DOCUMENT_CHARS)
    c = window_chunks(d, "cleaned").drop("cleaned")
    return number_chunks(c, "source", "doc_id", "part")


def prepared_cache(current: DataFrame, cache: DataFrame, schema: str) -> DataFrame:
    """Which documents can reuse prepared chunks (same content hash and schema)."""
    c = cache.where(F.col("schema") == schema).select("hash").distinct().withColumn("hit", F.lit(True))
    return current.join(c, "hash", "left").withColumn("action", F.when(F.col("hit"), "reuse").otherwise("prepare")).drop("hit")


def prune_cache(cache: DataFrame, current: DataFrame) -> DataFrame:
    return cache.join(current.select("hash").distinct(), "hash", "left_semi")


def label_value_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Short label lines directly followed by a value line, found inside each text row."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), T.squash), lambda x: x != "")
    d = docs.select(key, lines.alias("ls"))
    words = lambda x: F.size(F.split(x, " "))
    label = lambda x: (F.length(x) <= 70) & words(x).between(1, 8) & ~x.rlike(r"[.!?;]$")
    pair = F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("label"), F.get(F.col("ls"), i + 1).alias("value")))
    ok = F.filter(pair, lambda p: label(p["label"]) & p["value"].isNotNull() & (words(p["value"]) >= 4) & ~label(p["value"]))
    e = d.select(key, F.explode(ok).alias("p"))
    return e.select(key, F.col("p.i").cast("bigint").alias("line_no"), F.regexp_replace("p.label", r"\s*:\s*$", "").alias("label"), F.col("p.value").alias("value"))
