"""Structure and chunking queries: every document laid out as lines on pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import structure as S
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query
from corpusloom.plans.text_queries import _CLEAN

PAGE_LINES = 4


def layout_lines(spark, sf):
    """All document lines on pages of four, with running heads, page numbers and headings."""
    d = X.table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("ln", "body"))
    page = F.floor(F.col("ln") / PAGE_LINES) + 1
    d = d.withColumns({"page": page, "slot": F.col("ln") % PAGE_LINES})
    heading = (
        F.when(F.col("page") % 4 == 1, F.concat(F.lit("Rule "), F.col("doc_id"), F.lit("."), F.col("page")))
        .when(F.col("page") % 4 == 2, F.lit("Rationale"))
        .when(F.col("page") % 4 == 3, F.lit("Category"))
        .otherwise(F.concat(F.lit("Section 4."), F.col("page"), F.lit(" Scope")))
    )
    line = lambda sub, text, y0, font, when: F.when(when, F.struct(
        F.lit(sub).alias("sub"), text.alias("text"), F.lit(y0).cast("double").alias("y0"), F.lit(font).cast("double").alias("font")))
    first, last = F.col("slot") == 0, F.col("slot") == PAGE_LINES - 1
    items = F.array_compact(F.array(
        line(0, F.concat(F.lit("Corpus "), F.col("source"), F.lit(" - Page "), F.col("page")), 3, 9, first),
        line(1, heading, 15, 14, first),
        line(2, F.col("body"), 50, 10, F.lit(True)),
        line(3, F.col("page").cast("string"), 95, 9, last),
    ))
    d = d.select("doc_id", "ln", "page", F.explode(items).alias("i"))
    return d.select(
        F.col("doc_id").alias("doc_key"), (F.col("ln") * 4 + F.col("i.sub")).cast("bigint").alias("line_no"), "i.text", F.col("page").cast("bigint"),
        "i.y0", (F.col("i.y0") + 2).alias("y1"), F.lit(100.0).alias("page_height"), "i.font", F.lit(False).alias("bold"))


_BASE = f"""SELECT doc_id, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln FROM documents"""
_PG = f"SELECT *, ln // {PAGE_LINES} + 1 AS page, ln % {PAGE_LINES} AS slot FROM ({_BASE})"
_HEAD = "CASE page % 4 WHEN 1 THEN 'Rule ' || doc_id || '.' || page WHEN 2 THEN 'Rationale' WHEN 3 THEN 'Category' ELSE 'Section 4.' || page || ' Scope' END"
LINES_SQL = f"""SELECT doc_id AS doc_key, (ln * 4 + sub)::BIGINT AS line_no, text, page::BIGINT AS page, y0::DOUBLE AS y0, (y0 + 2)::DOUBLE AS y1, 100.0::DOUBLE AS page_height, font::DOUBLE AS font, false AS bold FROM (
 SELECT doc_id, ln, page, 0 AS sub, 'Corpus ' || source || ' - Page ' || page AS text, 3 AS y0, 9 AS font FROM ({_PG}) WHERE slot = 0
 UNION ALL SELECT doc_id, ln, page, 1, {_HEAD}, 15, 14 FROM ({_PG}) WHERE slot = 0 UNION ALL SELECT doc_id, ln, page, 2, body, 50, 10 FROM ({_PG})
 UNION ALL SELECT doc_id, ln, page, 3, page::VARCHAR, 95, 9 FROM ({_PG}) WHERE slot = {PAGE_LINES - 1})"""

_BODY = lambda src: f"""SELECT doc_key, coalesce(size, 10.0) AS body_size FROM (SELECT DISTINCT doc_key FROM {src}) LEFT JOIN (SELECT doc_key, size FROM (
 SELECT doc_key, size, row_number() OVER (PARTITION BY doc_key ORDER BY n DESC, f) AS r FROM (SELECT doc_key, round(font, 1) AS size, count(*) AS n, min(line_no) AS f FROM {src}
 WHERE font > 0 AND {D.count_rx('text', chr(92) + 'S+')} >= 3 GROUP BY ALL)) WHERE r = 1) USING (doc_key)"""  # noqa: E731
_DECO = D.rsub(D.squash(D.rsub("lower(text)", r"\bpage\s+[0-9]+(?:\s+of\s+[0-9]+)?\b", "page #")), r"^[ \-|\t]+|[ \-|\t]+$")
_REP = f"""SELECT doc_key, deco FROM (SELECT doc_key, {_DECO} AS deco, count(DISTINCT page) AS seen FROM lines WHERE y0/page_height <= 0.12 OR y1/page_height >= 0.88 GROUP BY ALL)
 JOIN (SELECT doc_key, count(DISTINCT page) AS pages FROM lines GROUP BY doc_key) USING (doc_key) WHERE deco <> '' AND length(deco) <= 160 AND pages >= 3 AND seen >= greatest(3, ceil(pages * 0.5))"""
_CONTENT = f"SELECT * FROM lines l WHERE NOT {D.rx('text', S.PAGE_NUMBER)} AND NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc_key = l.doc_key AND r.deco = {_DECO})"
_PROM = "(length(text) <= 140 AND (font >= body_size * 1.20 OR (bold AND font >= body_size * 1.03)))"
_LOOSE = (f"({D.count_rx('t', chr(92) + 'S+')} <= 16 AND NOT {D.rx('t', '[.?!;]$')} AND ((nl > 0 AND nu / nl >= 0.70) OR {D.rx('lower(t)', '^(' + S.HEADING_TERMS + ')')} "
          f"OR (nt >= greatest(1, ceil({D.count_rx('t', chr(92) + 'S+')} * 0.6)) AND nl > 0)))")
_CLASS = f"""SELECT *, CASE WHEN t = '' OR length(t) > 180 OR NOT {_PROM} THEN NULL WHEN {D.rx('t', S.RULE_HEADING)} THEN 'rule' WHEN {D.rx('t', S.DIRECTIVE_HEADING)} THEN 'directive'
 WHEN {D.rx('t', S.NAMED_HEADING)} OR {D.rx('t', S.NUMBERED_HEADING)} OR {_LOOSE} THEN 'section' END AS htype FROM (
 SELECT c.*, body_size, trim(text) AS t, {D.count_rx('text', chr(92) + 'p{L}')} AS nl, {D.count_rx('text', chr(92) + 'p{Lu}')} AS nu, {D.count_rx('trim(text)', '(?:^|' + chr(92) + 's)[' + chr(92) + 'p{Lu}0-9]')} AS nt
 FROM content c JOIN body USING (doc_key))"""
_IDS = f"""SELECT *, CASE htype WHEN 'rule' THEN regexp_extract(t, {D.lit(S.RULE_HEADING)}, 1) WHEN 'directive' THEN regexp_extract(t, {D.lit(S.DIRECTIVE_HEADING)}, 1) WHEN 'section' THEN '' END AS rule_id,
 CASE WHEN htype = 'section' THEN CASE WHEN {D.rx('t', S.NAMED_HEADING)} THEN regexp_extract(t, {D.lit(S.NAMED_HEADING)}, 1) WHEN {D.rx('t', S.NUMBERED_HEADING)} THEN regexp_extract(t, {D.lit(S.NUMBERED_HEADING)}, 1) ELSE '' END
 WHEN htype IS NOT NULL THEN '' END AS section_id FROM ({_CLASS})"""
_LW = f"WITH lines AS MATERIALIZED ({LINES_SQL}), rep AS MATERIALIZED ({_REP}), content AS MATERIALIZED ({_CONTENT}), body AS ({_BODY('content')}), cls AS MATERIALIZED ({_IDS})"
_BEFORE = "(PARTITION BY doc_key ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SEC = f""", s1 AS (SELECT *, last_value(CASE WHEN htype IN ('rule','directive') OR rule_id <> '' OR section_id <> '' THEN struct_pack(at := line_no, ty := htype) END IGNORE NULLS) OVER {_BEFORE} AS strong,
  last_value(CASE WHEN regexp_matches(text, '(?i)^\\s*Category\\s*$') THEN line_no END IGNORE NULLS) OVER {_BEFORE} AS cat, lag(page) OVER (PARTITION BY doc_key ORDER BY line_no) AS pp FROM cls),
 s2 AS (SELECT *, htype IS NOT NULL AND NOT (htype = 'section' AND section_id = '' AND coalesce(strong.ty IN ('rule','directive'), false) AND coalesce(cat < strong.at, true)) AS opens FROM s1),
 s3 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_key ORDER BY line_no) AS n_open FROM s2),
 s4 AS (SELECT *, opens OR (n_open = 0 AND (pp IS NULL OR pp <> page)) AS begins FROM s3),
 s5 AS (SELECT *, last_value(CASE WHEN begins THEN struct_pack(st := line_no, ty := CASE WHEN opens THEN htype ELSE 'background' END, rid := CASE WHEN opens THEN rule_id ELSE '' END, sid := CASE WHEN opens THEN section_id ELSE '' END,
  ti := CASE WHEN opens THEN text ELSE '' END) END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY line_no) AS sec FROM s4),
 secs AS MATERIALIZED (SELECT * FROM (SELECT doc_key, sec.st AS start, sec.ty AS section_type, sec.rid AS rule_id, sec.sid AS section_id, sec.ti AS section_title, min(page) AS page_start, max(page) AS page_end,
  regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS text FROM s5 GROUP BY ALL) WHERE text <> '')"""


@query("body_font_size", f"WITH lines AS ({LINES_SQL}) {_BODY('lines')}")
def _(spark, sf):
    return S.body_font_size(layout_lines(spark, sf))


@query("repeated_decorations", f"WITH lines AS ({LINES_SQL}) {_REP}")
def _(spark, sf):
    return S.repeated_decorations(layout_lines(spark, sf))


@query("drop_decorations", _LW + " SELECT doc_key, line_no, text FROM content")
def _(spark, sf):
    return S.drop_decorations(layout_lines(spark, sf)).select("doc_key", "line_no", "text")


@query("classify_heading", _LW + " SELECT doc_key, line_no, htype, rule_id, section_id FROM cls WHERE htype IS NOT NULL")
def _(spark, sf):
    h = S.headings(layout_lines(spark, sf)).where("heading IS NOT NULL")
    return h.select("doc_key", "line_no", F.col("heading.type").alias("htype"), "heading.rule_id", "heading.section_id")


@query("assign_sections", _LW + _SEC + " SELECT * FROM secs")
def _(spark, sf):
    return S.sections(layout_lines(spark, sf))


def see_also_texts(spark, sf):
    """Documents whose second line break carries a See-also line."""
    return X.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"^([^\n]*\n[^\n]*)\n", "$1\n  See also \n").alias("text"))


_SA = r"(?im)^\s*see\s+also\s*$"


@query(
    "split_see_also",
    f"""SELECT doc_id, CASE WHEN i > 0 THEN regexp_replace(left(t, i - 1), '^\\s+|\\s+$', '', 'g') ELSE t END AS main_text,
 CASE WHEN i = 0 THEN '' WHEN a <> '' THEN 'See also' || chr(10) || a ELSE 'See also' END AS cross_text FROM (SELECT *, CASE WHEN i > 0 THEN regexp_replace(substr(t, i + length(regexp_extract(t, {D.lit(_SA)}))), '^\\s+|\\s+$', '', 'g') ELSE '' END AS a FROM (
 SELECT doc_id, t, CASE WHEN {D.rx('t', _SA)} THEN length(string_split_regex(t, {D.lit(_SA)})[1]) + 1 ELSE 0 END AS i FROM (SELECT doc_id, trim(regexp_replace(text, '^([^\\n]*\\n[^\\n]*)\\n', '\\1' || chr(10) || '  See also ' || chr(10))) AS t FROM documents)))""",
)
def _(spark, sf):
    d = see_also_texts(spark, sf).withColumn("c", S.split_see_also(F.col("text")))
    return d.select("doc_id", F.col("c.main").alias("main_text"), F.col("c.cross").alias("cross_text"))


_ROLE = "CASE lower(trim(section_title)) " + " ".join(f"WHEN {D.lit(k)} THEN {D.lit(v)}" for k, v in S.ROLE_BY_TITLE.items()) + " ELSE '' END"
_UNITS = f""", u1 AS (SELECT *, {_ROLE} AS role, section_type IN ('rule','directive') AS is_rule FROM secs),
 u2 AS (SELECT *, last_value(CASE WHEN is_rule THEN struct_pack(ty := section_type, id := rule_id, ti := trim(section_title)) WHEN role = '' THEN struct_pack(ty := '', id := '', ti := '') END IGNORE NULLS) OVER (PARTITION BY doc_key ORDER BY start) AS par FROM u1)"""


@query(
    "inherit_parent",
    _LW + _SEC + _UNITS + """ SELECT doc_key, start, CASE WHEN is_rule THEN 'requirement' WHEN role = '' THEN 'document_section' ELSE role END AS section_role, coalesce(par.ty, '') AS parent_type,
 coalesce(par.id, '') AS parent_identifier, coalesce(par.ti, '') AS parent_title FROM u2""",
)
def _(spark, sf):
    u = S.inherit_parent(S.sections(layout_lines(spark, sf)))
    return u.select("doc_key", "start", "section_role", "parent_type", "parent_identifier", "parent_title")


@query(
    "anchor_text",
    _LW + _SEC + _UNITS + """ SELECT doc_key, start, CASE WHEN is_rule OR role = '' OR coalesce(par.ti, '') = '' OR starts_with(lower(trim(text)), lower(par.ti)) THEN trim(text) ELSE par.ti || chr(10) || trim(text) END AS text FROM u2""",
)
def _(spark, sf):
    return S.inherit_parent(S.sections(layout_lines(spark, sf))).select("doc_key", "start", "text")


_WIN = """SELECT doc_id, source, part, count(*) OVER (PARTITION BY doc_id) AS parts, array_to_string(w[b[s + 1] + 1 : b[e + 1]], ' ') AS chunk_text FROM (
 WITH RECURSIVE sen AS (SELECT doc_id, source, string_split(t_, ' ') AS w, flatten(list_transform(list_transform(string_split(regexp_replace(t_, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(string_split(x, ' '))),
   lambda m: list_transform(range(((m + 899) // 900)::BIGINT), lambda k: least(900, m - 900 * k)))) AS m FROM (SELECT doc_id, source, {t} AS t_ FROM {src}) WHERE t_ IS NOT NULL),
 cum AS (SELECT doc_id, source, w, list_prepend(0, list_transform(range(1, len(m) + 1), lambda i: list_sum(m[1:i])::BIGINT)) AS b FROM sen),
 walk AS (SELECT *, 0::BIGINT AS part, 0::BIGINT AS s, len(list_filter(b, lambda x: x <= 900)) - 1 AS e FROM cum
  UNION ALL SELECT doc_id, source, w, b, part, s, len(list_filter(b, lambda x: x - b[s + 1] <= 900)) - 1 AS e FROM (
   SELECT doc_id, source, w, b, part + 1 AS part, len(list_filter(b, lambda x: x < greatest(b[e + 1] - 150, b[e + 2] - 900))) AS s FROM walk WHERE e + 1 < len(b)))
 SELECT * FROM walk)"""
_WIN1 = _WIN.format(t=D.squash("text"), src="documents")
_CHUNKT = "chunk_text"


@query("window_chunks", f"SELECT doc_id, part, parts, {_CHUNKT} AS chunk_text FROM ({_WIN1})")
def _(spark, sf):
    return S.window_chunks(X.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "part", "parts", "chunk_text")


@query(
    "number_chunks",
    f"SELECT doc_id, source, part, parts, row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1 AS chunk_id, count(*) OVER (PARTITION BY source) AS total_chunks FROM ({_WIN1})",
)
def _(spark, sf):
    w = S.window_chunks(X.table(spark, sf, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "part", "parts")
    return S.number_chunks(w, "source", "doc_id", "part")


_SKIP = f"CASE WHEN length({_CLEAN}) = 0 THEN 'empty document' WHEN length({_CLEAN}) < 50 THEN 'text too short: ' || length({_CLEAN}) END"


@query("min_length_gate", f"SELECT doc_id, {_SKIP} AS skip_reason FROM documents")
def _(spark, sf):
    return S.min_length_gate(X.table(spark, sf, "documents"), "text").select("doc_id", "skip_reason")


_WIN2 = _WIN.format(t=D.squash("c"), src=f"(SELECT doc_id, source, {_CLEAN} AS c FROM documents WHERE {_SKIP} IS NULL)")


@query(
    "ingest_corpus",
    f"SELECT doc_id, source, part, parts, {_CHUNKT} AS chunk_text, row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1 AS chunk_id, count(*) OVER (PARTITION BY source) AS total_chunks FROM ({_WIN2})",
)
def _(spark, sf):
    return S.ingest_corpus(X.table(spark, sf, "documents").select("doc_id", "source", "text"))


@query(
    "prepared_cache",
    """SELECT n.doc_id, n.hash, CASE WHEN c.hash IS NOT NULL THEN 'reuse' ELSE 'prepare' END AS action FROM (SELECT doc_id, sha256(text) AS hash FROM documents) n
 LEFT JOIN (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id) WHERE lang <> 'fr') c USING (hash)""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("hash", T.content_hash("text"))
    schema = F.when(F.col("lang") == "fr", "v3").otherwise("v4").alias("schema")
    cache = d.join(X.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("hash", schema)
    return S.prepared_cache(d.select("doc_id", "hash"), cache, "v4").select("doc_id", "hash", "action")


@query(
    "prune_cache",
    """SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("hash", T.content_hash("text"))
    labelled = d.join(X.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return S.prune_cache(d.select("hash").distinct(), labelled)


_LBL = lambda x: f"(length({x}) <= 70 AND len(string_split({x}, ' ')) BETWEEN 1 AND 8 AND NOT regexp_matches({x}, '[.!?;]$'))"
LABELLED_SQL = "SELECT doc_id, regexp_replace(text, '[.][\\n ]([^ \\n]+ [^ \\n]+)[.]', chr(10) || '\\1:' || chr(10), 'g') AS text FROM documents"


def labelled_texts(spark, sf):
    """Documents in which two-word sentences became label lines."""
    return X.table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace("text", r"[.][\n ]([^ \n]+ [^ \n]+)[.]", "\n$1:\n").alias("text"))


@query(
    "label_value_pairs",
    f"""SELECT doc_id, (i - 1)::BIGINT AS line_no, regexp_replace(l, '\\s*:\\s*$', '') AS label, v AS value FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i, unnest(list_concat(ls[2:], [NULL])) AS v FROM (
 SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {D.squash('x')}), lambda x: x <> '') AS ls FROM ({LABELLED_SQL}))) WHERE {_LBL('l')} AND v IS NOT NULL AND len(string_split(v, ' ')) >= 4 AND NOT {_LBL('v')}""",
)
def _(spark, sf):
    return S.label_value_pairs(labelled_texts(spark, sf), "doc_id", "text")
