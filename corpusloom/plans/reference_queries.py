"""Structured-reference queries over a standards table derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import references as R
from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.operators import lexical as L
from corpusloom.operators import refs as H
from corpusloom.operators import vectors as VX
from corpusloom.operators.scale import block_row_number, top_k_per
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.lexical_queries import coverage_sql
from corpusloom.plans.question_queries import _Q, references_sql
from corpusloom.plans.registry import query
from corpusloom.plans.vector_queries import pair_score_sql


def standards(spark, sf):
    """Every part is a rule of the standard part its size names, with role chunks by type, plus one section per size."""
    p = X.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("bigint").alias("major"))
    p = block_row_number(p, ["major"], "p_partkey", "minor")
    cat = F.when(F.col("p_type").isin("MEDIUM", "SMALL"), "Mandatory").when(F.col("p_type").isin("STANDARD", "LARGE"), "Required").otherwise("Advisory")
    p = p.withColumns({"category": cat, "rule_id": F.concat_ws(".", "major", "minor")})
    c = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    name, ty, brand, major = F.col("p_name"), F.lower("p_type"), F.col("p_brand"), F.col("major")
    row = lambda no, role, title, text, cond: F.when(cond, F.struct(F.lit(no).alias("no"), F.lit(role).alias("role"), title.alias("title"), text.alias("text")))
    label = c("Rule ", F.col("rule_id"))
    rows = F.array_compact(F.array(
        row(0, "requirement", label, c(label, "\n", name, " in ", ty, " form needs ", brand, "\nCategory\n", F.col("category")), F.lit(True)),
        row(1, "rationale", F.lit("Rationale"), c("Rationale\nThe ", name, " is unsafe. See Section ", major, "."), F.lit(True)),
        row(2, "example", F.lit("Example"), c("Example\n", name, " used by ", brand), F.col("p_type").isin("ECONOMY", "PROMO", "LARGE")),
        row(3, "exception", F.lit("Exception"), c("Exception\nNo ", ty, " ", name), F.col("p_type").isin("PROMO", "SMALL")),
        row(4, "cross_reference", F.lit("See also"), c("See also\nRule ", major, ".1, Rule ", major + 1, ".999"), F.col("p_type") == "PROMO"),
    ))
    r = p.select("major", "minor", "rule_id", "category", F.explode(rows).alias("x")).select(
        "major", "minor", F.lit("rule").alias("section_type"), "rule_id", F.lit("").alias("section_id"), "category", "x.no", F.col("x.role").alias("section_role"), F.col("x.title").alias("section_title"), "x.text")
    s = p.select("major").distinct().select(
        "major", F.lit(0).cast("bigint").alias("minor"), F.lit("section").alias("section_type"), F.lit("").alias("rule_id"), major.cast("string").alias("section_id"), F.lit(None).cast("string").alias("category"),
        F.lit(0).alias("no"), F.lit("document_section").alias("section_role"), c("Guidelines for group ", major).alias("section_title"), c("Section ", major, "\nGuidelines for group ", major, "\nAll parts of size ", major).alias("text"))
    u = r.unionByName(s).withColumns({"file_key": c("std_", major), "pos": F.col("minor") * 8 + F.col("no")})
    u = block_row_number(u, ["file_key"], "pos", "rn").withColumn("chunk_id", F.col("rn") - 1)
    return u.withColumn("chunk_key", F.concat_ws("::", "file_key", "chunk_id")).drop("pos", "no", "rn")


_P = """SELECT p_name, p_brand, p_type, p_size::BIGINT AS major, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS minor,
 CASE WHEN p_type IN ('MEDIUM','SMALL') THEN 'Mandatory' WHEN p_type IN ('STANDARD','LARGE') THEN 'Required' ELSE 'Advisory' END AS category FROM part"""
_P = f"SELECT *, major || '.' || minor AS rule_id FROM ({_P})"
_R = lambda no, role, title, text, cond: f"SELECT major, minor, 'rule' AS section_type, rule_id, '' AS section_id, category, {no} AS no, '{role}' AS section_role, {title} AS section_title, {text} AS text FROM p WHERE {cond}"
_NL = "chr(10)"
STD_SQL = f"""WITH p AS MATERIALIZED ({_P}), r AS (
 {_R(0, 'requirement', "'Rule ' || rule_id", f"'Rule ' || rule_id || {_NL} || p_name || ' in ' || lower(p_type) || ' form needs ' || p_brand || {_NL} || 'Category' || {_NL} || category", 'true')}
 UNION ALL {_R(1, 'rationale', "'Rationale'", f"'Rationale' || {_NL} || 'The ' || p_name || ' is unsafe. See Section ' || major || '.'", 'true')}
 UNION ALL {_R(2, 'example', "'Example'", f"'Example' || {_NL} || p_name || ' used by ' || p_brand", "p_type IN ('ECONOMY','PROMO','LARGE')")}
 UNION ALL {_R(3, 'exception', "'Exception'", f"'Exception' || {_NL} || 'No ' || lower(p_type) || ' ' || p_name", "p_type IN ('PROMO','SMALL')")}
 UNION ALL {_R(4, 'cross_reference', "'See also'", f"'See also' || {_NL} || 'Rule ' || major || '.1, Rule ' || (major + 1) || '.999'", "p_type = 'PROMO'")}
 UNION ALL SELECT DISTINCT major, 0, 'section', '', major::VARCHAR, NULL, 0, 'document_section', 'Guidelines for group ' || major, 'Section ' || major || {_NL} || 'Guidelines for group ' || major || {_NL} || 'All parts of size ' || major FROM p)
 SELECT *, file_key || '::' || chunk_id AS chunk_key FROM (SELECT *, 'std_' || major AS file_key, row_number() OVER (PARTITION BY major ORDER BY minor * 8 + no) - 1 AS chunk_id FROM r)"""


def refs_of(spark, sf):
    return R.explode_references(X.questions(spark, sf), "question_id", "question")


_W = f"WITH std AS MATERIALIZED ({STD_SQL}), refs AS MATERIALIZED ({references_sql(_Q, 'question_id', 'question')})"
_SEED = """, seed AS MATERIALIZED (SELECT * FROM (SELECT r.question_id, r.ref_no, CASE WHEN r.kind IN ('section','article','chapter','part') THEN 'section' ELSE r.kind END AS kind, r.identifier, s.file_key, s.chunk_id, s.chunk_key,
 row_number() OVER (PARTITION BY question_id, ref_no, file_key ORDER BY chunk_id) AS rn FROM refs r JOIN std s ON s.section_role IN ('requirement','document_section')
 AND s.section_type = CASE WHEN r.kind IN ('section','article','chapter','part') THEN 'section' ELSE r.kind END AND r.identifier = CASE WHEN s.section_type = 'section' THEN s.section_id ELSE s.rule_id END) WHERE rn = 1)"""
_GRP = """, grp AS MATERIALIZED (SELECT *, last_value(CASE WHEN section_role IN ('requirement','document_section') THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY file_key ORDER BY chunk_id) AS gs FROM std),
 mem AS MATERIALIZED (SELECT s.question_id, s.ref_no, s.kind, s.identifier, s.file_key, g.chunk_id, g.chunk_key, g.section_role, g.text, row_number() OVER (PARTITION BY question_id, ref_no, s.file_key ORDER BY g.chunk_id) AS pos
 FROM seed s JOIN grp g ON g.file_key = s.file_key AND g.gs = s.chunk_id)"""


def seeds(spark, sf):
    return H.exact_reference(refs_of(spark, sf), standards(spark, sf))


@query("rule_sort_key", _W + " SELECT chunk_key, lpad(split_part(rule_id, '.', 1), 20, '0') || '.' || lpad(split_part(rule_id, '.', 2), 20, '0') AS sort_key FROM std WHERE section_role = 'requirement'")
def _(spark, sf):
    return standards(spark, sf).where(H.BODY).select("chunk_key", H.rule_sort_key(F.col("rule_id")).alias("sort_key"))


@query(
    "compress_ids",
    _W + """ SELECT major, CASE WHEN sum(n) = 1 THEN 'Rule ' ELSE 'Rules ' END || string_agg(CASE WHEN lo = hi THEN major || '.' || lo ELSE major || '.' || lo || '–' || major || '.' || hi END, ', ' ORDER BY lo) AS label FROM (
 SELECT major, min(minor) AS lo, max(minor) AS hi, count(*) AS n FROM (SELECT major, minor, minor - row_number() OVER (PARTITION BY major ORDER BY minor) AS isl FROM std WHERE section_role = 'requirement' AND category <> 'Advisory') GROUP BY major, isl) GROUP BY major""",
)
def _(spark, sf):
    return H.compress_ids(standards(spark, sf).where(H.BODY).where("category <> 'Advisory'"))


_STMT = "trim(regexp_replace(regexp_replace(regexp_replace(text, '^[^\\n]*\\n?', ''), '(?is)(?:^|\\n)[ \\t]*(?:category|analysis|applies to|amplification|rationale|exceptions?|examples?|see also)\\b.*$', ''), '\\s+', ' ', 'g'))"


@query("requirement_statement", _W + f" SELECT chunk_key, {_STMT} AS statement FROM std WHERE section_role = 'requirement'")
def _(spark, sf):
    return standards(spark, sf).where(H.BODY).select("chunk_key", R.requirement_statement(F.col("text")).alias("statement"))


@query("labeled_block", _W + " SELECT chunk_key, coalesce(category, '') AS block FROM std WHERE section_role = 'requirement'")
def _(spark, sf):
    return standards(spark, sf).where(H.BODY).select("chunk_key", R.labeled_block(F.col("text"), "category").alias("block"))


@query("exact_reference", _W + _SEED + " SELECT question_id, ref_no, kind, identifier, chunk_key FROM seed")
def _(spark, sf):
    return seeds(spark, sf).select("question_id", "ref_no", "kind", "identifier", "chunk_key")


@query("reference_group", _W + _SEED + _GRP + " SELECT question_id, ref_no, chunk_key, pos FROM mem WHERE pos <= 8")
def _(spark, sf):
    return H.reference_group(seeds(spark, sf), standards(spark, sf)).select("question_id", "ref_no", "chunk_key", F.col("pos").cast("bigint"))


@query(
    "merge_group",
    _W + _SEED + _GRP + """ SELECT question_id, ref_no, file_key, string_agg(text, chr(10) || chr(10) ORDER BY p) AS text, min(lo) AS first_chunk, max(hi) AS last_chunk FROM (
 SELECT question_id, ref_no, file_key, text, min(pos) AS p, min(chunk_id) AS lo, max(chunk_id) AS hi FROM mem WHERE pos <= 8 GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, sf):
    m = H.merge_group(H.reference_group(seeds(spark, sf), standards(spark, sf)))
    return m.select("question_id", "ref_no", "file_key", "text", "first_chunk", "last_chunk")


@query(
    "reference_consistency",
    _W + """ SELECT question_id, ref_no, chunk_key FROM refs r JOIN std s ON s.major = split_part(identifier, '.', 1)::BIGINT WHERE kind = 'rule' AND (rule_id = identifier OR (starts_with(lower(text), kind || ' ' || identifier)
 AND NOT regexp_matches(substr(text, length(kind || ' ' || identifier) + 1, 1), '[0-9.]')))""",
)
def _(spark, sf):
    r = refs_of(spark, sf).where("kind = 'rule'").withColumn("major", F.substring_index("identifier", ".", 1).cast("bigint"))
    return H.consistent_references(r, standards(spark, sf)).select("question_id", "ref_no", "chunk_key")


@query(
    "compare_references",
    _W + _SEED + _GRP + """ SELECT DISTINCT m.question_id, m.file_key, m.kind, m.identifier, m.chunk_key FROM mem m JOIN (SELECT question_id FROM refs WHERE kind IN ('rule','directive') GROUP BY 1 HAVING count(*) >= 2) USING (question_id) WHERE m.kind IN ('rule','directive') AND pos <= 8""",
)
def _(spark, sf):
    r = refs_of(spark, sf).where("kind IN ('rule', 'directive')")
    many = r.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("question_id")
    s = H.exact_reference(r.join(many, "question_id", "left_semi"), standards(spark, sf))
    g = H.reference_group(s, standards(spark, sf))
    return g.select("question_id", "file_key", "kind", "identifier", "chunk_key").distinct()


@query(
    "unknown_reference_stop",
    _W + " SELECT question_id, ref_no, kind, identifier, CASE WHEN EXISTS (SELECT 1 FROM std s WHERE section_role = 'requirement' AND s.section_type = kind AND s.rule_id = identifier) THEN 'found' ELSE 'unknown' END AS status FROM refs WHERE kind IN ('rule','directive')",
)
def _(spark, sf):
    return H.unknown_reference_stop(refs_of(spark, sf), standards(spark, sf))


@query(
    "major_family",
    _W + " SELECT major, rule_id, row_number() OVER (PARTITION BY major ORDER BY minor) AS pos, count(*) OVER (PARTITION BY major) AS members FROM std WHERE section_role = 'requirement'",
)
def _(spark, sf):
    s = standards(spark, sf)
    return H.major_family(s.select("major").distinct(), s).select("major", "rule_id", "pos", "members")


_CS = lambda x: f"list_distinct(list_transform(list_filter(string_split({D.norm(x)}, ' '), lambda t_: length(t_) >= 3 AND t_ NOT IN {D.words(H.CATALOG_NOISE)}), lambda t_: {D.catalog_stem('t_')}))"


def page_titles(spark, sf):
    return X.table(spark, sf, "pages").select(F.col("page_id").alias("section_key"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query(
    "section_title_match",
    f"""WITH q AS (SELECT page_id AS question_id, {_CS("'which section covers ' || t")} AS qs FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS t FROM pages)), s AS (SELECT page_id AS section_key, {_CS("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS ts FROM pages),
 g AS (SELECT question_id, section_key, len(list_intersect(qs, ts)) AS n, len(qs) AS nq, len(ts) AS nt FROM q, s),
 c AS (SELECT *, 2 * (n / nq) + 1.5 * (n / nt) + 0.1 * n AS score FROM g WHERE n >= 2 AND n / nq >= 0.70 AND n / nt >= 0.55),
 r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx FROM c WINDOW w AS (PARTITION BY question_id ORDER BY round(score, 9) DESC, section_key))
 SELECT question_id, section_key, round(score::DOUBLE, 6) AS score FROM r WHERE rn = 1 AND (nx IS NULL OR score - nx >= 0.15)""",
)
def _(spark, sf):
    h1 = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    q = X.table(spark, sf, "pages").select(F.col("page_id").alias("question_id"), F.concat(F.lit("which section covers "), h1).alias("question"))
    return H.section_title_match(q, page_titles(spark, sf)).withColumn("score", F.round("score", 6))


def catalog_questions(spark, sf):
    p = X.table(spark, sf, "part")
    a = p.select(F.concat(F.lit("List the rules about "), "p_name").alias("question"))
    b = p.select(F.concat(F.lit("List all "), F.when(F.col("p_type").isin("MEDIUM", "SMALL"), "mandatory").otherwise("advisory"), F.lit(" rules")).alias("question"))
    return a.unionByName(b).distinct().select(F.col("question").alias("question_id"), "question")


_CQ = """SELECT DISTINCT question AS question_id, question FROM (SELECT 'List the rules about ' || p_name AS question FROM part UNION ALL SELECT 'List all ' || CASE WHEN p_type IN ('MEDIUM','SMALL') THEN 'mandatory' ELSE 'advisory' END || ' rules' FROM part)"""
_SST = f"list_distinct(list_transform(string_split({D.norm(_STMT)}, ' '), lambda t_: {D.catalog_stem('t_')}))"


@query(
    "rule_catalog",
    _W + f""", q AS (SELECT question_id, CASE WHEN lower(question) LIKE '%mandatory%' THEN 'Mandatory' WHEN lower(question) LIKE '%advisory%' THEN 'Advisory' END AS asked, list_filter({_CS('question')}, lambda x: x NOT IN ('mandatory','required','requir','advisory')) AS st FROM ({_CQ})),
 b AS (SELECT chunk_key, rule_id, category, {_SST} AS ss FROM std WHERE section_role = 'requirement'),
 u AS (SELECT question_id, chunk_key, rule_id, 1 AS branch FROM q JOIN b ON asked = category UNION ALL SELECT question_id, chunk_key, rule_id, CASE WHEN len(st) >= 2 THEN 2 ELSE 3 END FROM q JOIN b ON len(st) > 0 AND list_has_all(ss, st))
 SELECT question_id, branch, rule_id, chunk_key FROM u JOIN (SELECT question_id, min(branch) AS branch FROM u GROUP BY 1) USING (question_id, branch)""",
)
def _(spark, sf):
    return H.rule_catalog(catalog_questions(spark, sf), standards(spark, sf))


@query(
    "topic_family",
    _W + """ SELECT topic, major, id, quality, chunk_key FROM (SELECT 'group ' || major AS topic, major, id, quality, chunk_key, row_number() OVER (PARTITION BY id ORDER BY quality DESC, chunk_key) AS r FROM (
 SELECT major, rule_id AS id, 2 AS quality, chunk_key FROM std WHERE section_role = 'requirement' UNION ALL
 SELECT split_part(h, '.', 1)::BIGINT, h, 1, chunk_key FROM (SELECT *, regexp_extract(text, '^(?:Rule|Dir(?:ective)?)\\s+([0-9]+(?:\\.[0-9]+)+)', 1) AS h FROM std) WHERE h <> '')) WHERE r = 1""",
)
def _(spark, sf):
    s = standards(spark, sf)
    topics = s.select("major").distinct().select(F.concat(F.lit("group "), "major").alias("topic"), "major")
    return H.topic_family(topics, s)


@query(
    "summary_recovery",
    _W + """ SELECT rule_id, min(chunk_key) AS chunk_key, count(*) AS mentions FROM (SELECT chunk_key, unnest(regexp_extract_all(text, 'Rule ([0-9]+\\.[0-9]+)', 1)) AS rule_id FROM std WHERE section_role IN ('cross_reference','document_section'))
 WHERE rule_id NOT IN (SELECT rule_id FROM std WHERE section_role = 'requirement') GROUP BY 1""",
)
def _(spark, sf):
    return H.summary_recovery(standards(spark, sf))


@query("cache_recovery", _W + " SELECT rule_id, chunk_key FROM std WHERE section_role = 'requirement' AND category = 'Advisory'")
def _(spark, sf):
    """Advisory rules were left out of the index and come back from the prepared cache."""
    s = standards(spark, sf).where("rule_id <> ''")
    return H.cache_recovery(s, s.where(H.BODY).where("category <> 'Advisory'"))


@query(
    "follow_cross_refs",
    _W + " SELECT a.chunk_key, a.major::VARCHAR AS identifier, b.chunk_key AS section_key FROM std a JOIN std b ON b.section_role = 'document_section' AND b.major = a.major WHERE a.section_role = 'rationale'",
)
def _(spark, sf):
    s = standards(spark, sf)
    return H.follow_cross_refs(s.where("section_role = 'rationale'"), s).select("chunk_key", "identifier", "section_key")


@query(
    "rationale_follow",
    _W + " SELECT a.rule_id, 'The ' || p_name || ' is unsafe.' AS first_sentence, b.text AS section_text FROM (SELECT s.*, regexp_extract(text, 'The (.*) is unsafe', 1) AS p_name FROM std s WHERE section_role = 'rationale') a JOIN std b ON b.section_role = 'document_section' AND b.major = a.major",
)
def _(spark, sf):
    s = standards(spark, sf)
    r = s.where("section_role = 'rationale'").withColumn("body", F.regexp_replace("text", r"^Rationale\n", ""))
    f = H.follow_cross_refs(r, s).select("chunk_key", "section_text")
    sentence = F.get(F.split("body", r"(?<=[.!?])\s"), F.lit(0))
    return r.join(f, "chunk_key").select("rule_id", sentence.alias("first_sentence"), "section_text")


@query("attach_details", _W + _SEED + _GRP + " SELECT question_id, ref_no, chunk_key, section_role FROM mem WHERE section_role IN ('rationale','amplification','example','exception','note')")
def _(spark, sf):
    return H.attach_details(seeds(spark, sf), standards(spark, sf)).select("question_id", "ref_no", "chunk_key", "section_role")


@query(
    "named_anchors",
    _W + _SEED + _GRP + " SELECT question_id, identifier, chunk_key, section_role FROM mem WHERE section_role IN ('requirement','rationale','amplification','example','exception','note') AND kind = 'rule'",
)
def _(spark, sf):
    g = H.reference_group(seeds(spark, sf).where("kind = 'rule'"), standards(spark, sf), 1 << 30)
    return g.where(F.col("section_role").isin("requirement", *H.DETAIL_ROLES)).select("question_id", "identifier", "chunk_key", "section_role")


@query(
    "standard_family_gate",
    _W + _SEED + _GRP + """ SELECT q.question_id, q.asked, coalesce(max((m.text ILIKE '%' || q.asked || '%')::INT), 0) = 1 AS supported FROM (SELECT question_id, CASE WHEN lower(question) LIKE '%misra%' THEN 'misra' WHEN regexp_matches(lower(question), '\\brule\\b|\\brules\\b') THEN 'rule' END AS asked FROM """
    + _Q + """) q LEFT JOIN mem m USING (question_id) WHERE asked IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    low = F.lower("question")
    q = X.questions(spark, sf).select("question_id", F.when(low.contains("misra"), "misra").when(low.rlike(r"\brules?\b"), "rule").alias("asked")).where("asked IS NOT NULL")
    g = H.reference_group(seeds(spark, sf), standards(spark, sf), 1 << 30).select("question_id", "text")
    hit = F.lower("text").contains(F.col("asked")).cast("int")
    return q.join(g, "question_id", "left").groupBy("question_id", "asked").agg((F.coalesce(F.max(hit), F.lit(0)) == 1).alias("supported"))


@query("toolchain_section")
def _(spark, sf):
    """Sections whose title names both asked words, best per question, with the chunk that continues them."""
    s = H.with_groups(standards(spark, sf))
    sect = s.where("section_role = 'document_section'").select("major", "file_key", F.col("chunk_id").alias("at"), "section_title")
    q = s.select("major").distinct().select(F.col("major").alias("asked"), F.array(F.lit("guidelines"), F.col("major").cast("string")).alias("ws"))
    j = q.join(sect, F.col("asked") == F.col("major"))
    words = F.split(T.normalize_text("section_title"), " ")
    score = F.when(F.size(F.array_except("ws", words)) == 0, 3).otherwise(0) + F.when(F.size(words) <= 6, 1).otherwise(0)
    best = top_k_per(j.withColumn("score", score), ["asked"], [F.col("score").desc(), F.col("at").asc()], 1, "r")
    return best.select("asked", "file_key", "at", F.col("score").cast("bigint"))


# ---- profiles and resolution -------------------------------------------------------------------------------

_PROF = f"""SELECT 'rule' AS kind, rule_id, file_key, {_STMT} AS requirement_text, 'Rule ' || rule_id || '. Requirement: ' || {_STMT} || coalesce(chr(10) || sup, '') AS profile_text, coalesce(roles, '') AS roles FROM std LEFT JOIN (
 SELECT rule_id, string_agg(upper(left(section_role, 1)) || substr(section_role, 2) || ': ' || regexp_replace(text, '\\s+', ' ', 'g'), chr(10) ORDER BY CASE section_role WHEN 'rationale' THEN 0 WHEN 'exception' THEN 2 ELSE 3 END) AS sup,
 string_agg(section_role, ',' ORDER BY section_role) AS roles FROM std WHERE section_role IN ('rationale','example','exception') GROUP BY rule_id) USING (rule_id) WHERE section_role = 'requirement'"""


@query("rule_profiles", _W + " " + _PROF)
def _(spark, sf):
    return H.rule_profiles(standards(spark, sf))


@query("profile_digest")
def _(spark, sf):
    return H.profile_digest(H.rule_profiles(standards(spark, sf)))


def resolver_questions(spark, sf):
    """One question per distinct part description."""
    p = X.table(spark, sf, "part")
    q = F.concat(F.lit("Is the "), "p_name", F.lit(" allowed in "), F.lower("p_type"), F.lit(" form for "), "p_brand")
    return p.select(q.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")


def cues(spark, sf):
    p = X.table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lit("in"), F.lower("p_type"), F.lit("form")).alias("phrase")).distinct()
    return p.select(F.col("phrase").alias("cue_id"), "phrase")


_CUE = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY round(cov, 9) DESC, matched DESC, len, chunk_key) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cue_id, rule_id ORDER BY round(cov, 9) DESC, matched DESC, len, chunk_key) AS d FROM (
 SELECT cue_id, rule_id, chunk_key, len, matched, CASE WHEN ph THEN 1.0 ELSE matched / n END AS cov FROM (SELECT cue_id, rule_id, chunk_key, length(text) AS len, len(ct) AS n, len(list_intersect(ct, tt)) AS matched, contains(' ' || nt || ' ', ' ' || p || ' ') AS ph FROM (
 SELECT phrase AS cue_id, {D.norm('phrase')} AS p, list_distinct(string_split({D.norm('phrase')}, ' ')) AS ct FROM (SELECT DISTINCT p_name || ' in ' || lower(p_type) || ' form' AS phrase FROM part)),
 (SELECT chunk_key, rule_id, text, {D.norm('text')} AS nt, list_distinct(string_split({D.norm('text')}, ' ')) AS tt FROM std WHERE section_role = 'requirement')) WHERE ph OR (matched >= greatest(2, round(n * 0.6)) AND matched / n >= 0.72))) WHERE d = 1) WHERE rank <= 6"""


@query("phrase_cue_match", _W + f" SELECT cue_id, rule_id, chunk_key, round(cov::DOUBLE, 6) AS coverage, matched, rank FROM ({_CUE})")
def _(spark, sf):
    r = H.phrase_cue_match(cues(spark, sf), standards(spark, sf))
    return r.select("cue_id", "rule_id", "chunk_key", F.round("coverage", 6).alias("coverage"), "matched", F.col("rank").cast("bigint"))


def std_pool(spark, sf):
    """Candidate list per question over all standard chunks."""
    c = standards(spark, sf).select("chunk_key", "text", F.lit("").alias("title"))
    return L.coverage_topk(c, resolver_questions(spark, sf), 20, 0.0).join(
        standards(spark, sf).select("chunk_key", "rule_id", "section_role", F.col("text")), "chunk_key")


@query("role_aware_pool")
def _(spark, sf):
    return H.role_aware_pool(std_pool(spark, sf)).select("query_id", "chunk_key", F.col("pos").cast("bigint"))
