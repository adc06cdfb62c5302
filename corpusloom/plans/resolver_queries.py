"""Questions resolved to rules over several wordings, and what is decided from that."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import intents as I
from corpusloom.operators import refs as H
from corpusloom.operators import resolver as RS
from corpusloom.operators.scale import materialized, top_k_per
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.question_queries import _GATE, _validate_sql
from corpusloom.plans.reference_queries import _PROF, _SST, _W, standards
from corpusloom.plans.registry import query
from corpusloom.plans.vector_queries import pair_score_sql

#: The question about a part, and rewrites as a model would return them, by the number of the part's brand.
QUESTION = ["Is the ", "p_name", " allowed in ", "type", " form for ", "p_brand"]
POLICY = ["policy on ", "p_name", " in ", "type", " form for ", "p_brand"]
ASKED = ["p_brand", " ", "p_name", " ", "type", " requirement"]
UNSAFE = ["p_name", " under rule 99.1"]
DRIFTS = ["restrictions on ", "type", " parts"]
ANSWER = ["Yes, ", "p_name", " is allowed"]
REWRITES = [[POLICY, ASKED], [POLICY, UNSAFE], [POLICY, DRIFTS], [ANSWER, UNSAFE]]
#: A question that its best rule covers by about a half.
BROAD = ["Which ", "type", " approvals cover ", "p_name", " storage and transport by ", "p_brand"]
BROAD_REWRITES = [["storage of ", "p_name", " from ", "p_brand"], ["p_brand", " transport of ", "type", " ", "p_name"]]
_COLUMNS = {"p_name": "p_name", "p_brand": "p_brand", "type": "lower(p_type)"}


def _wording(parts: list[str]):
    return F.concat(*[F.expr(_COLUMNS[p]) if p in _COLUMNS else F.lit(p) for p in parts])


def _wording_sql(parts: list[str]) -> str:
    return " || ".join(_COLUMNS.get(p, D.lit(p)) for p in parts)


def part_questions(spark, sf, form=QUESTION):
    """One question per distinct part description, with its candidate rewrites and its cue phrase."""
    p = X.table(spark, sf, "part").select("p_name", "p_type", "p_brand").distinct()
    number = F.pmod(F.substring("p_brand", 7, 9).cast("int"), F.lit(len(REWRITES)))
    pairs = REWRITES if form is QUESTION else [BROAD_REWRITES] * len(REWRITES)
    rewrites = F.element_at(F.array(*[F.array(*[_wording(w) for w in pair]) for pair in pairs]), number + 1)
    q = _wording(form)
    return p.select(q.alias("query_id"), q.alias("query"), rewrites.alias("candidates"), _wording(["p_name", " in ", "type", " form"]).alias("cue_id"))


def safe_variants(questions):
    """``query_id, variant_no, variant``: checked rewrites of the questions that are worth rewriting."""
    v = questions.where(I.variant_gate(F.col("query"))).select("query_id", F.posexplode(I.validate_variants(F.col("query"), F.col("candidates"))).alias("i", "variant"))
    return v.select("query_id", (F.col("i") + 1).alias("variant_no"), "variant")


def profiles(spark, sf):
    return materialized(H.rule_profiles(materialized(standards(spark, sf))))


def bodies(spark, sf):
    return standards(spark, sf).where(H.BODY).select("rule_id")


def _questions_sql(form=QUESTION) -> str:
    pairs = REWRITES if form is QUESTION else [BROAD_REWRITES]
    q = _wording_sql(form)
    rewrites = "[" + ", ".join("[" + ", ".join(_wording_sql(w) for w in pair) + "]" for pair in pairs) + f"][substr(p_brand, 7)::INT % {len(pairs)} + 1]"
    return f"SELECT {q} AS query_id, {q} AS query, {rewrites} AS candidates, p_name || ' in ' || lower(p_type) || ' form' AS cue_id FROM (SELECT DISTINCT p_name, p_type, p_brand FROM part)"


def _arms_sql(form=QUESTION) -> str:
    gated = f"SELECT query_id AS question_id, query AS question, candidates FROM (SELECT *, query AS question, {D.norm('query')} AS n FROM rq) WHERE {_GATE}"
    return f""", prof AS MATERIALIZED ({_PROF}), rq AS MATERIALIZED ({_questions_sql(form)}), var AS MATERIALIZED ({_validate_sql(gated)}),
 arms AS MATERIALIZED (SELECT query_id, 0 AS arm, {D.squash('query')} AS q FROM rq UNION ALL SELECT question_id, variant_no, variant FROM var),
 ptok AS MATERIALIZED (SELECT rule_id, unnest(list_distinct({D.tokens('profile_text')})) AS token FROM prof),
 idf AS MATERIALIZED (SELECT * FROM (SELECT token, ln(((SELECT count(*) FROM prof) + 1) / (count(*) + 1)) AS idf FROM ptok GROUP BY token) WHERE idf > 0),
 pv AS MATERIALIZED (SELECT rule_id, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY rule_id)) AS w FROM ptok JOIN idf USING (token)),
 atok AS MATERIALIZED (SELECT query_id, arm, token, idf / sqrt(sum(idf * idf) OVER (PARTITION BY query_id, arm)) AS qw FROM (SELECT query_id, arm, unnest(list_distinct({D.tokens('q')})) AS token FROM arms) JOIN idf USING (token)),
 sim AS MATERIALIZED (SELECT query_id, arm, rule_id, sum(qw * w) AS s FROM atok JOIN pv USING (token) GROUP BY ALL)"""


def _pass_sql(t: str, arms: str) -> str:
    """CTEs of one resolution over the arms that ``arms`` keeps: candidates ``cd`` and decisions ``de``."""
    return f""", fu{t} AS MATERIALIZED (SELECT *, lead(sc) OVER (PARTITION BY query_id ORDER BY srank) AS after FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, rule_id) AS srank FROM (
   SELECT query_id, rule_id, s, n, CASE WHEN n = 1 THEN 1 ELSE hits END AS hits, CASE WHEN n = 1 THEN s ELSE rrf / max(rrf) OVER (PARTITION BY query_id) END AS sc, rrf FROM (
    SELECT query_id, rule_id, sum(CASE WHEN r <= {RS.DEPTH} THEN 1::DOUBLE / (60 + r) ELSE 0 END) AS rrf, count(*) FILTER (r <= {RS.DEPTH}) AS hits, max(s) AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY round(s, 9) DESC, rule_id) AS r FROM sim WHERE {arms}) GROUP BY ALL)
   JOIN (SELECT query_id, count(*) AS n FROM arms WHERE {arms} GROUP BY 1) USING (query_id)) WHERE n = 1 OR rrf > 0) WHERE srank <= {RS.SEMANTIC_TOP_K}),
 cd{t} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rescore, 9) DESC, srank) AS prank FROM (
  SELECT f.*, query, profile_text, {pair_score_sql('query', 'profile_text')} AS rescore FROM fu{t} f JOIN rq USING (query_id) JOIN prof USING (rule_id) WHERE srank <= {RS.RESCORE_TOP_K})),
 ag{t} AS (SELECT query_id, max(rule_id) FILTER (prank = 1) AS top_id, max(rescore) FILTER (prank = 1) AS top, coalesce(max(rescore) FILTER (prank = 2), 0) AS sec, max(srank) FILTER (prank = 1) AS tsr,
   max(s) FILTER (prank = 1) AS ts, max(rule_id) FILTER (srank = 1) AS lead_id, max(s) FILTER (srank = 1) AS ls, coalesce(max(s) FILTER (srank = 2), -1) AS ns, max(sc) FILTER (srank = 1) AS lc,
   coalesce(max(after) FILTER (srank = 1), -1) AS nc, max(rescore) FILTER (srank = 1) AS lp, max(prank) FILTER (srank = 1) AS lpr, max(hits) FILTER (srank = 1) AS lead_hits, max(n) AS n FROM cd{t} GROUP BY query_id),
 me{t} AS (SELECT *, round(top - sec, 9) AS m, round(ls - ns, 9) AS sm, round(lc - nc, 9) AS sem, round(top, 9) AS t9, round(ls, 9) AS l9 FROM ag{t}),
 de{t} AS MATERIALIZED (SELECT *, CASE WHEN basis = 'strict' THEN top_id WHEN basis <> 'ambiguous' THEN lead_id END AS rule_id FROM (SELECT *, CASE
   WHEN t9 >= 0.55 AND tsr <= 3 AND ((t9 >= 0.82 AND m >= 0.025) OR (t9 >= 0.68 AND m >= 0.06) OR (m >= 0.1 AND tsr = 1) OR (tsr = 1 AND sem >= 0.035 AND t9 >= 0.62 AND m >= 0.04)) THEN 'strict'
   WHEN n = 1 AND top_id = lead_id AND l9 >= 0.69 AND sm >= 0.06 AND lp >= 0.02 AND lp < 0.55 THEN 'single_query_agreement'
   WHEN n > 1 AND l9 >= 0.68 AND sm >= 0.025 AND lead_hits >= n AND lpr <= 2 AND lp >= 0.02 AND (top_id = lead_id OR (greatest(0, round(top - lp, 9)) <= 0.035 AND round(ls - ts, 9) >= 0.02)) THEN 'consensus'
   ELSE 'ambiguous' END AS basis FROM me{t}))"""


_ALL = _W + _arms_sql() + _pass_sql("", "true")
_WIDE = (
    _W + _arms_sql() + _pass_sql("1", "arm = 0")
    + ", several AS MATERIALIZED (SELECT query_id FROM arms JOIN (SELECT query_id FROM de1 WHERE basis = 'ambiguous') USING (query_id) GROUP BY 1 HAVING count(*) > 1)"
    + _pass_sql("2", "query_id IN (SELECT query_id FROM several)")
    + """, wide AS MATERIALIZED (SELECT query_id, rule_id, basis, n, 'variants_used' AS decision FROM de2 UNION ALL
 SELECT query_id, rule_id, basis, n, CASE WHEN basis = 'ambiguous' THEN 'no_safe_variants' ELSE 'single_query_accepted' END FROM de1 WHERE query_id NOT IN (SELECT query_id FROM de2))"""
)


def _widened(spark, sf):
    q = part_questions(spark, sf)
    return RS.resolve_widened(q.select("query_id", "query"), profiles(spark, sf), safe_variants(q))


@query("resolve_reference", _ALL + " SELECT query_id, rule_id, basis, n AS n_queries, lead_hits, round(top, 6) AS top, round(m, 6) AS margin FROM de")
def _(spark, sf):
    q = part_questions(spark, sf)
    r = RS.resolve_rules(q.select("query_id", "query"), profiles(spark, sf), safe_variants(q))
    return r.select("query_id", "rule_id", "basis", "n_queries", "lead_hits", F.round("top", 6).alias("top"), F.round("margin", 6).alias("margin"))


@query("resolve_widened", _WIDE + " SELECT query_id, rule_id, basis, n AS n_queries, decision FROM wide")
def _(spark, sf):
    return _widened(spark, sf)[0]


@query("verify_resolved", _WIDE + " SELECT query_id, rule_id FROM wide WHERE rule_id IN (SELECT rule_id FROM std WHERE section_role = 'requirement')")
def _(spark, sf):
    r = _widened(spark, sf)[0].where("rule_id IS NOT NULL")
    return r.join(bodies(spark, sf), "rule_id", "left_semi").select("query_id", "rule_id")


@query(
    "ambiguity_bundle",
    _WIDE + """ SELECT query_id, rule_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS c FROM (SELECT query_id, cd2.rule_id, row_number() OVER (PARTITION BY query_id ORDER BY srank) AS pos FROM cd2 JOIN de2 d USING (query_id)
 WHERE d.basis = 'ambiguous' AND d.n >= 3 AND hits >= cd2.n AND d.l9 >= 0.68 AND round(s, 9) >= 0.68 AND round(ls - s, 9) <= 0.025 AND round(lc - sc, 9) <= 0.035) WHERE pos <= 3) WHERE c >= 2""",
)
def _(spark, sf):
    decisions, again = _widened(spark, sf)
    return RS.ambiguity_bundle(decisions, again, bodies(spark, sf)).select("query_id", "rule_id", F.col("pos").cast("bigint"))


@query(
    "near_threshold_rescue",
    _W + _arms_sql(BROAD) + _pass_sql("", "true") + f"""
 SELECT query_id, chunk_key, round(rescore, 6) AS rescore, row_number() OVER (PARTITION BY query_id ORDER BY prank) AS pos FROM (
  SELECT c.query_id, st.chunk_key, c.rescore, c.prank, c.hits, list_filter(list_distinct(list_transform(string_split({D.norm('c.query')}, ' '), lambda t_: {D.catalog_stem('t_')})), lambda t_: length(t_) >= 3 AND t_ NOT IN {D.words(H.RESCUE_NOISE)}) AS qs, {_SST.replace('text', 'st.text')} AS ss
  FROM cd c JOIN std st ON st.rule_id = c.rule_id AND st.section_role = 'requirement' WHERE c.rescore >= 0.49 AND c.rescore < 0.55)
 WHERE len(qs) > 0 AND (len(list_intersect(qs, ss)) >= CASE WHEN len(qs) = 1 THEN 1 ELSE 2 END OR hits >= 2) QUALIFY pos <= 3""",
)
def _(spark, sf):
    """Candidates of the whole search that miss the confidence floor by little."""
    q = part_questions(spark, sf, BROAD)
    arms = RS.question_arms(q.select("query_id", "query"), safe_variants(q))
    p = profiles(spark, sf)
    c = RS.candidates(q.select("query_id", "query"), arms, p, RS.profile_vectors(p))
    body = standards(spark, sf).where(H.BODY).select("rule_id", "chunk_key", "section_role", "text")
    c = c.join(body, "rule_id").join(q.select("query_id", "query"), "query_id")
    c = top_k_per(c, ["query_id"], [F.round("rescore", 9).desc(), F.col("semantic_rank").asc()], RS.RESCORE_TOP_K, "rank")
    return H.near_threshold_rescue(c).select("query_id", "chunk_key", F.round("rescore", 6).alias("rescore"), F.col("pos").cast("bigint"))


_CUES = f""", cuep AS MATERIALIZED (SELECT DISTINCT cue_id, {D.norm('cue_id')} AS p, list_distinct(string_split({D.norm('cue_id')}, ' ')) AS ct FROM rq),
 cueb AS MATERIALIZED (SELECT chunk_key, rule_id, length(text) AS len, {D.norm('text')} AS nt, list_distinct(string_split({D.norm('text')}, ' ')) AS tt FROM std WHERE section_role = 'requirement'),
 cueh AS MATERIALIZED (SELECT cue_id, p, len(ct) AS n, chunk_key, count(*) AS matched FROM (SELECT cue_id, p, ct, unnest(ct) AS tok FROM cuep) JOIN (SELECT chunk_key, unnest(tt) AS tok FROM cueb) USING (tok) GROUP BY ALL HAVING matched / n >= 0.6),
 cuec AS (SELECT cue_id, rule_id, chunk_key, len, matched, n, contains(' ' || nt || ' ', ' ' || p || ' ') AS ph FROM cueh JOIN cueb USING (chunk_key)),
 cue AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cue_id ORDER BY round(cov, 9) DESC, matched DESC, len, chunk_key) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY cue_id, rule_id ORDER BY round(cov, 9) DESC, matched DESC, len, chunk_key) AS d FROM (
   SELECT *, CASE WHEN ph THEN 1.0 ELSE matched / n END AS cov FROM cuec WHERE ph OR (matched >= greatest(2, round(n * 0.6)) AND matched / n >= 0.72))) WHERE d = 1) WHERE rank <= 6)"""


@query(
    "cue_promotion",
    _WIDE + _CUES + """, res AS MATERIALIZED (SELECT query_id, rule_id, ends_with(cue_id, 'promo form') AS inv FROM wide JOIN rq USING (query_id) WHERE rule_id IS NOT NULL),
 agr AS MATERIALIZED (SELECT DISTINCT query_id, r.rule_id FROM res r JOIN rq USING (query_id) JOIN cue c ON c.cue_id = rq.cue_id AND c.rule_id = r.rule_id WHERE NOT inv)
 SELECT query_id, rule_id, 'promoted' AS action FROM agr UNION ALL SELECT query_id, rule_id, 'kept' FROM res WHERE query_id NOT IN (SELECT query_id FROM agr)""",
)
def _(spark, sf):
    """Accepted rules against the rules that the question's own cue finds; questions on promotional parts count as inventories."""
    q = part_questions(spark, sf)
    inventory = F.col("cue_id").endswith("promo form")
    asked = q.select("query_id", "cue_id", inventory.alias("inventory"), F.lower("query").rlike(r"^(is|are|can|may|does)\b").alias("direct"))
    results = _widened(spark, sf)[0].where("rule_id IS NOT NULL").join(asked, "query_id")
    cues = H.phrase_cue_match(q.select("cue_id", F.col("cue_id").alias("phrase")).distinct(), standards(spark, sf))
    found = cues.join(asked.select("query_id", "cue_id"), "cue_id")
    return RS.cue_promotion(results, found)
