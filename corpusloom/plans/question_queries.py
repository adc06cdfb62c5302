"""Question understanding queries over conversation turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import intents as I
from corpusloom.functions import references as R
from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query

_Q = f"({X.QUESTIONS_SQL})"


def _flags(spark, sf, flags):
    q = X.questions(spark, sf)
    return q.select("question_id", *[c.alias(n) for n, c in flags(F.col("question")).items()])


@query(
    "query_topic_tokens",
    f"""SELECT question_id, array_to_string({D.ordered_distinct('t')}, ' ') AS tokens
 FROM (SELECT question_id, {D.topic_words(D.norm('question'), V.QUERY_FILLER_WORDS)} AS t FROM {_Q})""",
)
def _(spark, sf):
    q = X.questions(spark, sf)
    return q.select("question_id", F.array_join(T.query_topic_tokens("question"), " ").alias("tokens"))


# ---- normalize_query ---------------------------------------------------------------------------------

_REQ = f"({V.INTERROGATIVES}|{V.IMPERATIVES})"


def _compound_sql(x: str) -> str:
    low = f"lower({x})"
    return "(" + D.rx(low, rf"\b(and|at)\b\s+(also\s+|din\s+|rin\s+)?{_REQ}\b") + " OR " + D.rx(
        low, rf"[?;]\s*(please\s+|paki\s*)?{_REQ}\b") + ")"


def _canonical_sql() -> str:
    whens = " ".join(f"WHEN {D.rx('q', p)} THEN {D.rsub('q', p, r, '')}" for p, r in V.CANONICAL_QUESTIONS)
    s = f"SELECT question_id, CASE WHEN {_compound_sql('q')} THEN q {whens} ELSE q END AS q FROM (SELECT question_id, strip_accents(lower(trim(question))) AS q FROM {_Q})"
    q = "replace(replace(q, '&&', ' logical and operator '), '||', ' logical or operator ')"
    for _ in range(2):
        q = D.rsub(q, r"([0-9])\.([0-9])", r"\1__dot__\2")
    q = D.rsub(q, "|".join(V.QUESTION_PREFIX_PATTERNS), "", "")
    q = f"replace({D.rsub(q, r'[^\p{L}\p{N}_\s]', ' ')}, '__dot__', '.')"
    cases = " ".join(f"WHEN {D.lit(k)} THEN {D.lit(v)}" for k, v in V.ABBREVIATIONS.items())
    return f"""SELECT question_id, array_to_string(list_transform(string_split({D.squash('q2')}, ' '),
 lambda w: CASE w {cases} ELSE w END), ' ') AS normalized FROM (SELECT question_id, {q} AS q2 FROM ({s}))"""


@query("normalize_query", _canonical_sql())
def _(spark, sf):
    return X.questions(spark, sf).select("question_id", I.normalize_query(F.col("question")).alias("normalized"))


# ---- intents -------------------------------------------------------------------------------------------


def _topic_sql(x: str) -> str:
    t = "trim(" + D.rsub(f"trim({x})", r"[?!.]+$") + ")"
    t = "trim(" + D.rsub(t, "(?i)^(" + "|".join(V.TOPIC_STOP_PHRASES) + r")(\s+|$)", "", "") + ")"
    return "trim(" + D.rsub(t, r"(?i)^(about|of|sa|ng|kay|si|ang)\s+", "", "") + ")"


def _permission_sql(x: str) -> str:
    low = D.squash(f"lower({x})")
    return (f"({D.rx(low, V.PERMISSION_PATTERN)} AND NOT {D.rx(low, V.PERMISSION_PEOPLE_PATTERN)} AND "
            f"({D.rx(low, V.PERMISSION_CODE_PATTERN)} OR contains({low}, '&&') OR contains({low}, '||')))")


def _sub_sql(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {D.lit(w)})" for w in words) + ")"


def _intent_sql(x: str) -> dict[str, str]:
    low = f"lower({x})"
    perm = _permission_sql(x)
    topic = D.squash(_topic_sql(x))
    plain = D.squash(D.rsub(f"lower({topic})", r"[^a-z0-9\s'-]", " "))
    sig = f"list_filter(string_split({topic}, ' '), lambda w_: lower(w_) NOT IN {D.words(V.NAME_PARTICLES)})"
    cap = f"list_filter({sig}, lambda w_: {D.rx('w_', '^' + chr(92) + 'p{Lu}')})"
    person = (f"(len(string_split({topic}, ' ')) BETWEEN 2 AND 5 AND NOT {D.rx(plain, '[0-9]')} AND NOT "
              f"{D.rx(plain, chr(92) + 'b(and|or|versus|vs)' + chr(92) + 'b')} AND NOT list_has_any(string_split({plain}, ' '), {D.arr(V.NON_PERSON_TERMS)}) "
              f"AND NOT {D.rx(plain, '^(the|a|an) ')} AND len({sig}) >= 2 AND len({cap}) >= 2)")
    return {
        "is_list": D.rx(low, V.LIST_PATTERN),
        "is_relationship": D.rx(low, V.ENRICH_RELATIONSHIP_PATTERN),
        "is_overview": D.rx(low, V.OVERVIEW_PATTERN),
        "is_permission": perm,
        "is_eligibility": f"(NOT {perm} AND {D.rx(low, V.ELIGIBILITY_PATTERN)})",
        "is_identity": D.rx(low, V.IDENTITY_PATTERN),
        "is_technical": _sub_sql(low, V.TECHNICAL_KEYWORDS),
        "is_person_name": person,
    }


def _select(flags: dict[str, str], src: str = _Q, key: str = "question_id") -> str:
    return f"SELECT {key}, " + ", ".join(f"{e} AS {n}" for n, e in flags.items()) + f" FROM {src}"


@query("query_intents", _select(_intent_sql("question")))
def _(spark, sf):
    return _flags(spark, sf, I.query_intents)


# ---- enrichment --------------------------------------------------------------------------------------------


def _enrich_sql() -> str:
    f = _intent_sql("q")
    rel_heads = [
        r"relationship\s+with", r"relationships\s+with", r"romantic\s+relationship\s+with",
        r"romantic\s+relationships\s+with", r"love\s+interests?\s+of", r"girlfriends?\s+of",
        r"women\s+(?:linked|connected|associated)\s+(?:to|with)", r"ladies\s+(?:linked|connected|associated)\s+(?:to|with)",
        r"associated\s+with", r"connected\s+to",
    ]
    t = "trim(" + D.rsub("trim(q)", r"[?!.]+$") + ")"
    rel = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({t}, {D.lit('(?i)' + h + r'\s+(.+)$')}, 1)), '')" for h in rel_heads) + ")"
    rel = "trim(" + D.rsub(rel, r"(?i)^(with|to|of|about)\s+", "", "") + ")"
    generic = D.words("the a an approval approver role authority entity position person".split())
    t2 = D.rsub("trim(q)", r"[?!.]+$")
    subj = []
    for p in V.ELIGIBILITY_SUBJECT_PATTERNS:
        h = f"trim(regexp_replace(trim(regexp_extract({t2}, {D.lit('(?i)' + p)}, 1)), '(?i)^(the|a|an)\\s+', ''))"
        subj.append(f"CASE WHEN {h} <> '' AND lower({h}) NOT IN {generic} THEN {h} END")
    step1 = f"SELECT question_id, trim(question) AS q FROM {_Q}"
    step2 = f"SELECT *, coalesce({rel}, {_topic_sql('q')}) AS topic, coalesce({', '.join(subj)}) AS s0, {', '.join(e + ' AS ' + n for n, e in f.items())} FROM ({step1})"
    step3 = f"SELECT *, coalesce(s0, nullif(topic, ''), q) AS subj FROM ({step2})"
    low4 = "concat_ws(' ', lower(q), lower(q), lower(subj))"
    whens = " ".join(f"WHEN {D.rx(low4, p)} THEN {D.lit(n)}" for n, p in V.ELIGIBILITY_INTENT_PATTERNS)
    step4 = f"SELECT *, CASE {whens} ELSE 'eligibility' END AS intent FROM ({step3})"
    elig = " ".join(
        f"WHEN '{n}' THEN [" + ",".join(f"{D.lit(x.split('{}')[0])}||subj||{D.lit(x.split('{}')[1])}" for x in forms) + "]"
        for n, forms in V.ELIGIBILITY_TERMS.items())
    suff = lambda ss: "[" + ",".join(f"topic||{D.lit(s)}" for s in ss) + "]"
    block = lambda ws, ts: f"CASE WHEN {_sub_sql('lower(q)', ws)} THEN {D.arr(ts)} ELSE [] END"
    claim = f"trim(regexp_extract({t2}, {D.lit('(?i)^(?:' + V.CLAIM_AUXILIARIES + r')\s+(.+)$')}, 1))"
    main = f"""CASE WHEN is_eligibility THEN CASE intent {elig} END
 WHEN is_relationship AND topic <> '' THEN {suff(I.RELATIONSHIP_SUFFIXES)}
 WHEN (is_identity AND NOT is_eligibility) OR (is_overview AND is_person_name) THEN CASE WHEN topic <> '' THEN {suff(V.IDENTITY_SUFFIXES)} ELSE [q] END
 WHEN is_overview THEN CASE WHEN topic <> '' THEN {suff(I.TOPIC_OVERVIEW_SUFFIXES)} WHEN is_technical THEN [q] ELSE {D.arr(V.GENERAL_OVERVIEW_TERMS)} END
 ELSE [] END"""
    step5 = f"""SELECT *, list_concat({main}, {block(V.PROCESS_KEYWORDS, V.PROCESS_TERMS)}, {block(V.POLICY_KEYWORDS, V.POLICY_TERMS)},
 {block(V.CONFIGURATION_KEYWORDS, V.CONFIGURATION_TERMS)}, CASE WHEN {claim} <> '' THEN [{claim}, 'evidence '||{claim}, 'statement '||{claim}] ELSE [] END) AS extra FROM ({step4})"""
    step6 = f"SELECT *, list_filter(list_transform(list_concat([q], CASE WHEN topic <> '' THEN [topic] ELSE [] END, extra), lambda x: trim(x)), lambda x: x <> '') AS parts FROM ({step5})"
    exact = "(" + D.rx("lower(q)", V.RULE_REFERENCE) + " OR " + D.rx("lower(q)", r"\b(section|article|chapter|part)\b\s*(no\.?\s*|number\s*)?([0-9ivxlcdm]+|[a-z])(\.[0-9]+)*\b") + ")"
    return f"""SELECT question_id, CASE WHEN {exact} OR len(extra) = 0 THEN q ELSE array_to_string(
 list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i), ' ') END AS enriched FROM ({step6})"""


@query("enrich_query", _enrich_sql())
def _(spark, sf):
    return I.enrich_queries(X.questions(spark, sf), "question", "enriched").select("question_id", "enriched")


# ---- retrieval intents, facets -----------------------------------------------------------------------------


def _trim_set(x: str, chars: str) -> str:
    return D.rsub(x, rf"^[{chars}]+|[{chars}]+$")


def _facets_sql(x: str) -> str:
    clean = D.rsub(D.squash(x), I.FACET_LEAD, "", "")
    # RE2 has no look-ahead: mark the separator and keep the request word.
    marked = D.rsub(clean, rf"(?i)(?:\s+\b(?:and|at)\b\s+(?:also\s+|din\s+|rin\s+)?|[?;]\s*(?:please\s+|paki\s*)?)({_REQ})\b", "\x01\\1")
    parts = f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p_: {_trim_set('p_', ' .?;:')}), lambda p_: p_ <> '')"
    chain = f"CASE WHEN len({parts}) >= 2 THEN {parts}[1:4]"
    for p in V.FACET_PAIR_PATTERNS:
        p = "(?i)" + p
        chain += f" WHEN {D.rx(clean, p)} THEN [trim(regexp_extract({clean}, {D.lit(p)}, 1)), trim(regexp_extract({clean}, {D.lit(p)}, 2))]"
    return chain + " ELSE [] END"


def _retrieval_intent_sql(src: str = _Q) -> str:
    pad = "(' '||n||' ')"
    head = "array_to_string(string_split(n, ' ')[1:8], ' ')"
    raw = D.rsub(D.squash("question"), r"^[ .?!]+|[ .?!]+$")
    return f"""SELECT question_id, len(string_split_regex(trim(question), '\\s+')) <= 5 AS short_query,
 ({D.rx(head, '|'.join(V.LIST_PREFIX_PATTERNS))} OR list_has_any(string_split({head}, ' '), {D.arr(V.COMPLETENESS_TERMS)}) OR {D.rx('n', V.LIST_RELATION_PATTERN)}) AS list_query,
 {D.rx('n', V.RELATIONSHIP_QUERY_PATTERN)} AS relationship_query, {D.any_phrase(pad, V.IDENTITY_QUERY_TERMS)} AS identity_query,
 {D.any_phrase(pad, V.REFERENCE_REQUEST_TERMS)} AS reference_request,
 {D.rx('lower(' + raw + ')', '|'.join(V.TEMPORAL_COMPARISON_PATTERNS))} AS temporal_comparison,
 len({_facets_sql('question')}) >= 2 AS compound_query
 FROM (SELECT *, {D.norm('question')} AS n FROM {src})"""


@query("retrieval_intents", _retrieval_intent_sql())
def _(spark, sf):
    return _flags(spark, sf, I.retrieval_intents)


_KIND = "CASE " + " ".join(f"WHEN {D.rx('n', p)} THEN {D.lit(k)}" for k, p in V.RELATION_KIND_PATTERNS) + " ELSE '' END"
_KIND_SQL = f"SELECT question_id, n, {_KIND} AS kind FROM (SELECT question_id, {D.norm('question')} AS n FROM {_Q})"


@query("direct_relation_kind", f"SELECT question_id, kind FROM ({_KIND_SQL})")
def _(spark, sf):
    return X.questions(spark, sf).select("question_id", I.direct_relation_kind(F.col("question")).alias("kind"))


_OWN = "CASE kind " + " ".join(f"WHEN {D.lit(k)} THEN {D.arr(w.split())}" for k, w in V.RELATION_KIND_WORDS.items()) + " ELSE [] END"


@query(
    "relation_anchors",
    f"""SELECT question_id, kind, array_to_string({D.ordered_distinct('a')}[1:8], ' ') AS anchors FROM (SELECT question_id, kind,
 list_filter(string_split(n, ' '), lambda t_: length(t_)>2 AND t_ NOT IN {D.words(V.RELATION_COMMON_WORDS)} AND NOT list_contains({_OWN}, t_)) AS a FROM ({_KIND_SQL}))""",
)
def _(spark, sf):
    q = X.questions(spark, sf).withColumn("kind", I.direct_relation_kind(F.col("question")))
    return q.select("question_id", "kind", F.array_join(I.relation_anchors(F.col("question"), F.col("kind")), " ").alias("anchors"))


@query(
    "split_facets",
    f"""SELECT question_id, generate_subscripts(f, 1)::BIGINT AS facet_no, unnest(f) AS facet
 FROM (SELECT question_id, {_facets_sql('question')} AS f FROM {_Q}) WHERE len(f) > 0""",
)
def _(spark, sf):
    q = X.questions(spark, sf).select("question_id", F.posexplode(I.split_facets(F.col("question"))).alias("i", "facet"))
    return q.select("question_id", (F.col("i") + 1).cast("bigint").alias("facet_no"), "facet")


def _facet_query_sql() -> str:
    f1 = D.norm("f[1]")
    anchor = f"array_to_string(list_filter(string_split({f1}, ' '), lambda t_: length(t_)>2 AND t_ NOT IN {D.words(V.FACET_ANCHOR_STOP_WORDS)})[1:5], ' ')"
    base = f"SELECT question_id, {anchor} AS anchor, generate_subscripts(f, 1)::BIGINT AS facet_no, unnest(f) AS facet FROM (SELECT question_id, {_facets_sql('question')} AS f FROM {_Q}) WHERE len(f) >= 2"
    n = D.norm("facet")
    thin = f"({D.any_phrase('(' + chr(39) + ' ' + chr(39) + '||' + n + '||' + chr(39) + ' ' + chr(39) + ')', V.FACET_PRONOUNS)} OR len(list_distinct({D.topic_words(n, V.QUERY_FILLER_WORDS)})) <= 2)"
    q = (f"facet || CASE WHEN {D.rx(n, chr(92) + 'b(pagpirma|nilagdaan|lumagda|pinirmahan)' + chr(92) + 'b')} THEN ' signed signing date' ELSE '' END"
         f" || CASE WHEN {D.rx(n, chr(92) + 'b(deklarasyon|idineklara|declaration|declared)' + chr(92) + 'b')} THEN ' declaration declared date' ELSE '' END")
    return f"SELECT question_id, facet_no, CASE WHEN facet_no > 1 AND anchor <> '' AND {thin} THEN facet || ' ' || anchor ELSE {q} END AS facet_query FROM ({base})"


@query("facet_queries", _facet_query_sql())
def _(spark, sf):
    q = X.questions(spark, sf).withColumn("f", I.split_facets(F.col("question")))
    q = q.select("question_id", F.posexplode(I.facet_queries(F.col("f"))).alias("i", "facet_query"))
    return q.select("question_id", (F.col("i") + 1).cast("bigint").alias("facet_no"), "facet_query")


def _binary_sql() -> str:
    lead = r"(?i)\b(?:(?:i(?:'m| am)|we(?:'re| are))\s+)?(?:not\s+sure|unsure|uncertain)\s+(?:whether|if)\s+"
    bound = r"^(.*?)[.!?](?:\s+|$)(.*)$"
    ex = lambda x, p, g: f"regexp_extract({x}, {D.lit(p)}, {g})"
    s1 = f"SELECT question_id, raw, trim({ex('raw', lead + '(.+)$', 1)}) AS body, {_trim_set(D.rsub('trim(' + ex('raw', '^(.*?)' + lead.replace('(?i)', '(?i:') + ')', 1) + ')', '(?i)' + chr(92) + 'b(but|and)' + chr(92) + 's*$'), ' ,;:-')} AS prefix FROM (SELECT question_id, {D.squash('question')} AS raw FROM {_Q})"
    s2 = f"SELECT *, trim(CASE WHEN {D.rx('body', bound)} THEN {ex('body', bound, 1)} ELSE body END) AS amb, trim(CASE WHEN {D.rx('body', bound)} THEN {ex('body', bound, 2)} ELSE '' END) AS suffix FROM ({s1})"
    pair = r"(?i)^(.*?)\s+or\s+(.*)$"
    left = "trim(" + D.rsub(_trim_set(ex("amb", pair, 1), " ,;:-"), r"(?i)^(the\s+)?(concern|issue|question|problem|risk)\s+is\s+", "", "") + ")"
    s3 = f"SELECT *, {left} AS l, {_trim_set(ex('amb', pair, 2), ' ,;:-')} AS r FROM ({s2})"
    cut = lambda x: D.rsub(x, r"[.?!]+$")
    comp = lambda x: D.squash(f"(CASE WHEN prefix <> '' THEN {cut('prefix')} || '. ' ELSE '' END || 'Focus on ' || {cut(x)} || '. ' || suffix)")
    return f"""SELECT question_id, {comp('l')} AS variant_a, {comp('r')} AS variant_b FROM ({s3})
 WHERE {D.count_rx('l', '[A-Za-z0-9]+')} >= 2 AND {D.count_rx('r', '[A-Za-z0-9]+')} >= 2 AND lower({comp('l')}) <> lower({comp('r')})"""


@query("binary_ambiguity_variants", _binary_sql())
def _(spark, sf):
    q = I.binary_variants(X.questions(spark, sf), "question")
    return q.where("variant_a IS NOT NULL").select("question_id", "variant_a", "variant_b")


# ---- variants ------------------------------------------------------------------------------------------------


def variant_candidates(spark, sf):
    """Candidate rewrites per question as a rewriting model would return them."""
    q = X.questions(spark, sf)
    topic = F.regexp_replace("question", r"[?.]+$", "")
    return q.select(
        "question_id",
        "question",
        F.array(
            F.concat(F.lit('"'), topic, F.lit(' details."')),
            F.concat(F.lit("Yes, "), topic),
            F.concat(topic, F.lit(" under rule 99.1")),
            F.concat(F.lit("policy on "), topic, F.lit(";")),
            T.upper(F.concat(topic, F.lit(" details"))),
            F.col("question"),
            F.concat(F.lit("third rewrite of "), topic),
        ).alias("candidates"),
    )


_VC = f"""SELECT question_id, question, ['"'||t||' details."', 'Yes, '||t, t||' under rule 99.1', 'policy on '||t||';', upper(t||' details'),
 question, 'third rewrite of '||t] AS candidates FROM (SELECT question_id, question, regexp_replace(question, '[?.]+$', '') AS t FROM {_Q})"""


def _ids_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all(lower({x}), {D.lit(V.VARIANT_REFERENCE)}), lambda r_: regexp_replace(r_, '\\s+', ' ', 'g'))"


def _validate_sql(src: str, cand: str = "candidates") -> str:
    tidy = "trim(" + D.rsub(D.squash(D.rsub("c", "^[\"'` ]+|[\"'` ]+$")), r"[.;]$", "", "") + ")"
    s1 = f"SELECT question_id, question, unnest({cand}) AS c, generate_subscripts({cand}, 1) AS i FROM ({src})"
    s2 = f"SELECT question_id, question, i, {tidy} AS c FROM ({s1})"
    s3 = f"""SELECT question_id, i, c, row_number() OVER (PARTITION BY question_id, lower(c) ORDER BY i) AS dup FROM ({s2})
 WHERE c <> '' AND length(c) <= {V.MAX_VARIANT_CHARS} AND list_has_all({_ids_sql('question')}, {_ids_sql('c')})
 AND NOT {D.rx('lower(c)', V.ANSWER_LIKE_VARIANT)} AND lower(c) <> lower({D.squash('question')})"""
    s4 = f"SELECT question_id, c AS variant, row_number() OVER (PARTITION BY question_id ORDER BY i) AS variant_no FROM ({s3}) WHERE dup = 1"
    return f"SELECT question_id, variant_no, variant FROM ({s4}) WHERE variant_no <= {V.MAX_VARIANTS}"


def _explode_variants(df, col):
    v = df.select("question_id", F.posexplode(col).alias("i", "variant"))
    return v.select("question_id", (F.col("i") + 1).cast("bigint").alias("variant_no"), "variant")


@query("validate_variants", _validate_sql(_VC))
def _(spark, sf):
    c = variant_candidates(spark, sf)
    return _explode_variants(c, I.validate_variants(F.col("question"), F.col("candidates")))


_RAW = f"""SELECT question_id, question, t, CASE (conv_id + turn) % 4
 WHEN 0 THEN '{{"queries": ["' || replace(t, '"', '') || ' one", "about ' || replace(t, '"', '') || '"]}}'
 WHEN 1 THEN '- ' || t || ' first' || chr(10) || '2) Query: ' || t || ' second' || chr(10) || '* variant: third ' || t
 WHEN 2 THEN '{{"queries": ["only one"]}}' ELSE '{{"answer": "x"}}' END AS raw
 FROM (SELECT *, regexp_replace(question, '[?.]+$', '') AS t FROM {_Q})"""
_PARSED = f"""SELECT question_id, question, CASE WHEN starts_with(raw, '{{') THEN CASE WHEN json_keys(raw::JSON) = ['queries'] AND json_array_length(raw::JSON, '$.queries') = 2
 THEN from_json(json_extract(raw::JSON, '$.queries'), '["VARCHAR"]') ELSE [] END
 ELSE list_transform(string_split(raw, chr(10)), lambda x: regexp_replace(trim(regexp_replace(x, '^\\s*(?:[-*•]|[0-9]+[.)])\\s*', '')), '(?i)^(query|variant|alternative)\\s*:\\s*', '')) END AS candidates FROM ({_RAW})"""


@query("parse_variants", _validate_sql(_PARSED))
def _(spark, sf):
    q = X.questions(spark, sf).withColumn("t", F.regexp_replace("question", r"[?.]+$", ""))
    t, bare = F.col("t"), F.replace(F.col("t"), F.lit('"'), F.lit(""))
    form = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    raw = (
        F.when(form == 0, F.concat(F.lit('{"queries": ["'), bare, F.lit(' one", "about '), bare, F.lit('"]}')))
        .when(form == 1, F.concat(F.lit("- "), t, F.lit(" first\n2) Query: "), t, F.lit(" second\n* variant: third "), t))
        .when(form == 2, '{"queries": ["only one"]}')
        .otherwise('{"answer": "x"}')
    )
    return _explode_variants(q, I.parse_variants(raw, F.col("question")))


_GATE = (f"NOT {D.rx('lower(question)', V.RULE_REFERENCE)} AND NOT {D.rx('lower(question)', V.GROUPED_REFERENCE)} AND "
         f"len(string_split({D.squash('question')}, ' ')) >= 3 AND {_KIND} = ''")


@query("variant_gate", f"SELECT question_id, ({_GATE}) AS wants_variants FROM (SELECT question_id, question, {D.norm('question')} AS n FROM {_Q})")
def _(spark, sf):
    return X.questions(spark, sf).select("question_id", I.variant_gate(F.col("question")).alias("wants_variants"))


def _relation_sql(x: str) -> str:
    out = D.squash(x)
    seen = D.rx(f"lower({D.squash(x)})", "|".join(p for p, _ in V.RELATION_PHRASES))
    for p, r in V.RELATION_PHRASES:
        out = D.rsub(out, "(?i)" + p, r)
    out = D.squash(D.rsub(D.rsub(out, "(?i)" + V.RELATION_PARTICLES, " "), r"[?!.]+$"))
    return f"CASE WHEN {seen} THEN {out} ELSE '' END"


@query("canonical_relation_query", f"SELECT question_id, {_relation_sql('question')} AS canonical FROM {_Q}")
def _(spark, sf):
    return X.questions(spark, sf).select("question_id", I.canonical_relation_query(F.col("question")).alias("canonical"))


@query(
    "combine_queries",
    f"""SELECT question_id, CASE WHEN b = '' OR lower(a) = lower(b) THEN a WHEN a = '' THEN b ELSE a || ' | ' || b END AS combined
 FROM (SELECT question_id, {D.squash('question')} AS a, {D.squash(_relation_sql('question'))} AS b FROM {_Q})""",
)
def _(spark, sf):
    q = F.col("question")
    return X.questions(spark, sf).select("question_id", I.combine_queries(q, I.canonical_relation_query(q)).alias("combined"))


def _english_sql(src: str, key: str, col: str) -> str:
    wl = "list_distinct(regexp_extract_all(c, '[a-z]+'))"
    first = "regexp_extract(c, '^[a-z]+')"
    return f"""SELECT {key}, CASE WHEN coalesce(c, '') = '' THEN true WHEN {D.rx(D.rsub('c', chr(92) + 'p{Latin}'), chr(92) + 'p{L}')} THEN false
 WHEN {D.rx('c', '^may' + chr(92) + 's+(a|an|the|this|that|these|those)' + chr(92) + 'b')} THEN true
 WHEN {first} IN {D.words(V.TAGALOG_QUESTION_WORDS)} THEN false WHEN {D.rx('c', V.TAGALOG_PHRASES)} THEN false
 WHEN {first} IN {D.words(V.ENGLISH_STARTERS)} THEN true
 WHEN len(list_intersect({wl}, {D.arr(V.TAGALOG_FUNCTION_WORDS)})) >= 2 THEN false
 WHEN list_has_any({wl}, {D.arr(V.ENGLISH_FUNCTION_WORDS)}) THEN true
 WHEN len({wl}) >= 2 AND list_has_any({wl}, {D.arr(V.ENGLISH_DOCUMENT_TERMS)}) THEN true ELSE false END AS english
 FROM (SELECT {key}, {D.squash('lower(' + col + ')')} AS c FROM {src})"""


@query("is_english", _english_sql("documents", "doc_id", "text"))
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", I.is_english(F.col("text")).alias("english"))


@query(
    "scope_guards",
    f"""SELECT question_id, ({D.rx('c', V.OUTSIDE_INSTRUCTION)} OR ({D.rx('c', V.MISSING_SCOPE)} AND {D.rx('c', V.SCOPE_OVERRIDE)})) AS outside_request,
 (({D.rx('c', V.FRESHNESS)} AND contains(c, 'misra') AND {D.rx('c', V.RELEASE_WORDS)}) OR {D.rx('c', V.CURRENT_ROLE)}) AS freshness_request
 FROM (SELECT question_id, {D.squash('lower(question)')} AS c FROM {_Q})""",
)
def _(spark, sf):
    return _flags(spark, sf, I.scope_guards)


# ---- references --------------------------------------------------------------------------------------------------


def references_sql(src: str, key: str, col: str) -> str:
    """One row per distinct reference; positions from the pieces between the hits."""

    def hits(pattern: str, source: int) -> str:
        return f"""SELECT {key}, {source} AS source, hit, len(array_to_string(gaps[1:i], '')) + len(array_to_string(hits[1:i-1], '')) AS pos FROM (
 SELECT {key}, gaps, hits, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM (SELECT {key}, regexp_extract_all(low, {D.lit(pattern)}) AS hits,
 string_split_regex(low, {D.lit(pattern)}) AS gaps FROM (SELECT {key}, lower({col}) AS low FROM {src})))"""

    single_id = r"^[a-z]+\s*(?:no\.?\s*|number\s*)?([a-z0-9]+(?:\.[0-9]+)*[a-z]?)$"
    ids = f"CASE WHEN source = 1 THEN regexp_extract_all(hit, '[0-9]+(?:\\.[0-9]+)*[a-z]?') ELSE [regexp_extract(hit, {D.lit(single_id)}, 1)] END"
    kind = "CASE WHEN hit LIKE 'dir%' THEN 'directive' ELSE regexp_extract(hit, '^(rule|section|article|chapter|part)', 1) END"
    s1 = f"SELECT {key}, source, pos, {kind} AS kind, {ids} AS ids FROM ({hits(R.SINGLE, 0)} UNION ALL {hits(R.GROUPED, 1)})"
    s2 = f"SELECT {key}, source, pos, kind, unnest(ids) AS identifier, generate_subscripts(ids, 1) AS off FROM ({s1})"
    compact = "replace(identifier, '.', '')"
    s3 = f"""SELECT *, row_number() OVER (PARTITION BY {key}, kind, identifier ORDER BY pos, source, off) AS d FROM ({s2}) WHERE identifier <> '' AND
 (kind IN ('rule','directive') OR {D.rx(compact, '[0-9]')} OR {D.rx(compact, '^[a-z]$')} OR {D.rx(compact, '^[ivxlcdm]+$')})"""
    return f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos, source, off, kind, identifier) AS ref_no, kind, identifier FROM ({s3}) WHERE d = 1"


@query("extract_references", references_sql(_Q, "question_id", "question"))
def _(spark, sf):
    return R.explode_references(X.questions(spark, sf), "question_id", "question")


@query("malformed_reference", f"SELECT question_id, {D.rx('lower(question)', V.MALFORMED_REFERENCE)} AS malformed FROM {_Q}")
def _(spark, sf):
    return X.questions(spark, sf).select("question_id", R.has_malformed_reference(F.col("question")).alias("malformed"))
