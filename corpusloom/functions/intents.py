"""Question normalisation, intent flags and rewrites as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V

_REQUEST = f"({V.INTERROGATIVES}|{V.IMPERATIVES})"


def java_repl(repl: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", repl)


def fold_latin(col: Column) -> Column:
    return F.translate(F.lower(col), T.FOLD_FROM, T.FOLD_TO)


def has_compound_request(col: Column) -> Column:
    low = F.lower(col)
    return low.rlike(rf"\b(and|at)\b\s+(also\s+|din\s+|rin\s+)?{_REQUEST}\b") | low.rlike(
        rf"[?;]\s*(please\s+|paki\s*)?{_REQUEST}\b"
    )


def _map_words(words: Column, table: dict[str, str]) -> Column:
    lit = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.transform(words, lambda w: F.coalesce(F.element_at(lit, w), w))


def normalize_query(col: Column) -> Column:
    """Canonical search text of a question."""
    q = fold_latin(F.trim(col))
    rewritten: Column | None = None
    for pattern, repl in V.CANONICAL_QUESTIONS:
        new = F.regexp_replace(q, pattern, java_repl(repl))
        rewritten = F.when(q.rlike(pattern), new) if rewritten is None else rewritten.when(q.rlike(pattern), new)
    q = F.when(has_compound_request(q), q).otherwise(rewritten.otherwise(q))
    q = F.replace(F.replace(q, F.lit("&&"), F.lit(" logical and operator ")), F.lit("||"), F.lit(" logical or operator "))
    q = F.regexp_replace(q, r"(?<=[0-9])\.(?=[0-9])", "__dot__")
    q = F.regexp_replace(q, "|".join(V.QUESTION_PREFIX_PATTERNS), "")
    q = F.replace(F.regexp_replace(q, r"[^\p{L}\p{N}_\s]", " "), F.lit("__dot__"), F.lit("."))
    return F.array_join(_map_words(F.split(T.squash(q), " "), V.ABBREVIATIONS), " ")


# ---- enrichment ---------------------------------------------------------------------------------


def _any_substring(low: Column, words: Sequence[str]) -> Column:
    return low.rlike("(" + "|".join(words) + ")")


def is_technical_permission(col: Column) -> Column:
    low = T.squash(F.lower(col))
    code = low.rlike(V.PERMISSION_CODE_PATTERN) | low.contains("&&") | low.contains("||")
    return low.rlike(V.PERMISSION_PATTERN) & ~low.rlike(V.PERMISSION_PEOPLE_PATTERN) & code


def topic_of(col: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(col), r"[?!.]+$", ""))
    t = F.trim(F.regexp_replace(t, "(?i)^(" + "|".join(V.TOPIC_STOP_PHRASES) + r")(\s+|$)", ""))
    return F.trim(F.regexp_replace(t, r"(?i)^(about|of|sa|ng|kay|si|ang)\s+", ""))


def looks_like_person(col: Column) -> Column:
    topic = T.squash(topic_of(col))
    words = F.split(topic, " ")
    plain = T.squash(F.regexp_replace(F.lower(topic), r"[^a-z0-9\s'-]", " "))
    significant = F.filter(words, lambda w: ~F.lower(w).isin(V.NAME_PARTICLES))
    capital = F.filter(significant, lambda w: w.rlike(r"^\p{Lu}"))
    return (
        F.size(words).between(2, 5)
        & ~plain.rlike("[0-9]")
        & ~plain.rlike(r"\b(and|or|versus|vs)\b")
        & ~F.arrays_overlap(F.split(plain, " "), F.array(*[F.lit(w) for w in V.NON_PERSON_TERMS]))
        & ~plain.rlike("^(the|a|an) ")
        & (F.size(significant) >= 2)
        & (F.size(capital) >= 2)
    )


def query_intents(col: Column) -> dict[str, Column]:
    """Enrichment intent flags."""
    low = F.lower(col)
    permission = is_technical_permission(col)
    return {
        "is_list": low.rlike(V.LIST_PATTERN),
        "is_relationship": low.rlike(V.ENRICH_RELATIONSHIP_PATTERN),
        "is_overview": low.rlike(V.OVERVIEW_PATTERN),
        "is_permission": permission,
        "is_eligibility": ~permission & low.rlike(V.ELIGIBILITY_PATTERN),
        "is_identity": low.rlike(V.IDENTITY_PATTERN),
        "is_technical": _any_substring(low, V.TECHNICAL_KEYWORDS),
        "is_person_name": looks_like_person(col),
    }


def eligibility_intent(col: Column) -> Column:
    low = F.lower(col)
    chain = None
    for name, pattern in V.ELIGIBILITY_INTENT_PATTERNS:
        chain = F.when(low.rlike(pattern), name) if chain is None else chain.when(low.rlike(pattern), name)
    return chain.otherwise("eligibility")


def eligibility_subject(col: Column) -> Column:
    """Subject of the first pattern that matches and names more than a generic noun."""
    t = F.regexp_replace(F.trim(col), r"[?!.]+$", "")
    generic = "the a an approval approver role authority entity position person".split()
    hits = F.array(*[F.regexp_extract(t, "(?i)" + p, 1) for p in V.ELIGIBILITY_SUBJECT_PATTERNS])
    named = F.transform(hits, lambda h: F.trim(F.regexp_replace(F.trim(h), r"(?i)^(the|a|an)\s+", "")))
    return F.get(F.filter(named, lambda h: (h != "") & ~F.lower(h).isin(generic)), F.lit(0))


def relationship_topic(col: Column) -> Column:
    t = F.trim(F.regexp_replace(F.trim(col), r"[?!.]+$", ""))
    heads = [
        r"relationship\s+with", r"relationships\s+with", r"romantic\s+relationship\s+with",
        r"romantic\s+relationships\s+with", r"love\s+interests?\s+of", r"girlfriends?\s+of",
        r"women\s+(?:linked|connected|associated)\s+(?:to|with)", r"ladies\s+(?:linked|connected|associated)\s+(?:to|with)",
        r"associated\s+with", r"connected\s+to",
    ]
    hits = [F.nullif(F.trim(F.regexp_extract(t, rf"(?i){h}\s+(.+)$", 1)), F.lit("")) for h in heads]
    return F.trim(F.regexp_replace(F.coalesce(*hits), r"(?i)^(with|to|of|about)\s+", ""))


RELATIONSHIP_SUFFIXES = [
    "", " relationship", " relationships", " romantic relationship", " romantic relationships",
    " personal relationships", " love interests", " romance", " sweetheart", " courtship", " wife", " marriage",
    " women", " ladies", " girlfriends", " personal life", " associated women",
]
TOPIC_OVERVIEW_SUFFIXES = [
    "", " definition", " overview", " description", " summary", " background", " important information", " key facts",
]


def _suffixed(topic: Column, suffixes: Sequence[str]) -> Column:
    return F.array(*[F.concat(topic, F.lit(s)) for s in suffixes])


def claim_terms(col: Column) -> Column:
    """Evidence phrasings of a yes/no question (claim, evidence, statement)."""
    t = F.regexp_replace(F.trim(col), r"[?!.]+$", "")
    claim = F.trim(F.regexp_extract(t, rf"(?i)^(?:{V.CLAIM_AUXILIARIES})\s+(.+)$", 1))
    claims = F.filter(F.array(claim), lambda c: c != "")
    forms = lambda c: F.array(c, F.concat(F.lit("evidence "), c), F.concat(F.lit("statement "), c))
    return F.flatten(F.transform(claims, forms))


def distinct_ci(items: Column) -> Column:
    """Trimmed, non-empty, first of each case-insensitive duplicate."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def enrich_queries(df: DataFrame, question: str, out: str) -> DataFrame:
    """Question plus intent-specific search terms; exact references come back untouched.

    Built in stages so every shared value is computed once per row.
    """
    none = F.array().cast("array<string>")
    kept = df.columns
    q, topic, subject = F.col("_q"), F.col("_topic"), F.col("_subject")
    low, has_topic = F.lower(q), F.col("_topic") != ""
    st = df.withColumn("_q", F.trim(F.col(question)))
    st = st.withColumn("_topic", F.coalesce(relationship_topic(q), topic_of(q)))
    st = st.withColumns({f"_{k}": v for k, v in query_intents(q).items()})
    st = st.withColumn("_subject", F.coalesce(eligibility_subject(q), F.nullif(topic, F.lit("")), q))
    st = st.withColumn("_intent", eligibility_intent(F.concat_ws(" ", low, low, subject)))
    by_intent = None
    for name, forms in V.ELIGIBILITY_TERMS.items():
        terms = F.array(*[F.concat(F.lit(x.split("{}")[0]), subject, F.lit(x.split("{}")[1])) for x in forms])
        hit = F.col("_intent") == name
        by_intent = F.when(hit, terms) if by_intent is None else by_intent.when(hit, terms)
    identity = (F.col("_is_identity") & ~F.col("_is_eligibility")) | (F.col("_is_overview") & F.col("_is_person_name"))
    general = F.array(*[F.lit(x) for x in V.GENERAL_OVERVIEW_TERMS])
    main = (
        F.when(F.col("_is_eligibility"), by_intent)
        .when(F.col("_is_relationship") & has_topic, _suffixed(topic, RELATIONSHIP_SUFFIXES))
        .when(identity, F.when(has_topic, _suffixed(topic, V.IDENTITY_SUFFIXES)).otherwise(F.array(q)))
        .when(
            F.col("_is_overview"),
            F.when(has_topic, _suffixed(topic, TOPIC_OVERVIEW_SUFFIXES))
            .when(F.col("_is_technical"), F.array(q))
            .otherwise(general),
        )
        .otherwise(none)
    )

    def block(words: Sequence[str], terms: Sequence[str]) -> Column:
        return F.when(_any_substring(low, words), F.array(*[F.lit(t) for t in terms])).otherwise(none)

    st = st.withColumn("_main", main)
    st = st.withColumn(
        "_extra",
        F.concat(
            F.col("_main"),
            block(V.PROCESS_KEYWORDS, V.PROCESS_TERMS),
            block(V.POLICY_KEYWORDS, V.POLICY_TERMS),
            block(V.CONFIGURATION_KEYWORDS, V.CONFIGURATION_TERMS),
            claim_terms(q),
        ),
    )
    parts = F.concat(F.array(q), F.when(has_topic, F.array(topic)).otherwise(none), F.col("_extra"))
    st = st.withColumn("_parts", F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))
    st = st.withColumn("_low", F.transform("_parts", lambda x: F.lower(x)))
    unique = F.filter("_parts", lambda x, i: F.array_position(F.col("_low"), F.lower(x)) == i + 1)
    exact = low.rlike(V.RULE_REFERENCE) | low.rlike(
        r"\b(section|article|chapter|part)\b\s*(no\.?\s*|number\s*)?([0-9ivxlcdm]+|[a-z])(\.[0-9]+)*\b"
    )
    done = F.when(exact | (F.size("_extra") == 0), q).otherwise(F.array_join(unique, " "))
    return st.select(*kept, done.alias(out))


# ---- retrieval intents ----------------------------------------------------------------------------


def retrieval_intents(col: Column, n: Column | None = None) -> dict[str, Column]:
    """``n``: the normalised question, where the caller has it."""
    n = T.normalize_text(col) if n is None else n
    head = F.array_join(F.slice(F.split(n, " "), 1, 8), " ")
    pad = T.padded(n)
    complete = F.arrays_overlap(F.split(head, " "), F.array(*[F.lit(w) for w in V.COMPLETENESS_TERMS]))
    raw = F.regexp_replace(T.squash(col), r"^[ .?!]+|[ .?!]+$", "")
    return {
        "short_query": F.size(F.split(F.trim(col), r"\s+")) <= 5,
        "list_query": head.rlike("|".join(V.LIST_PREFIX_PATTERNS)) | complete | n.rlike(V.LIST_RELATION_PATTERN),
        "relationship_query": n.rlike(V.RELATIONSHIP_QUERY_PATTERN),
        "identity_query": T.any_phrase(pad, V.IDENTITY_QUERY_TERMS),
        "reference_request": T.any_phrase(pad, V.REFERENCE_REQUEST_TERMS),
        "temporal_comparison": F.lower(raw).rlike("|".join(V.TEMPORAL_COMPARISON_PATTERNS)),
        "compound_query": F.size(split_facets(col)) >= 2,
    }


def direct_relation_kind(col: Column, n: Column | None = None) -> Column:
    n = T.normalize_text(col) if n is None else n
    chain = None
    for kind, pattern in V.RELATION_KIND_PATTERNS:
        chain = F.when(n.rlike(pattern), kind) if chain is None else chain.when(n.rlike(pattern), kind)
    return chain.otherwise("")


def relation_anchors(col: Column, kind: Column, n: Column | None = None) -> Column:
    """Up to eight content tokens that are neither common nor part of the relation wording."""
    own = None
    for name, words in V.RELATION_KIND_WORDS.items():
        arr = F.array(*[F.lit(w) for w in words.split()])
        own = F.when(kind == name, arr) if own is None else own.when(kind == name, arr)
    own = own.otherwise(F.array().cast("array<string>"))
    tokens = F.array_distinct(F.filter(F.split(T.normalize_text(col) if n is None else n, " "), T._keep(V.RELATION_COMMON_WORDS)))
    return F.slice(F.array_except(tokens, own), 1, 8)


_SPLIT = rf"(?i)(?:\s+\b(?:and|at)\b\s+(?:also\s+|din\s+|rin\s+)?(?={_REQUEST}\b)|[?;]\s*(?:please\s+|paki\s*)?(?={_REQUEST}\b))"
FACET_LEAD = r"(?i)^(?:please\s+)?(?:explain|describe|ipaliwanag|ilarawan)\s+"


def split_facets(col: Column) -> Column:
    """Parts of a compound or two-event question; empty when it is a single request."""
    clean = F.regexp_replace(T.squash(col), FACET_LEAD, "")
    strip = lambda x: F.regexp_replace(x, r"^[ .?;:]+|[ .?;:]+$", "")
    parts = F.filter(F.transform(F.split(clean, _SPLIT), strip), lambda x: x != "")
    chain = F.when(F.size(parts) >= 2, F.slice(parts, 1, 4))
    for pattern in V.FACET_PAIR_PATTERNS:
        p = "(?i)" + pattern
        chain = chain.when(
            clean.rlike(p), F.array(F.trim(F.regexp_extract(clean, p, 1)), F.trim(F.regexp_extract(clean, p, 2)))
        )
    return chain.otherwise(F.array().cast("array<string>"))


def facet_queries(facets: Column) -> Column:
    """Search text per facet: later pronoun-heavy or thin facets borrow the first facet's anchors."""
    anchor = F.array_join(
        F.slice(
            F.filter(F.split(T.normalize_text(F.element_at(facets, 1)), " "), T._keep(V.FACET_ANCHOR_STOP_WORDS)), 1, 5
        ),
        " ",
    )

    def build(facet: Column, i: Column) -> Column:
        n = T.normalize_text(facet)
        q = F.concat(
            facet,
            F.when(n.rlike(r"\b(pagpirma|nilagdaan|lumagda|pinirmahan)\b"), " signed signing date").otherwise(""),
            F.when(n.rlike(r"\b(deklarasyon|idineklara|declaration|declared)\b"), " declaration declared date").otherwise(""),
        )
        thin = T.any_phrase(T.padded(n), V.FACET_PRONOUNS) | (F.size(T.query_topic_tokens(facet)) <= 2)
        return F.when((i > 0) & (anchor != "") & thin, F.concat(facet, F.lit(" "), anchor)).otherwise(q)

    return F.when(F.size(facets) >= 2, F.transform(facets, build)).otherwise(F.array().cast("array<string>"))


def binary_variants(df: DataFrame, question: str) -> DataFrame:
    """Adds ``variant_a`` and ``variant_b``: focused rewrites of "not sure whether A or B"; NULL elsewhere."""
    kept = df.columns
    lead = r"\b(?:(?:i(?:'m| am)|we(?:'re| are))\s+)?(?:not\s+sure|unsure|uncertain)\s+(?:whether|if)\s+"
    edge, boundary, pair = r"^[ ,;:-]+|[ ,;:-]+$", r"^(.*?)[.!?](?:\s+|$)(.*)$", r"(?i)^(.*?)\s+or\s+(.*)$"
    st = df.withColumn("_raw", T.squash(F.col(question)))
    head = F.trim(F.regexp_extract("_raw", f"^(.*?)(?i:{lead})", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"(?i)\b(but|and)\s*$", ""), edge, "")
    st = st.withColumns({"_body": F.trim(F.regexp_extract("_raw", f"(?i){lead}(.+)$", 1)), "_head": head})
    cut = F.col("_body").rlike(boundary)
    st = st.withColumns(
        {
            "_amb": F.trim(F.when(cut, F.regexp_extract("_body", boundary, 1)).otherwise(F.col("_body"))),
            "_suffix": F.trim(F.when(cut, F.regexp_extract("_body", boundary, 2)).otherwise("")),
        }
    )
    left = F.regexp_replace(F.regexp_extract("_amb", pair, 1), edge, "")
    left = F.trim(F.regexp_replace(left, r"(?i)^(the\s+)?(concern|issue|question|problem|risk)\s+is\s+", ""))
    st = st.withColumns({"_l": left, "_r": F.regexp_replace(F.regexp_extract("_amb", pair, 2), edge, "")})

    def compose(facet: str) -> Column:
        end = r"[.?!]+$"
        lead_in = F.when(F.col("_head") != "", F.concat(F.regexp_replace("_head", end, ""), F.lit(". "))).otherwise("")
        return T.squash(F.concat(lead_in, F.lit("Focus on "), F.regexp_replace(facet, end, ""), F.lit(". "), F.col("_suffix")))

    st = st.withColumns({"_a": compose("_l"), "_b": compose("_r")})
    words = lambda c: F.regexp_count(F.col(c), F.lit("[A-Za-z0-9]+"))
    ok = (words("_l") >= 2) & (words("_r") >= 2) & (F.lower("_a") != F.lower("_b"))
    return st.select(*kept, F.when(ok, F.col("_a")).alias("variant_a"), F.when(ok, F.col("_b")).alias("variant_b"))


def _variant_ids(col: Column) -> Column:
    ids = F.regexp_extract_all(F.lower(col), F.lit("(" + V.VARIANT_REFERENCE + ")"), F.lit(1))
    return F.transform(ids, lambda x: F.regexp_replace(x, r"\s+", " "))


def validate_variants(question: Column, candidates: Column) -> Column:
    """At most two safe rewrites, in order."""
    q = T.squash(question)
    known = _variant_ids(q)

    def tidy(c: Column) -> Column:
        line = T.squash(F.regexp_replace(c, r"^[\"'` ]+|[\"'` ]+$", ""))
        return F.trim(F.regexp_replace(line, r"[.;]$", ""))

    ok = F.filter(
        F.transform(candidates, tidy),
        lambda c: (c != "")
        & (F.length(c) <= V.MAX_VARIANT_CHARS)
        & (F.size(F.array_except(_variant_ids(c), known)) == 0)
        & ~F.lower(c).rlike(V.ANSWER_LIKE_VARIANT)
        & (F.lower(c) != F.lower(q)),
    )
    return F.slice(distinct_ci(ok), 1, V.MAX_VARIANTS)


def parse_variants(raw: Column, question: Column) -> Column:
    """Strict JSON ``{"queries": [..2..]}``, else one rewrite per line."""
    t = F.trim(raw)
    is_object = t.startswith("{") & F.get_json_object(t, "$").isNotNull()
    parsed = F.from_json(t, "queries array<string>")
    strict = (F.json_object_keys(t) == F.array(F.lit("queries"))) & (F.size(parsed["queries"]) == V.MAX_VARIANTS)
    lines = F.transform(
        F.split(t, r"\r?\n"),
        lambda x: F.regexp_replace(
            F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")), r"(?i)^(query|variant|alternative)\s*:\s*", ""
        ),
    )
    candidates = F.when(is_object, F.when(strict, parsed["queries"])).otherwise(lines)
    return F.coalesce(validate_variants(question, candidates), F.array().cast("array<string>"))


def variant_gate(col: Column) -> Column:
    """Questions worth rewriting: no exact reference, three words or more, no direct relation."""
    low = F.lower(col)
    exact = low.rlike(V.RULE_REFERENCE) | low.rlike(V.GROUPED_REFERENCE)
    return ~exact & (F.size(F.split(T.squash(col), " ")) >= 3) & (direct_relation_kind(col) == "")


def combine_queries(a: Column, b: Column) -> Column:
    return F.array_join(distinct_ci(F.array(T.squash(a), T.squash(F.coalesce(b, F.lit(""))))), " | ")


def canonical_relation_query(col: Column) -> Column:
    """English relation wording for Tagalog questions; empty when nothing was recognised."""
    clean = T.squash(col)
    out = clean
    for pattern, repl in V.RELATION_PHRASES:
        out = F.regexp_replace(out, "(?i)" + pattern, repl)
    seen = F.lower(clean).rlike("|".join(p for p, _ in V.RELATION_PHRASES))
    out = F.regexp_replace(out, "(?i)" + V.RELATION_PARTICLES, " ")
    out = T.squash(F.regexp_replace(out, r"[?!.]+$", ""))
    return F.when(seen, out).otherwise("")


def is_english(col: Column) -> Column:
    clean = T.squash(F.lower(col))
    first = F.regexp_extract(clean, "^[a-z]+", 0)
    words = F.array_distinct(F.regexp_extract_all(clean, F.lit("([a-z]+)"), F.lit(1)))
    lit = lambda ws: F.array(*[F.lit(w) for w in ws])
    return (
        F.when(F.coalesce(clean, F.lit("")) == "", True)
        .when(clean.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), False)
        .when(clean.rlike(r"^may\s+(a|an|the|this|that|these|those)\b"), True)
        .when(first.isin(V.TAGALOG_QUESTION_WORDS), False)
        .when(clean.rlike(V.TAGALOG_PHRASES), False)
        .when(first.isin(V.ENGLISH_STARTERS), True)
        .when(F.size(F.array_intersect(words, lit(V.TAGALOG_FUNCTION_WORDS))) >= 2, False)
        .when(F.arrays_overlap(words, lit(V.ENGLISH_FUNCTION_WORDS)), True)
        .when((F.size(words) >= 2) & F.arrays_overlap(words, lit(V.ENGLISH_DOCUMENT_TERMS)), True)
        .otherwise(False)
    )


def scope_guards(col: Column) -> dict[str, Column]:
    clean = T.squash(F.lower(col))
    outside = clean.rlike(V.OUTSIDE_INSTRUCTION) | (clean.rlike(V.MISSING_SCOPE) & clean.rlike(V.SCOPE_OVERRIDE))
    fresh = clean.rlike(V.FRESHNESS) & clean.contains("misra") & clean.rlike(V.RELEASE_WORDS)
    return {"outside_request": outside, "freshness_request": fresh | clean.rlike(V.CURRENT_ROLE)}
