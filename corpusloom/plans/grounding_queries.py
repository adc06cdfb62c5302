"""Grounding and answer post-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fusion as FU
from corpusloom.operators import grounding as GR
from corpusloom.operators import lexical as L
from corpusloom.operators.scale import top_k_per
from corpusloom.operators.structure import label_value_pairs
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.lexical_queries import bm25_sql
from corpusloom.plans.reference_queries import _W as STD_W
from corpusloom.plans.reference_queries import standards
from corpusloom.plans.registry import ORACLES, query
from corpusloom.plans.structure_queries import LABELLED_SQL, labelled_texts


def answers(spark, sf):
    """Every document answers itself; English answers get invented facts on top."""
    extra = F.when(F.col("lang") == "en", " Acme Global Holdings paid 4711 days to XQZK under Rule 99.7.").otherwise("")
    return X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("answer_id"), F.lit("what does rule 3.2 say").alias("question"), F.col("text").alias("context"),
        F.concat(F.coalesce(F.get(GR.sentences(F.col("text")), F.lit(0)), F.lit("")), extra).alias("answer"))


@query(
    "claim_grounding",
    """SELECT doc_id AS answer_id, lang <> 'en' AS ok, CASE WHEN lang = 'en' THEN 'rule 99.7' ELSE '' END AS bad_refs, CASE WHEN lang = 'en' THEN '4711 days,99.7' ELSE '' END AS bad_numbers,
 CASE WHEN lang = 'en' THEN 'XQZK' ELSE '' END AS bad_acronyms FROM documents""".replace("'4711 days,99.7'", "'4711,99.7'"),
)
def _(spark, sf):
    """The invented facts, and only they, must be flagged."""
    g = GR.claim_grounding(answers(spark, sf))
    j = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("answer_id", "ok", j("bad_refs").alias("bad_refs"), j("bad_numbers").alias("bad_numbers"), j("bad_acronyms").alias("bad_acronyms"))


@query(
    "references_grounded",
    STD_W + """ SELECT chunk_key, len(list_filter(c, lambda x: x NOT IN (SELECT rule_id FROM std WHERE section_role = 'requirement'))) = 0 AS grounded FROM (SELECT chunk_key, regexp_extract_all(text, 'Rule ([0-9]+\\.[0-9]+)', 1) AS c FROM std WHERE section_role = 'cross_reference')""".replace(
        "len(list_filter(c, lambda x: x NOT IN (SELECT rule_id FROM std WHERE section_role = 'requirement'))) = 0", "list_has_all((SELECT list(rule_id) FROM std WHERE section_role = 'requirement'), c)"),
)
def _(spark, sf):
    """Cross references against the rules that exist: exploded and joined, never one big list."""
    s = standards(spark, sf)
    c = s.where("section_role = 'cross_reference'").select("chunk_key", F.explode(F.regexp_extract_all("text", F.lit(r"Rule ([0-9]+\.[0-9]+)"), F.lit(1))).alias("rule_id"))
    known = s.where("section_role = 'requirement'").select("rule_id").distinct().withColumn("k", F.lit(1))
    g = c.join(known, "rule_id", "left").groupBy("chunk_key").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("m"))
    return g.select("chunk_key", (F.col("n") == F.col("m")).alias("grounded"))


def contract_inputs(spark, sf):
    s = standards(spark, sf).where("section_role IN ('rationale', 'example')")
    ans = F.when(F.col("section_role") == "example", F.lit("Yes.")).when(F.col("category") == "Advisory", F.concat(F.lit("No, "), F.col("text"))).otherwise(F.col("text"))
    return s.select(F.col("chunk_key").alias("answer_id"), F.lit("which rule applies").alias("question"), ans.alias("answer"), F.array(F.concat(F.lit("Rule "), F.col("rule_id"))).alias("references"))


@query(
    "verified_contract",
    STD_W + """ SELECT chunk_key AS answer_id, CASE WHEN section_role = 'example' THEN 'replaced' ELSE 'prefixed' END AS action, CASE WHEN section_role = 'example' THEN 'Yes. Rule ' || rule_id || ' is the applicable requirement.'
 WHEN category = 'Advisory' THEN 'No. Rule ' || rule_id || ': ' || text ELSE 'Rule ' || rule_id || ': ' || text END AS final_answer FROM std WHERE section_role IN ('rationale','example')""",
)
def _(spark, sf):
    return GR.verified_contract(contract_inputs(spark, sf)).select("answer_id", "action", "final_answer")


@query("prompt_leak", f"SELECT doc_id, {D.rx('text', GR.LEAK_PATTERNS)} AS leak, {D.rx(D.fold('text'), '[a-z0-9]')} AS substantive FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", GR.prompt_leak(F.col("text")).alias("leak"), GR.substantive(F.col("text")).alias("substantive"))


@query("strip_wrappers", "SELECT doc_id, trim(text) AS answer FROM documents")
def _(spark, sf):
    wrapped = F.concat(F.lit("Based on the provided context, "), F.trim("text"))
    return X.table(spark, sf, "documents").select("doc_id", GR.strip_wrappers(wrapped).alias("answer"))


_L1 = "string_split(text, chr(10))[1]"
_TK = lambda x: f"list_distinct(string_split({D.norm(x)}, ' '))"


@query(
    "drop_repeated_question",
    f"""SELECT doc_id, CASE WHEN len(list_intersect({_TK(_L1)}, {_TK('q')})) / len({_TK(_L1)}) >= 0.8 AND trim(substr(text, length({_L1}) + 2)) <> '' THEN trim(substr(text, length({_L1}) + 2)) ELSE text END AS answer
 FROM (SELECT *, 'Is it so: ' || CASE WHEN lang = 'en' THEN {_L1} ELSE source END AS q FROM documents)""",
)
def _(spark, sf):
    q = F.concat(F.lit("Is it so: "), F.when(F.col("lang") == "en", F.substring_index("text", "\n", 1)).otherwise(F.col("source")))
    return X.table(spark, sf, "documents").select("doc_id", GR.drop_repeated_question(F.col("text"), q).alias("answer"))


def _pairs(spark, sf, k=10):
    c, q = X.corpus(spark, sf), X.queries(spark, sf)
    return FU.with_text(L.bm25_topk(c, q, k), c, q)


_SENT = "list_filter(list_transform(string_split_regex(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"


@query(
    "best_fact_sentence",
    f"""SELECT query_id, rank, overlap, sentence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank, pos) AS r FROM (SELECT query_id, rank, pos, sentence, len(list_intersect(qt, {D.meaningful('sentence')})) AS overlap FROM (
 SELECT query_id, rank, {D.meaningful('query')} AS qt, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS pos FROM (SELECT query_id, rank, query, {_SENT.format(x='text')} AS ss FROM ({bm25_sql(3)}) JOIN ({X.QUERIES_SQL}) USING (query_id) JOIN ({X.CORPUS_SQL}) USING (chunk_key)))) WHERE overlap > 0) WHERE r = 1""",
)
def _(spark, sf):
    return GR.best_fact_sentence(_pairs(spark, sf, 3)).select("query_id", F.col("rank").cast("bigint"), "overlap", "sentence")


@query(
    "supporting_sources",
    f"""SELECT query_id, chunk_key, n_facts, row_number() OVER (PARTITION BY query_id ORDER BY n_facts DESC, rank) AS pos FROM (SELECT query_id, chunk_key, rank,
 len(list_filter({_SENT.format(x='query')}, lambda s: length(s) >= 18 AND contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), s))) AS n_facts FROM ({bm25_sql(10)}) JOIN ({X.QUERIES_SQL}) USING (query_id) JOIN ({X.CORPUS_SQL}) USING (chunk_key))""",
)
def _(spark, sf):
    p = _pairs(spark, sf).withColumn("answer", F.col("query"))
    return GR.supporting_sources(p).select("query_id", "chunk_key", "n_facts", F.col("pos").cast("bigint"))


@query(
    "source_citations",
    f"""SELECT query_id, file_key, pos FROM (SELECT query_id, file_key, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS pos FROM ({bm25_sql(10)}) JOIN ({X.CORPUS_SQL}) USING (chunk_key) GROUP BY query_id, file_key) WHERE pos <= 3""",
)
def _(spark, sf):
    f = _pairs(spark, sf).groupBy("query_id", "file_key").agg(F.min("rank").alias("first"))
    return top_k_per(f, ["query_id"], [F.col("first").asc()], 3, "pos").select("query_id", "file_key", F.col("pos").cast("bigint"))


@query(
    "aggregate_sources",
    f"SELECT query_id, file_key, count(*) AS n_chunks, min(chunk_key) AS first_chunk, max(chunk_key) AS last_chunk FROM ({bm25_sql(10)}) JOIN ({X.CORPUS_SQL}) USING (chunk_key) GROUP BY query_id, file_key",
)
def _(spark, sf):
    return _pairs(spark, sf).groupBy("query_id", "file_key").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_key").alias("first_chunk"), F.max("chunk_key").alias("last_chunk"))


def order_texts(spark, sf):
    """One sentence per order with a signing and an ending date."""
    o = X.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    end = F.date_add(d, F.length("o_orderstatus") * 30)
    return o.select("o_orderkey", F.concat(
        F.lit("Order "), F.col("o_orderkey"), F.lit(" was signed on "), d.cast("string"), F.lit(" by the clerk and ended on "), end.cast("string"),
        F.when(F.col("o_orderstatus") == "F", F.lit("; a copy dated 1999-12-31 exists")).otherwise("")).alias("text"))


_OD = "o_orderdate::DATE"


@query("relation_dates", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND {_OD} <> DATE '1999-12-31' THEN NULL ELSE strftime({_OD}, '%Y-%m-%d') END AS date FROM orders")
def _(spark, sf):
    return GR.relation_dates(order_texts(spark, sf), "o_orderkey", "signed")


@query("temporal_compare", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND {_OD} <> DATE '1999-12-31' THEN 'unknown' ELSE 'before' END AS \"order\" FROM orders")
def _(spark, sf):
    return GR.temporal_compare(order_texts(spark, sf), "o_orderkey", "signed", "ended").select("o_orderkey", "order")


@query("temporal_retry")
def _(spark, sf):
    """Comparisons that stayed open are tried again without the conflicting copies."""
    t = order_texts(spark, sf)
    first = GR.temporal_compare(t, "o_orderkey", "signed", "ended")
    open_t = t.join(first.where("order = 'unknown'").select("o_orderkey"), "o_orderkey", "left_semi")
    again = GR.temporal_compare(open_t.withColumn("text", F.substring_index("text", ";", 1)), "o_orderkey", "signed", "ended")
    return first.where("order <> 'unknown'").unionByName(again).select("o_orderkey", "order")


@query(
    "relation_facts",
    """SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS signed, strftime(o_orderdate::DATE + INTERVAL (30 * length(o_orderstatus)) DAY, '%Y-%m-%d') AS ended,
 CASE WHEN o_orderstatus = 'F' THEN '1999-12-31' END AS copied FROM orders""",
)
def _(spark, sf):
    """Explicit date values per relation from every order text."""
    return GR.relation_facts(order_texts(spark, sf), "o_orderkey", {"signed": "signed on", "ended": "ended on", "copied": "copy dated"})


_PAIRS = ORACLES["label_value_pairs"]
_HEAD = f"SELECT doc_id, {D.meaningful('head')} AS h FROM (SELECT doc_id, string_split(text, chr(10))[1] AS head FROM documents)"


@query(
    "label_fact",
    f"""SELECT doc_id, label, value, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, line_no) AS r FROM (
 SELECT doc_id, line_no, label, value, len(list_intersect(h, {D.meaningful('label')})) AS overlap FROM ({_PAIRS}) JOIN ({_HEAD}) USING (doc_id)) WHERE overlap > 0) WHERE r = 1""",
)
def _(spark, sf):
    """Each document is asked about the words of its first line."""
    asked = X.table(spark, sf, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("question"))
    return GR.label_fact(label_value_pairs(labelled_texts(spark, sf), "doc_id", "text"), asked, "doc_id")


@query("label_overview", f"SELECT doc_id, string_agg(label || ': ' || value, chr(10) ORDER BY line_no) AS overview FROM ({_PAIRS}) GROUP BY doc_id")
def _(spark, sf):
    return GR.label_overview(label_value_pairs(labelled_texts(spark, sf), "doc_id", "text"), "doc_id")


@query(
    "label_compare",
    f"""SELECT a.doc_id, a.label AS left_label, b.label AS right_label, CASE WHEN a.n > b.n THEN 'greater' WHEN a.n < b.n THEN 'smaller' ELSE 'equal' END AS verdict FROM ({{0}}) a JOIN ({{0}}) b ON a.doc_id = b.doc_id AND a.r = 1 AND b.r = 2""".format(
        f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS r FROM (SELECT doc_id, line_no, label, try_cast(regexp_extract(value, '([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE) AS n FROM (
 SELECT doc_id, line_no, label, value || ' takes ' || (doc_id * 31 + line_no * 17) % 13 AS value FROM ({_PAIRS}))) WHERE n IS NOT NULL"""
    ),
)
def _(spark, sf):
    """Every labelled value gets a number, so that most documents can be compared."""
    p = label_value_pairs(labelled_texts(spark, sf), "doc_id", "text")
    n = ((F.col("doc_id") * 31 + F.col("line_no") * 17) % 13).cast("string")
    return GR.label_compare(p.withColumn("value", F.concat("value", F.lit(" takes "), n)), "doc_id")


@query(
    "section_outline",
    f"""SELECT doc_id, ls[1] AS heading, ls[2] AS intro, len(list_filter(ls[3:], lambda x: {{short}})) AS n_subtopics, len(list_filter(ls[3:], lambda x: len(string_split(x, ' ')) >= 8 AND NOT {{short}})) AS n_key_points
 FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {D.squash('x')}), lambda x: x <> '') AS ls FROM ({LABELLED_SQL}))""".replace(
        "{short}", "(len(string_split(x, ' ')) <= 8 AND NOT regexp_matches(x, '[.!?;,]$'))"
    ),
)
def _(spark, sf):
    o = GR.section_outline(labelled_texts(spark, sf), "doc_id", "text")
    return o.select("doc_id", "heading", "intro", F.size("subtopics").cast("bigint").alias("n_subtopics"), F.size("key_points").cast("bigint").alias("n_key_points"))


@query(
    "family_answers",
    STD_W + """ SELECT major, string_agg(rule_id || ' (' || category || ')', '; ' ORDER BY minor) AS answer FROM std WHERE section_role = 'requirement' GROUP BY major""",
)
def _(spark, sf):
    s = standards(spark, sf).where("section_role = 'requirement'")
    item = F.concat("rule_id", F.lit(" ("), "category", F.lit(")"))
    g = s.groupBy("major").agg(F.array_sort(F.collect_list(F.struct("minor", item.alias("t")))).alias("ts"))
    return g.select("major", F.array_join(F.transform("ts", lambda x: x["t"]), "; ").alias("answer"))


@query(
    "generation_eval",
    STD_W + """ SELECT chunk_key AS answer_id, true AS has_reference, section_role = 'example' OR category = 'Advisory' AS has_polarity, true AS no_wrong_reference FROM std WHERE section_role IN ('rationale','example')""",
)
def _(spark, sf):
    """Corrected answers name their verified reference, keep their polarity and cite nothing else."""
    g = GR.verified_contract(contract_inputs(spark, sf))
    cited = F.regexp_extract_all("final_answer", F.lit(r"(Rule [0-9]+\.[0-9]+)"), F.lit(1))
    ref = F.get("references", F.lit(0))
    return g.select("answer_id", F.array_contains(cited, ref).alias("has_reference"), F.col("final_answer").rlike(r"^(Yes|No)\b").alias("has_polarity"),
                    (F.size(F.array_except(cited, "references")) == 0).alias("no_wrong_reference"))
