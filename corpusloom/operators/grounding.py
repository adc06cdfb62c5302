"""Deterministic grounding checks and answer post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.scale import top_k_per

# Claim patterns.
CITED = r"\b((?:rule|directive|dir|section|article|chapter|part)\.?\s+[0-9]+(?:\.[0-9]+)*)\b"
LIST_MARK = r"(?m)^\s*[0-9]+[.)]\s+"
NUMBER = r"(?i)(?:^|[^A-Za-z0-9_.])([0-9]+(?:\.[0-9]+)*(?:%|ms|s|secs?|seconds?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?|MB|GB|KB)?)"
PROPER_NAME = r"\b([A-Z][A-Za-z0-9_+#./-]*(?:\s+[A-Z][A-Za-z0-9_+#./-]*){1,4})\b"
ACRONYM = r"\b([A-Z][A-Z0-9_-]{2,})\b"
GENERIC_NAME_WORDS = (
    "the this that these those yes no needs assessment conclusion applicable required potential source company knowledge "
    "information rule directive section article chapter part misra c cpp"
).split()
LEAK_PATTERNS = r"(?i)(system prompt|as an ai|you are a helpful|context information is below|do not reveal|instructions above)"
WRAPPERS = r"(?i)^\s*(?:answer\s*:|final answer\s*:|response\s*:|based on the (?:provided |given )?(?:context|documents)\s*,?)\s*"


def _all(col: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)))


def _whole_number(number: Column) -> Column:
    """Pattern of a number that is no part of a longer one: 99.7 is not in 199.7, 3.99.7 or 99.71."""
    return F.concat(F.lit(r"(?<![0-9])(?<![0-9]\.)"), F.replace(number, F.lit("."), F.lit(r"\.")), F.lit(r"(?!\.?[0-9])"))


def claim_grounding(answers: DataFrame) -> DataFrame:
    """Claims of each answer that neither its context nor its question supports.

    ``answers(answer_id, question, context, answer)``; adds one list per claim kind and ``ok``.  A null text supports and claims nothing.
    """
    ev = F.concat(F.coalesce("context", F.lit("")), F.lit("\n"), F.coalesce("question", F.lit("")))
    a = answers.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumns({"ev": ev, "nev": T.normalize_grounding(ev)})
    names = F.filter(_all(F.col("answer"), PROPER_NAME), lambda n: F.size(F.filter(
        F.transform(F.split(F.lower(n), r"\s+"), lambda t: F.regexp_replace(t, r"^[.,:;()\[\]{}]+|[.,:;()\[\]{}]+$", "")),
        lambda t: (t != "") & ~t.isin(GENERIC_NAME_WORDS))) >= 2)
    low = F.lower("answer")
    a = a.withColumns({
        "bad_refs": F.filter(_all(low, CITED), lambda r: ~F.rlike("nev", _whole_number(F.regexp_extract(r, r"([0-9.]+)$", 1)))),
        "bad_numbers": F.array_except(_all(F.regexp_replace("answer", LIST_MARK, ""), NUMBER), _all(F.regexp_replace("ev", LIST_MARK, ""), NUMBER)),
        "bad_names": F.filter(names, lambda n: ~F.col("nev").contains(T.normalize_grounding(n))),
        "bad_acronyms": F.array_except(F.array_except(_all(F.col("answer"), ACRONYM), F.array(*[F.lit(x) for x in ("MISRA", "NOTE", "TODO")])), _all(F.col("ev"), ACRONYM)),
    })
    ok = F.size(F.concat("bad_refs", "bad_numbers", "bad_names", "bad_acronyms")) == 0
    return a.drop("ev", "nev").withColumn("ok", ok)


def references_grounded(cited: Column, available: Column) -> Column:
    """Both non-empty and nothing cited that is not available."""
    return (F.size(cited) > 0) & (F.size(available) > 0) & (F.size(F.array_except(cited, available)) == 0)


def verified_contract(answers: DataFrame) -> DataFrame:
    """Answers backed by exactly one verified reference name it; wrong scripts are replaced.

    ``answers(answer_id, question, answer, references)`` with an array of verified labels.
    """
    one = F.size("references") == 1
    ref = F.get("references", F.lit(0))
    drift = F.size(F.array_except(T.script_families("answer"), T.script_families("question"))) > 0
    missing = ~F.lower("answer").contains(F.lower(ref))
    wanted = F.lower("question").rlike(r"\b(rule|rules|directive|directives|requirement|requirements)\b")
    pol = F.initcap(F.regexp_extract(F.lower(F.trim("answer")), r"^(yes|no)\b", 1))
    rest = F.trim(F.regexp_replace(F.trim("answer"), r"(?i)^(yes|no)\s*[.!,:;\-]*\s*", ""))
    minimal = F.when(pol != "", F.concat(pol, F.lit(". "), ref, F.lit(" is the applicable requirement."))).otherwise(
        F.concat(F.lit("The applicable requirement is "), ref, F.lit(".")))
    prefixed = F.when(pol != "", F.concat(pol, F.lit(". "), ref, F.lit(": "), rest)).otherwise(F.concat(ref, F.lit(": "), F.trim("answer")))
    action = (
        F.when(~one | (F.trim("answer") == ""), "untouched").when(drift, "script_drift")
        .when(missing & wanted & (rest == ""), "replaced").when(missing & wanted, "prefixed").otherwise("untouched"))
    return answers.withColumns({
        "action": action,
        "final_answer": F.when(action.isin("script_drift", "replaced"), minimal).when(action == "prefixed", prefixed).otherwise(F.trim("answer"))})


def prompt_leak(col: Column) -> Column:
    return col.rlike(LEAK_PATTERNS)


def substantive(col: Column) -> Column:
    return T.fold_drop(col).rlike("[a-z0-9]")


def strip_wrappers(col: Column) -> Column:
    t = F.regexp_replace(F.trim(col), r"^```[a-z]*\n|\n?```$", "")
    return F.trim(F.regexp_replace(t, WRAPPERS, ""))


def drop_repeated_question(answer: Column, question: Column) -> Column:
    """Drops a leading line that echoes the question (token overlap of 80 % or more)."""
    line = F.substring_index(answer, "\n", 1)
    lt, qt = F.array_distinct(F.split(T.normalize_text(line), " ")), F.array_distinct(F.split(T.normalize_text(question), " "))
    echo = F.size(F.array_intersect(lt, qt)) / F.size(lt) >= 0.8
    rest = F.trim(F.substring(answer, F.length(line) + 2, F.length(answer)))
    return F.when(echo & (rest != ""), rest).otherwise(answer)


def sentences(col: Column) -> Column:
    return F.filter(F.transform(F.split(col, r"(?<=[.!?])\s+"), T.squash), lambda s: s != "")


def best_fact_sentence(pairs: DataFrame) -> DataFrame:
    """Sentence with the strongest overlap with the query among its ranked chunks.

    ``pairs(query_id, query, text, rank)``.
    """
    from corpusloom.operators.scale import top_k_per

    p = pairs.withColumn("qt", T.meaningful_tokens("query"))
    s = p.select("query_id", "qt", "rank", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("overlap", F.size(F.array_intersect("qt", T.meaningful_tokens("sentence"))).cast("bigint")).where("overlap > 0")
    return top_k_per(s.drop("qt"), ["query_id"], [F.col("overlap").desc(), F.col("rank").asc(), F.col("pos").asc()], 1, "r")


def supporting_sources(pairs: DataFrame, min_chars: int = 18) -> DataFrame:
    """Results ordered by how many fact lines of the answer they contain.

    ``pairs(query_id, chunk_key, rank, text, answer)``.
    """
    from pyspark.sql import Window

    facts = F.filter(sentences(F.col("answer")), lambda s: F.length(s) >= min_chars)
    body = T.squash("text")
    p = pairs.withColumn("n_facts", F.size(F.filter(facts, lambda s: body.contains(s))).cast("bigint"))
    w = Window.partitionBy("query_id").orderBy(F.col("n_facts").desc(), F.col("rank").asc())
    return p.withColumn("pos", F.row_number().over(w))


DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
RELATION_TERMS = {"signed": ["signed", "dated"], "ended": ["ended", "finished", "terminated"]}


def relation_dates(texts: DataFrame, key: str, relation: str) -> DataFrame:
    """The single date within 45 characters after a term of the relation; none when several differ."""
    terms = "|".join(RELATION_TERMS[relation])
    other = "|".join(t for r, ts in RELATION_TERMS.items() if r != relation for t in ts)
    spans = F.regexp_extract_all("text", F.lit(rf"(?i)\b(?:{terms})\b([^0-9]{{0,45}}[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"), F.lit(1))
    clean = F.filter(spans, lambda s: ~s.rlike(rf"(?i)\b({other})\b"))
    dates = F.array_distinct(F.transform(clean, lambda s: F.regexp_extract(s, DATE, 1)))
    return texts.select(key, F.when(F.size(dates) == 1, F.get(dates, F.lit(0))).alias("date"))


def temporal_compare(texts: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Binds two facets to one date each and compares their order."""
    a = relation_dates(texts, key, first).withColumnRenamed("date", "first_date")
    b = relation_dates(texts, key, second).withColumnRenamed("date", "second_date")
    c = F.when(F.col("first_date").isNull() | F.col("second_date").isNull(), "unknown").when(
        F.col("first_date") < F.col("second_date"), "before").when(F.col("first_date") > F.col("second_date"), "after").otherwise("same day")
    return a.join(b, key).withColumn("order", c)


def relation_facts(texts: DataFrame, key: str, relations: dict[str, str], value: str = r"([0-9-]+)") -> DataFrame:
    """One column per relation: the value right after its cue phrase, null where the cue has none."""
    found = lambda cue: F.nullif(F.regexp_extract("text", rf"\b{cue} {value}", 1), F.lit(""))
    return texts.select(key, *[found(cue).alias(name) for name, cue in relations.items()])


def label_fact(pairs: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """The labelled value whose label shares most content tokens with the question, the earliest of equals."""
    asked = questions.select(key, T.meaningful_tokens("question").alias("__q"))
    p = pairs.join(asked, key).withColumn("overlap", F.size(F.array_intersect("__q", T.meaningful_tokens("label"))).cast("bigint"))
    p = p.where("overlap > 0")
    return top_k_per(p, [key], [F.col("overlap").desc(), F.col("line_no").asc()], 1, "r").select(key, "label", "value", "overlap")


def label_overview(pairs: DataFrame, key: str) -> DataFrame:
    """All labelled values of one text as lines ``label: value``, in page order."""
    line = F.struct("line_no", F.concat_ws(": ", "label", "value").alias("t"))
    g = pairs.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("ts"))
    return g.select(key, F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("overview"))


def label_compare(pairs: DataFrame, key: str) -> DataFrame:
    """``left_label, right_label, verdict``: the first two labelled values of a text that hold a number, compared.

    Texts with fewer than two numbers are left out.
    """
    number = F.expr(r"try_cast(regexp_extract(value, '([0-9]+(?:[.][0-9]+)?)', 1) as double)")
    n = pairs.withColumn("__n", number).where("__n is not null")
    top = top_k_per(n, [key], [F.col("line_no").asc()], 2, "r")
    side = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    g = top.groupBy(key).agg(side(1, "label").alias("left_label"), side(2, "label").alias("right_label"), side(1, "__n").alias("a"), side(2, "__n").alias("b"), F.count(F.lit(1)).alias("k"))
    verdict = F.when(F.col("a") > F.col("b"), "greater").when(F.col("a") < F.col("b"), "smaller").otherwise("equal")
    return g.where("k = 2").select(key, "left_label", "right_label", verdict.alias("verdict"))


def section_outline(sections: DataFrame, key: str, text: str, point_words: int = 8, title_words: int = 8) -> DataFrame:
    """Heading, introduction, subtopic titles and key points of each section text.

    The first line is the heading and the second the introduction; later short lines without a closing mark
    are subtopic titles, lines of at least ``point_words`` words are key points.
    """
    ls = F.filter(F.transform(F.split(text, "\n"), T.squash), lambda x: x != "")
    rest = F.slice("ls", 3, F.greatest(F.size("ls") - 2, F.lit(0)))
    short = lambda x: (T.word_count(x) <= title_words) & ~x.rlike(r"[.!?;,]$")
    d = sections.select(key, ls.alias("ls"))
    return d.select(
        key, F.get("ls", F.lit(0)).alias("heading"), F.get("ls", F.lit(1)).alias("intro"),
        F.filter(rest, short).alias("subtopics"), F.filter(rest, lambda x: (T.word_count(x) >= point_words) & ~short(x)).alias("key_points"))
