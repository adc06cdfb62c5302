"""Text function queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vocab as V
from corpusloom.plans import duck as D
from corpusloom.plans import fixtures as X
from corpusloom.plans.registry import query

_CLEAN = "translate(text, chr(13)||'‘’“”–—•'||chr(160), chr(10)||'''''\"\"---'||' ')"
for _p, _r in [
    (r"(?im)^page\s+\d+\s*$", ""), (r"(?im)^page\s+\d+\s+of\s+\d+\s*$", ""), (r"[-_=]{5,}", ""), (r"\n{3,}", "\n\n"),
    (r"[ \t]+", " "), (r"\s+\n", "\n"), (r"\n\s+\n", "\n\n"), (r"^\s+|\s+$", ""),
]:
    _CLEAN = D.rsub(_CLEAN, _p, _r)


@query("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("cleaned"))


@query(
    "tokenize_bm25",
    f"SELECT doc_id, len({D.tokens('text')}) AS n_tokens, array_to_string({D.tokens('text')}, ' ') AS tokens FROM documents",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", T.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("normalize_text", f"SELECT doc_id, {D.norm('text')} AS normalized FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("normalized"))


@query(
    "normalize_grounding",
    f"SELECT doc_id, replace({D.squash(D.fold('text'))}, 'ß', 'ss') AS normalized FROM documents",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.normalize_grounding("text").alias("normalized"))


def _vocabulary(spark, sf):
    d = X.table(spark, sf, "documents")
    return d.select(F.explode(F.array_distinct(T.tokenize("text"))).alias("term")).distinct()


_VOCAB_SQL = f"SELECT DISTINCT unnest({D.tokens('text')}) AS term FROM documents"


@query("light_stem", f"SELECT term, {D.stem('term')} AS stem FROM ({_VOCAB_SQL})")
def _(spark, sf):
    return _vocabulary(spark, sf).select("term", T.light_stem(F.col("term")).alias("stem"))


@query("catalog_stem", f"SELECT term, {D.catalog_stem('term')} AS stem FROM ({_VOCAB_SQL})")
def _(spark, sf):
    return _vocabulary(spark, sf).select("term", T.catalog_stem(F.col("term")).alias("stem"))


_MT = f"""SELECT doc_id, {D.meaningful('text')} AS mt FROM documents"""


@query(
    "meaningful_tokens",
    f"SELECT doc_id, len(mt) AS n_tokens, array_to_string(list_sort(mt), ' ') AS tokens FROM ({_MT})",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", T.meaningful_tokens("text").alias("mt"))
    return d.select(
        "doc_id", F.size("mt").cast("bigint").alias("n_tokens"), F.array_join(F.sort_array("mt"), " ").alias("tokens")
    )


_URL_FILE = "url_file"
_TITLE_SQL = "regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '[^A-Za-zÀ-ÿ ]', '', 'g')"


def page_files(spark, sf):
    """File names as the crawl would store them: title plus a suffix that varies with the page."""
    title = F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)</title>", 1), "[^A-Za-zÀ-ÿ ]", "")
    suffix = X.case_of(F.col("page_id"), [" (1898) - Wikipedia.pdf", "_FromInternet.docx", ".txt", " in the overview.pdf"])
    return X.table(spark, sf, "pages").select("page_id", F.concat(title, suffix).alias("file_name"))


PAGE_FILES_SQL = f"""SELECT page_id, {_TITLE_SQL} ||
 [' (1898) - Wikipedia.pdf','_FromInternet.docx','.txt',' in the overview.pdf'][page_id % 4 + 1] AS file_name FROM pages"""


def _duck_stem(x: str, parens: bool = True) -> str:
    t = D.rsub(f"trim({x})", r"\.[^.]+$")
    t = D.rsub(t, r"(?i)\s*-\s*Wikipedia$")
    t = D.rsub(t, r"(?i)[_\s-]*FromInternet$")
    return D.rsub(t, r"\([^)]*\)", " ") if parens else t


_FT = D.topic_words(D.norm(_duck_stem("file_name")), V.FILE_FILLER_WORDS)


@query(
    "file_topic_tokens",
    f"SELECT page_id, array_to_string({D.ordered_distinct('ft')}, ' ') AS topic FROM (SELECT page_id, {_FT} AS ft FROM ({PAGE_FILES_SQL}))",
)
def _(spark, sf):
    return page_files(spark, sf).select("page_id", F.array_join(T.file_topic_tokens("file_name"), " ").alias("topic"))


@query(
    "canonical_topic",
    f"SELECT page_id, nullif({D.squash(_duck_stem('file_name', False))}, '') AS topic FROM ({PAGE_FILES_SQL})",
)
def _(spark, sf):
    return page_files(spark, sf).select("page_id", T.canonical_topic("file_name").alias("topic"))


@query("decode_unicode_markers")
def _(spark, sf):
    """File names with accented letters stored as markers, decoded back."""
    marked = page_files(spark, sf)
    letters = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
    col = F.col("file_name")
    for ch in letters:
        col = F.replace(col, F.lit(ch), F.lit(f"#U{ord(ch):04x}"))
    return marked.select("page_id", col.alias("stored_name"), T.decode_unicode_markers(col).alias("file_name"))


@query(
    "text_shape_metrics",
    f"""SELECT doc_id, {D.count_rx('text', r'\S+')} AS n_words, {D.count_rx('text', '[.!?]')} AS n_sentence_marks,
 {D.count_rx('text', r'[^\n]*\S[^\n]*')} AS n_lines,
 {D.count_rx('text', r'(?m)^[ \t]*(?:[-*+][ \t]+|[0-9]+[.)][ \t]+)')} AS n_bullets,
 {D.count_rx('text', ',')} AS n_commas, {D.count_rx('text', ';')} AS n_semicolons,
 {D.citation_score('text')}::BIGINT AS citation_score FROM documents""",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id",
        T.word_count("text").alias("n_words"),
        T.sentence_count("text").alias("n_sentence_marks"),
        T.line_count("text").alias("n_lines"),
        T.bullet_count("text").alias("n_bullets"),
        F.regexp_count("text", F.lit(",")).cast("bigint").alias("n_commas"),
        F.regexp_count("text", F.lit(";")).cast("bigint").alias("n_semicolons"),
        T.citation_score("text").alias("citation_score"),
    )


_N = f"SELECT doc_id, text, {D.pad('text')} AS p FROM documents"


@query("reference_noise", f"SELECT doc_id, {D.reference_noise('text', 'p')}::BIGINT AS noise FROM ({_N})")
def _(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("p", T.padded(T.normalize_text("text")))
    return d.select("doc_id", T.reference_noise("text", F.col("p")).alias("noise"))


@query(
    "definition_signal",
    f"""SELECT doc_id, {D.any_phrase('p', V.DEFINITION_SIGNALS)} AS has_definition,
 {D.phrase_hits('p', V.IDENTITY_NOISE_TERMS)}::BIGINT AS identity_noise FROM ({_N})""",
)
def _(spark, sf):
    d = X.table(spark, sf, "documents").withColumn("p", T.padded(T.normalize_text("text")))
    return d.select(
        "doc_id",
        T.has_definition(F.col("p")).alias("has_definition"),
        T.identity_noise(F.col("p")).alias("identity_noise"),
    )


@query("identity_noise", f"SELECT page_id, {D.phrase_hits(D.pad('html'), V.IDENTITY_NOISE_TERMS)}::BIGINT AS noise FROM pages")
def _(spark, sf):
    p = T.padded(T.normalize_text("html"))
    return X.table(spark, sf, "pages").select("page_id", T.identity_noise(p).alias("noise"))


@query("is_reference_section", f"SELECT doc_id, {D.is_reference_section('text')} AS is_reference FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.is_reference_section("text").alias("is_reference"))


@query("script_families")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.array_join(T.script_families("text"), ",").alias("scripts"))


@query(
    "doc_key",
    """SELECT page_id, regexp_replace(regexp_replace(lower(replace('C:/Corpus/' || url, '/', chr(92))), '[\\\\/]+', '/', 'g'),
 '^c:/corpus/', '') AS doc_key FROM pages""",
)
def _(spark, sf):
    path = F.translate(F.concat(F.lit("C:/Corpus/"), F.col("url")), "/", "\\")
    return X.table(spark, sf, "pages").select("page_id", T.doc_key(path, "C:\\Corpus").alias("doc_key"))


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@query("record_id")
def _(spark, sf):
    return X.chunks(spark, sf).select("file_key", "chunk_id", T.record_id("file_key", "chunk_id").alias("record_id"))


@query(
    "l2_normalize",
    """SELECT vec_id, round(sqrt(list_sum(list_transform(n, lambda v: v*v))), 6) AS norm_after,
 round(n[1], 6) AS first_value, round(n[64], 6) AS last_value, len(n) AS dim
 FROM (SELECT vec_id, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w*w)))) AS n
 FROM (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * (1 + label)) AS e FROM embeddings))""",
)
def _(spark, sf):
    e = X.table(spark, sf, "embeddings")
    n = T.l2_normalize(F.transform("embedding", lambda v: v.cast("double") * (F.col("label") + 1)))
    return e.select("vec_id", n.alias("n")).select(
        "vec_id",
        F.round(T.norm("n"), 6).alias("norm_after"),
        F.round(F.col("n")[0], 6).alias("first_value"),
        F.round(F.col("n")[63], 6).alias("last_value"),
        F.size("n").cast("bigint").alias("dim"),
    )


@query(
    "truncate",
    "SELECT doc_id, left(text, 3000) AS rescore_text, left(text, 700) AS preview_text, left(text, 240) AS trace_text FROM documents",
)
def _(spark, sf):
    return X.table(spark, sf, "documents").select(
        "doc_id",
        F.substring("text", 1, 3000).alias("rescore_text"),
        F.substring("text", 1, 700).alias("preview_text"),
        F.substring("text", 1, 240).alias("trace_text"),
    )
