"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    decontaminate,
    hard_negatives,
    html_extract,
    line_dedup,
    lm_score,
    mixing,
    near_dedup,
    packing,
    ranked_search,
    secrets,
    suffix_dedup,
    toxicity,
    vector_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


_OP4_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM asked WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_benchmark_decontamination", _OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


@query("op7_minhash_near_dedup", _OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4, threshold=(80, 100))
    return groups.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def fold_of(key: str, folds: int):
    """crc32 of an id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(0))


_OP8_SQL = r"""
WITH rules(kind, no, pat, grp, least, base) AS (VALUES
  ('assign', 1, '(?:(?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', 1, 6, true),
  ('access', 2, 'AKIA[A-Z0-9]+', 0, 20, true),
  ('hex', 3, '[0-9a-f]+', 0, 24, true),
  ('private_key', 4, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1, false),
  ('web_token', 5, 'eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}', 0, 1, false),
  ('host_token', 6, '(?:gh[pousr]_|xox[abprs]-)[A-Za-z0-9-]{{20,}}', 0, 1, false)),
parts AS ({parts}),
hits AS (
  SELECT doc_id, kind, no, base, counted, least,
         sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) - size AS s, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e
  FROM (SELECT doc_id, kind, no, base, least, unnest(generate_series(1, len(m))) AS i,
               unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(c, lambda x: length(x))) AS counted,
               unnest(list_transform(g[: len(m)], lambda x: length(x))) AS gap FROM parts)),
good AS (SELECT * FROM hits WHERE counted >= least),
by_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint), ',' ORDER BY s, no) FILTER (base) AS b,
         string_agg(kind || ':' || cast(s AS bigint) || ':' || cast(e AS bigint), ',' ORDER BY s, no) AS spans
  FROM good GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN by_doc USING (doc_id)
"""
_OP8_PART = """SELECT doc_id, kind, no, base, least, regexp_extract_all(coalesce(text, ''), '{pat}', 0) AS m,
       regexp_extract_all(coalesce(text, ''), '{pat}', {grp}) AS c, string_split_regex(coalesce(text, ''), '{pat}') AS g
  FROM documents, rules WHERE no = {no}"""


def _op8_sql() -> str:
    """DuckDB wants the pattern as a constant, so each rule is a branch of its own."""
    pats = re.findall(r"\('(\w+)', (\d), '((?:[^']|'')+)', (\d), \d+", _OP8_SQL.replace("\\'", "''").replace("{{", "{").replace("}}", "}"))
    parts = " UNION ALL ".join(_OP8_PART.format(pat=p, grp=g, no=no) for _, no, p, g in pats)
    return _OP8_SQL.replace("\\'", "''").replace("{parts}", parts).replace("{{", "{").replace("}}", "}")


@query("op8_secret_scans", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, found = secrets.scan(versions)
    rows = secrets.findings(versions, found)
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:long, no:long, end:long, kind:string>>)"))
    base = F.filter(spans, lambda s: s["no"] <= len(secrets.BASE_RULES))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE_RULES],
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(spans).alias("spans"),
    )


_OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(x AS double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
low AS (SELECT vec_id, min(other) AS m FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""


@query("op9_embedding_near_dedup", _OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return near.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold_of("doc_id", 4) == 2
    net = toxicity.train(docs, labels, usable=~held)
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_OP2_SQL = r"""
WITH rows_ AS (SELECT doc_id, text, coalesce(source, chr(1)) AS site FROM documents),
l AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS raw, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM rows_),
k AS (SELECT *, trim(translate(raw, chr(9) || chr(13) || chr(12) || chr(11), '    ')) AS line FROM l),
b AS (SELECT line, min(doc_id * 1000000 + pos) AS first FROM k WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
j AS (SELECT doc_id, pos, raw, k.line, b.line IS NOT NULL AND doc_id * 1000000 + pos <> first AS gone FROM k LEFT JOIN b USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM j GROUP BY doc_id
"""


@query("op2_line_dedup", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.line_spread_dedup(table(spark, sf_dir, "documents"), min_sites=5)
    return left.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.col("text").alias("kept_text"))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_of("doc_id", 7) == 2
    model, words = lm_score.learn(docs.where(~held))
    scored = lm_score.score(docs, model, words)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


_OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_inner_product(a.e, b.e) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same) WHERE n <= 5),
n AS (
  SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, cast(rank AS integer) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query("op11_hard_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumn("label", moved), anchor=F.col("vec_id") % 50 == 0)


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         -ln((cast('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '')), 1, 13) AS bigint) + 0.5) / 4503599627370496.0)
           / coalesce(q, 1.0) AS key
  FROM documents LEFT JOIN (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END) AS q FROM labels GROUP BY doc_id) USING (doc_id)),
s AS (
  SELECT source, source_size, 2.0 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 2.0 END AS w
  FROM (SELECT source, cast(sum(size) AS bigint) AS source_size FROM d GROUP BY source)),
k AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k FROM s),
f AS (
  SELECT a.k, (SELECT 1.5 * sum(source_size) FROM s) AS goal, coalesce(sum(b.cap) FILTER (b.k < a.k), 0) AS full_, sum(b.w) FILTER (b.k >= a.k) AS left_, any_value(a.cap / a.w) AS ratio
  FROM k a, k b GROUP BY a.k),
rate AS (SELECT (goal - full_) / left_ AS r FROM f WHERE (goal - full_) / left_ < ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce(r, 0) * w) AS target FROM s LEFT JOIN rate ON true),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs
  FROM (SELECT *, least(cast(round(target) AS bigint), 2 * source_size) AS budget FROM t)),
o AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size
           - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target, cast(epochs * size + greatest(0, least(size, room)) AS bigint) AS taken FROM o
"""


@query("op12_source_mixing", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights are 2, 1 and 0.5 for documents labelled good, not labelled and labelled bad."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    marks = table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))
    return mixing.mix_sources(table(spark, sf_dir, "documents"), quality=marks).drop("source", "epochs")


_OP13_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
total AS (SELECT count(*) AS nn, cast(sum(n) AS bigint) AS ll FROM size),
tf AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY doc_id, t),
weight AS (SELECT t, cast(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM tf, total GROUP BY t),
score AS (
  SELECT item_id, doc_id, cast(sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS bigint) AS score
  FROM (SELECT item_id, t, count(*) AS k FROM q GROUP BY item_id, t) JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (doc_id), total
  GROUP BY item_id, doc_id)
SELECT item_id, cast(rank AS integer) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""


@query("op13_ranked_search", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
