"""File sources: listing, text renderings per format, and their dispatch."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of a corpus.
SUPPORTED = (
    "pdf docx doc pptx ppt xlsx xls csv txt md html htm xml json rtf odt eml msg epub png jpg jpeg"
).split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def list_sources(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """Supported files below ``root`` ordered by lower-cased path; file contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    f = f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return f.withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(extensions or SUPPORTED)).orderBy(F.lower("path"))


def scan_text(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """``path, text``: whole files; bytes that are no UTF-8 are dropped."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.replace(F.col("value"), F.lit("�"), F.lit("")).alias("text"))


def scan_csv_as_text(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """``path, row_no, text``: one row per record, ``name: value`` cells joined by a bar, numbered from 0 per file.

    Every file is read under its own header: files are grouped by their first line, and each group has a
    reader of its own.  Rows stay rows: a huge file is never gathered into a single value.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    at = F.struct(F.input_file_block_start().alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("v"))
    heads = lines.select(F.input_file_name().alias("path"), at.alias("at")).groupBy("path").agg(F.min("at.b").alias("b"), F.min("at").alias("at"))
    groups: dict[str, list[str]] = {}
    for r in heads.select("path", F.col("at.v").alias("head")).toLocalIterator():
        groups.setdefault(r["head"], []).append(r["path"])
    out = None
    for _, paths in sorted(groups.items()):
        d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(paths)
        cells = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in d.columns])
        d = d.select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("id"), cells.alias("text"))
        out = d if out is None else out.unionByName(d)
    if out is None:
        return spark.createDataFrame([], "path string, row_no long, text string")
    # A file is read by one task, so its ids are consecutive.
    first = out.groupBy("path").agg(F.min("id").alias("first"))
    return out.join(first, "path").select("path", (F.col("id") - F.col("first")).alias("row_no"), "text")


def _indented(value):
    try:
        return None if value is None else json.dumps(json.loads(value), indent=2, ensure_ascii=False)
    except ValueError:
        return None


def scan_json_as_text(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """``path, text``: every JSON document re-serialised with indent 2, non-ASCII and key order kept.

    A file whose lines are all documents gives one row per line; any other file is one document (an array
    is one, too).  What cannot be parsed gives a null text.
    """
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    lines = read.text(root).select(F.input_file_name().alias("path"), "value").where(F.trim("value") != "")
    kinds = lines.groupBy("path").agg(F.min(F.try_parse_json("value").isNotNull()).alias("by_line"))
    whole = read.text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    one = lines.join(kinds.where("by_line").select("path"), "path", "left_semi")
    other = whole.join(kinds.where("by_line").select("path"), "path", "left_anti")
    return one.unionByName(other).select("path", F.udf(_indented, "string")("value").alias("text"))


def scan_xml_as_text(spark: SparkSession, root: str, row_tag: str, glob: str = "*.xml") -> DataFrame:
    d = spark.read.format("xml").option("rowTag", row_tag).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    body = F.to_xml(F.struct(*[F.col(f"`{c}`") for c in d.columns]), {"rowTag": row_tag})
    return d.select(F.input_file_name().alias("path"), body.alias("text"))


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


#: Elements whose content is no text of the page; scripts and styles first, as their content may look like tags.
HIDDEN_TAGS = ("script", "style", "head", "nav", "footer")
#: Numeric character references of the Latin letters and common marks; others stay as they are.
NUMERIC = tuple(range(160, 256)) + (8211, 8212, 8216, 8217, 8220, 8221, 8230, 8364)


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and navigation out, block tags to line breaks, entities decoded."""
    t = html
    for tag in HIDDEN_TAGS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<![A-Za-z][^>]*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|section|tr|table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.when(t.contains("&#"), _numeric(t)).otherwise(t)
    for k, v in ENTITIES.items():
        t = F.replace(t, F.lit(k), F.lit(v))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n")
    return F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))


def _numeric(t: Column) -> Column:
    """Decimal and hexadecimal character references of ``NUMERIC``, decoded in one pass over the pieces between them."""
    parts = F.split(t, "&#", -1)

    def decode(piece: Column) -> Column:
        number = F.regexp_extract(piece, r"^(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));", 1)
        decimal = F.regexp_extract(piece, r"^([0-9]{1,7});", 1)
        code = F.when(number != "", F.conv(number, 16, 10)).otherwise(decimal).cast("int")
        known = F.element_at(F.create_map(*[x for c in NUMERIC for x in (F.lit(c), F.lit(chr(c)))]), code)
        return F.when(known.isNotNull(), F.concat(known, F.regexp_replace(piece, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), piece))

    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decode), ""))


def flatten_parts(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Joins the non-empty trimmed parts (pages, slides, sheets) of one file by a blank line."""
    p = parts.withColumn("__t", F.regexp_replace(F.col(text), r"^\s+|\s+$", "")).where("__t <> ''")
    g = p.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__t").alias("t")))).alias("ps"))
    return g.select(key, F.array_join(F.transform("ps", lambda x: x["t"]), "\n\n").alias("text"))


def loader_dispatch(spark: SparkSession, root: str, xml_row_tag: str = "row") -> DataFrame:
    """``path, ext, text, error``: every supported file through its loader.

    Empty texts and files that a loader cannot parse carry an error; a listed format without a loader
    gives an error row per file, so no file is lost silently.
    """
    html = scan_text(spark, root, "*.htm*").withColumn("text", html_to_text(F.col("text")))
    out = scan_text(spark, root, "*.{txt,md}").select("path", "text").unionByName(html.select("path", "text"))
    for ext, reader in (("csv", scan_csv_as_text), ("json", scan_json_as_text)):
        if _any_file(spark, root, ext):
            out = out.unionByName(reader(spark, root).select("path", "text"))
    if _any_file(spark, root, "xml"):
        out = out.unionByName(scan_xml_as_text(spark, root, xml_row_tag).select("path", "text"))
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    read = out.select("path", extension(F.col("path")).alias("ext"), "text", F.when(empty, "no text extracted").alias("error"))
    closed = [e for e in SUPPORTED if e not in ("txt", "md", "htm", "html", "csv", "json", "xml")]
    rest = list_sources(spark, root, closed).select("path", "ext", F.lit(None).cast("string").alias("text"), F.concat(F.lit("no loader for "), "ext").alias("error"))
    return read.unionByName(rest)


def _any_file(spark: SparkSession, root: str, ext: str) -> bool:
    """Schema inference needs at least one file of the format."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{ext}").load(root)
    return len(f.select("path").limit(1).collect()) > 0


QA_RUN_SCHEMA = (
    "run_id string, test_case_id string, category string, description string, question string, expected_result string, "
    "actual_result string, status string, run_number int, total_runs int, started_at string, finished_at string, "
    "duration_seconds double, accepted_chunks int, final_chunks int, fallback_used string, sources string, error string, "
    "evidence_log string"
)


def scan_qa_runs(spark: SparkSession, path: str) -> DataFrame:
    """Evidence log: quoted line breaks, doubled quotes, byte-order mark."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").schema(QA_RUN_SCHEMA).csv(path)
