"""Secret scans over every historical version, with an incremental ledger of scanned contents.

Each version's text is addressed by its SHA-256, so a content is scanned once however many paths hold it.
The ledger says which (content, rule, version of the rule) were scanned and what they gave; only pairs it
lacks are scanned, and findings are joined back to every path.  DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tables import need


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str  # Java regular expression
    group: int  # group whose length counts
    least: int  # code points it needs
    base: bool


# The base kinds, in their order.
BASE_RULES = (
    Rule("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24, True),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, False),
    Rule("host_token", 1, r"(?:gh[pousr]_|xox[abprs]-)[A-Za-z0-9-]{20,}", 0, 1, False),
)
RULES = BASE_RULES + MORE_RULES


def with_blob(versions: DataFrame) -> DataFrame:
    """Adds ``blob_id``, the content address of ``text`` (null: empty)."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce("text", F.lit("")), 256))


def _matches(rule: Rule):
    """Per match the code points before it since the last match, its length and whether it is long enough."""
    text = F.col("text")
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.length(m))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m))
    return F.arrays_zip(gaps.alias("gap"), whole.alias("size"), counted.alias("counted"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """New ledger rows: every (content, rule) of ``versions(text)`` that ``ledger`` does not hold yet.

    Null texts count as empty, equal texts are scanned once, contents without findings are among the
    scanned pairs, so that they are not scanned again; an empty table gives no rows; other columns are
    ignored.  Returns two tables: the scanned pairs (blob_id, kind, version), and the findings among them
    (blob_id, kind, version, start, end; code points, end exclusive).
    """
    blobs = with_blob(need(versions, "text")).select("blob_id", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob_id"])
    asked = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", asked)
    else:
        seen = ledger.select("blob_id", F.struct("kind", "version").alias("k")).groupBy("blob_id").agg(F.collect_set("k").alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left")
        blobs = blobs.withColumn("todo", F.when(F.col("seen").isNull(), asked).otherwise(F.array_except(asked, "seen")))
    per_rule = [
        F.when(
            F.array_contains(F.transform("todo", lambda t: t["kind"]), r.kind),
            F.struct(
                F.lit(r.kind).alias("kind"),
                F.lit(r.version).alias("version"),
                F.lit(r.least).alias("least"),
                F.when(F.col("text").rlike(r.pattern), _matches(r)).alias("m"),
            ),
        )
        for r in rules
    ]
    one = blobs.select("blob_id", F.explode(F.array_compact(F.array(*per_rule))).alias("r"))
    place = one.select("blob_id", "r.kind", "r.version", "r.least", F.posexplode_outer("r.m").alias("at", "m"))
    # ends of matches are running sums of gaps and sizes; the piece after the last match has no size
    w = Window.partitionBy("blob_id", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(w)
    hit = place.where("m is not null and m.size is not null").withColumn("end", end.cast("long"))
    hit = hit.where(F.col("m.counted") >= F.col("least"))
    hit = hit.select("blob_id", "kind", "version", (F.col("end") - F.col("m.size")).alias("start"), "end")
    done = blobs.select("blob_id", F.explode("todo").alias("t")).select("blob_id", "t.kind", "t.version")
    return done, hit


def findings(versions: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``spans``: findings under the present rules, by start, then kind as listed.

    ``found`` is what scans gave so far.  One row per version, every path of a content gets its findings;
    columns of ``versions`` stay.
    """
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    number = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    hits = found.where(F.array_contains(current, F.struct("kind", "version"))).distinct()
    spans = hits.groupBy("blob_id").agg(F.array_sort(F.collect_list(F.struct("start", number.alias("no"), "end", "kind"))).alias("spans"))
    return with_blob(versions).join(spans, "blob_id", "left")


def written(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
