"""Versioned parquet publication and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


class PublicationConflict(RuntimeError):
    """Another writer published after this one had read; nothing of the refused version is visible."""


def _head(spark: SparkSession, root: str) -> tuple[int, int | None]:
    """The last commit's number (0: none) and the version it made current."""
    fs, p = _fs(spark, f"{root}/_log")
    if not fs.exists(p):
        return 0, None
    done = sorted((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), reverse=True)
    if not done:
        return 0, None
    return done[0], int(spark.read.text(f"{root}/_log/{done[0]}").first()[0])


def current_version(spark: SparkSession, root: str) -> int | None:
    """The version that the last commit names; readers never look at unfinished versions."""
    return _head(spark, root)[1]


def _claim_version(spark: SparkSession, root: str) -> int:
    """The next free version; two writers never get the same, as creating the owner file is exclusive."""
    version = max(_versions(spark, root) or [0]) + 1
    while True:
        fs, p = _fs(spark, f"{root}/v={version}/_OWNER")
        if not fs.exists(p):
            try:
                fs.create(p, False).close()
                return version
            except Exception:
                if not fs.exists(p):
                    raise
        version += 1


def publish_version(tables: dict[str, tuple[DataFrame, str]], root: str, buckets: int = BUCKETS, read: int | None = -1) -> int:
    """Writes every table of a new version, compares the rows found with the rows written, then commits it.

    ``read`` is the version that the tables were made from (None: there was none); without it, the one that is current when
    the call begins.  If another version has been committed since, the commit is refused with ``PublicationConflict``.

    Rows are placed by a hash bucket of their key.  The rebalance hint lets the engine size the writing
    tasks by the data, so a bucket of any size is written by as many tasks as it needs.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    commit, base = _head(spark, root)
    if read != -1 and read != base:
        raise PublicationConflict(f"version {base} was published after version {read} had been read")
    version = _claim_version(spark, root)
    for name, (df, key) in tables.items():
        path, seen = f"{root}/v={version}/{name}", Observation()
        b = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        b.hint("rebalance", "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)
        written = seen.get["n"]
        if written == 0:
            raise ValueError(f"refusing to publish empty table {name}")
        found = spark.read.parquet(path).count()
        if found != written:
            raise ValueError(f"{name}: {written} rows were written, {found} are there")
    _commit(spark, root, commit + 1, version)
    return version


def _commit(spark: SparkSession, root: str, number: int, version: int) -> None:
    """Makes ``version`` current by naming it in the log's next entry, which only one writer can add.

    The entry is written aside and renamed without overwriting, so it is there whole or not at all, and a writer that
    dies before the rename leaves nothing in the way.
    """
    fs, aside = _fs(spark, f"{root}/v={version}/_COMMIT-{number}")
    out = fs.create(aside, True)
    out.write(bytearray(f"{version}\n".encode()))
    out.close()
    fs, entry = _fs(spark, f"{root}/_log/{number}")
    fs.mkdirs(entry.getParent())
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    names = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(entry).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        names.rename(fs.makeQualified(aside), fs.makeQualified(entry), how)
    except Exception as e:
        if fs.exists(entry):
            raise PublicationConflict(f"commit {number} belongs to another writer") from e
        raise


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    v = current_version(spark, root)
    if v is None:
        raise FileNotFoundError(f"nothing published under {root}")
    return spark.read.parquet(f"{root}/v={v}/{name}")


def write_inventory(chunks: DataFrame, path: str) -> None:
    """Chunk inventory as CSV with header, one row per chunk, text shortened to a preview."""
    cols = [c for c in chunks.columns if c != "text"]
    preview = F.regexp_replace(F.substring("text", 1, 240), r"\s+", " ")
    chunks.select(*cols, preview.alias("preview")).write.mode("overwrite").option("header", True).csv(path)


def transcript_blocks(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, block, json``: transcript pieces; their concatenation in turn order is the export.

    Blocks stay rows, so even a conversation that holds a third of the table is never
    gathered into one value.
    """
    return messages.select(
        "conv_id", "turn", F.concat(F.upper("role"), F.lit("\n"), F.col("text"), F.lit("\n")).alias("block"),
        F.to_json(F.struct("turn", "role", F.col("text").alias("content"))).alias("json"))


def export_conversations(messages: DataFrame, path: str, column: str = "block") -> None:
    """Writes transcripts as text files sorted by conversation and turn."""
    b = transcript_blocks(messages).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    b.select(column).write.mode("overwrite").text(path)
