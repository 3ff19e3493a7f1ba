"""Manifest of ingested files: the incremental-scan state.

An append-only parquet table under a state folder holds one row per file per
run: ``(ctx, path, mtime, length, batch_id, run_ts, state, token)`` where state is
``intent`` (written before the data) or ``committed`` (written after). A file
counts as done only when a committed row with the same path, change time and
length exists, so a modified file is picked up again and a crash between the
data write and the commit leaves an open intent that the next run retries. The
token is that of the run's lease (``sources.lease``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.functions.stamps import run_clock
from lakeloom.operators.profiles import PROFILE_SCHEMA, merged, type_of
from lakeloom.sources import fs

MANIFEST_SCHEMA = T.StructType([
    T.StructField("ctx", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("state", T.StringType()),
    T.StructField("token", T.LongType()),
])

COLUMNS_SCHEMA = T.StructType([
    T.StructField("ctx", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
])

INTENT = "intent"
COMMITTED = "committed"


def manifest_path(state_dir: str) -> str:
    return f"{state_dir.rstrip('/')}/manifest"


def columns_path(state_dir: str) -> str:
    return f"{state_dir.rstrip('/')}/columns"


def read_manifest(spark: SparkSession, state_dir: str) -> DataFrame:
    path = manifest_path(state_dir)
    if not fs.exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def committed_files(manifest: DataFrame, ctx: str) -> DataFrame:
    return (manifest.where((F.col("ctx") == ctx) & (F.col("state") == COMMITTED)
                           & F.col("path").isNotNull())
            .select("path", "mtime", "length"))


def new_files(listing: DataFrame, manifest: DataFrame, ctx: str) -> DataFrame:
    """Listed files with no committed row of the same path, time and length."""
    return listing.join(committed_files(manifest, ctx), ["path", "mtime", "length"], "left_anti")


def batch_state(manifest: DataFrame, ctx: str):
    """One pass over the manifest for ``ctx``: the oldest open intent
    ``(batch_id, run_ts)`` (an intent whose batch has no commit row) or None,
    and the last batch id or None."""
    state = F.col("state")
    per = (manifest.where(F.col("ctx") == ctx).groupBy("batch_id")
           .agg(F.max((state == COMMITTED).cast("int")).alias("c"),
                F.max((state == INTENT).cast("int")).alias("i"),
                F.min("run_ts").alias("run_ts")))
    row = per.agg(F.max("batch_id").alias("last"),
                  F.min(F.when((F.col("c") == 0) & (F.col("i") == 1), F.struct("batch_id", "run_ts")))
                  .alias("open")).first()
    if row is None:
        return None, None
    pending = (row["open"]["batch_id"], row["open"]["run_ts"]) if row["open"] is not None else None
    return pending, row["last"]


def open_intent(manifest: DataFrame, ctx: str):
    """(batch_id, run_ts) of the oldest intent without a commit, else None."""
    return batch_state(manifest, ctx)[0]


def next_clock(last_batch: int | None, run_ts=None) -> tuple[str, int]:
    """The run clock for a new batch: ``run_ts`` (default now) in whole
    seconds, moved past ``last_batch`` when needed, so batch ids stay unique
    and increasing (two runs in one second would otherwise share a batch
    partition)."""
    ts_sql, batch_id = run_clock(run_ts)
    if last_batch is not None and batch_id <= last_batch:
        ts_sql, batch_id = clock_of(last_batch + 1)
    return ts_sql, batch_id


def clock_of(batch_id: int) -> tuple[str, int]:
    """The clock of a batch, from its id alone: epoch seconds, in UTC whatever
    the driver's zone."""
    return run_clock(dt.datetime.fromtimestamp(batch_id, dt.timezone.utc))


def collect_files(files: DataFrame) -> list[tuple]:
    """(path, change time in microseconds, length) on the driver. The change
    time stays a number, so the driver's zone cannot touch it."""
    return [tuple(r) for r in files.select("path", F.unix_micros("mtime"), "length").collect()]


def file_frame(spark: SparkSession, files: list[tuple]) -> DataFrame:
    """The opposite of ``collect_files``."""
    df = spark.createDataFrame(files, "path string, micros long, length long")
    return df.select("path", F.timestamp_micros("micros").alias("mtime"), "length")


def existing(spark: SparkSession, files: DataFrame) -> list[tuple]:
    """``collect_files`` of those that are still there; an intent holds no more
    than the files of one batch."""
    return [f for f in collect_files(files) if fs.exists(spark, f[0])]


def intent_files(manifest: DataFrame, ctx: str, batch_id: int) -> DataFrame:
    return (manifest.where((F.col("ctx") == ctx) & (F.col("state") == INTENT)
                           & (F.col("batch_id") == batch_id) & F.col("path").isNotNull())
            .select("path", "mtime", "length"))


def manifest_rows(files: DataFrame, ctx: str, batch_id: int, run_ts_sql: str,
                  state: str, token: int | None = None) -> DataFrame:
    return files.select(
        F.lit(ctx).alias("ctx"), "path", "mtime", "length",
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.expr(f"CAST('{run_ts_sql}' AS TIMESTAMP)").alias("run_ts"),
        F.lit(state).alias("state"), F.lit(token).cast("bigint").alias("token"))


def commit_rows(spark: SparkSession, files: DataFrame, ctx: str, batch_id: int,
                run_ts_sql: str, token: int | None = None) -> DataFrame:
    """S3: committed rows for ``files`` plus one marker row (null path) that
    closes the batch even when no file is left to commit."""
    marker = spark.createDataFrame([(ctx, None, None, None, batch_id, None, COMMITTED, token)], MANIFEST_SCHEMA)
    marker = marker.withColumn("run_ts", F.expr(f"CAST('{run_ts_sql}' AS TIMESTAMP)"))
    return manifest_rows(files, ctx, batch_id, run_ts_sql, COMMITTED, token).unionByName(marker)


def append(rows: DataFrame, state_dir: str) -> None:
    """Append manifest rows; a handful of files per run, never rewritten."""
    rows.coalesce(1).write.mode("append").parquet(manifest_path(state_dir))


def commit_empty_run(spark: SparkSession, state_dir: str, ctx: str, batch_id: int,
                     run_ts_sql: str, token: int | None = None) -> None:
    """S3 for a run with nothing new: one marker row with a null path."""
    row = spark.createDataFrame([(ctx, None, None, None, batch_id, None, COMMITTED, token)],
                                MANIFEST_SCHEMA)
    row = row.withColumn("run_ts", F.expr(f"CAST('{run_ts_sql}' AS TIMESTAMP)"))
    append(row, state_dir)


def last_columns(spark: SparkSession, state_dir: str, ctx: str) -> list[str]:
    """Column order of the table so far (new runs keep it and append)."""
    path = columns_path(state_dir)
    if not fs.exists(spark, path):
        return []
    row = (spark.read.schema(COLUMNS_SCHEMA).parquet(path)
           .where(F.col("ctx") == ctx).orderBy(F.desc("batch_id")).limit(1).collect())
    return list(row[0]["columns"]) if row else []


def known_families(spark: SparkSession, state_dir: str, ctx: str) -> list[tuple[str, list[str]]]:
    """(family, its columns so far) of a context, in order of first use. The
    columns of family f are recorded under the context ``<ctx>/f``."""
    path = columns_path(state_dir)
    if not fs.exists(spark, path):
        return []
    rows = (spark.read.schema(COLUMNS_SCHEMA).parquet(path).where(F.startswith("ctx", F.lit(f"{ctx}/")))
            .groupBy("ctx").agg(F.max_by("columns", "batch_id").alias("columns")).collect())
    return sorted(((r["ctx"][len(ctx) + 1:], list(r["columns"])) for r in rows), key=lambda f: (len(f[0]), f[0]))


def record_columns(spark: SparkSession, state_dir: str, ctx: str, batch_id: int,
                   columns: list[str]) -> None:
    (spark.createDataFrame([(ctx, batch_id, columns)], COLUMNS_SCHEMA)
     .coalesce(1).write.mode("append").parquet(columns_path(state_dir)))


def record_profile(spark: SparkSession, state_dir: str, rows: list[tuple]) -> None:
    """Append the profiles of a batch's columns (see ``operators.profiles``)."""
    if rows:
        spark.createDataFrame(rows, PROFILE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{state_dir.rstrip('/')}/profiles")


def column_types(spark: SparkSession, state_dir: str, ctx: str, name: str | None = None) -> dict[str, str | None] | None:
    """The type of each column over all committed batches of ``ctx``; None if
    a committed batch with rows has no profile (it was ingested without one).
    ``name`` is the context the profiles are kept under, if another: that of a
    family, whose rows are in some of the batches."""
    path = f"{state_dir.rstrip('/')}/profiles"
    if not fs.exists(spark, path):
        return None
    man = read_manifest(spark, state_dir).where((F.col("ctx") == ctx) & (F.col("state") == COMMITTED))
    done = man.groupBy("batch_id").agg(F.count("path").alias("files")).where("files > 0").select("batch_id")
    known = spark.read.schema(PROFILE_SCHEMA).parquet(path).where(F.col("ctx") == (name or ctx))
    if name in (None, ctx) and not done.join(known.select("batch_id"), "batch_id", "left_anti").isEmpty():
        return None
    # A batch whose files all changed under it is committed without files, its rows stay.
    batches = man.select("batch_id").distinct()
    return {c: type_of(k, d, low, high) for c, k, d, low, high in merged(known.join(batches, "batch_id", "left_semi"))}


def compact_manifest(spark: SparkSession, state_dir: str, target_bytes: int = 128 << 20) -> int:
    """Rewrite the manifest's many small files as a few; returns the number of
    files replaced.

    Every reader of the manifest is insensitive to repeated rows (anti-join,
    latest batch, open intents), so this is safe at any crash point: first the
    current files' rows are appended again as one compacted copy, then the old
    files are deleted. Run it between ingest runs of the contexts it holds.
    """
    path = manifest_path(state_dir)
    old = fs.file_sizes(spark, path, ".parquet")
    if len(old) <= 1:
        return 0
    n = max(1, -(-sum(b for _, b in old) // target_bytes))
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(*[p for p, _ in old]).dropDuplicates()
    rows.repartition(n).write.mode("append").parquet(path)
    for p, _ in old:
        fs.delete(spark, p, recursive=False)
    return len(old)
