"""Schedule → SQL asset → mapper → delivery (K4), incremental over the lake table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.mapping import apply_mapper
from lakeloom.sinks.exports import check_delivery, write_delivery
from lakeloom.sinks.tables import lake_ddl
from lakeloom.sources import files as src_files
from lakeloom.sources import fs
from lakeloom.sources import manifest as mf
from lakeloom.sources.lease import Lease


def shape_delivery(spark: SparkSession, rows: DataFrame, pairs: list[tuple[str, str]],
                   query: str | None = None, view: str = "increment") -> DataFrame:
    """SQL asset over the increment (published as ``view``), then the mapper.

    The view and the query use the rows' own session: inside ``foreachBatch``
    a micro-batch belongs to the stream's session, not the caller's.
    """
    if query:
        rows.createOrReplaceTempView(view)
        rows = rows.sparkSession.sql(query.strip().rstrip(";"))
    return apply_mapper(rows, pairs)


def deliver_entity(spark: SparkSession, ctx: str, table_root: str, columns: list[str] | None,
                   state_dir: str, entity_root: str, pairs: list[tuple[str, str]],
                   query: str | None = None, view: str = "increment",
                   run_ts: dt.datetime | str | None = None, layout: str = "ymd",
                   fmt: str = "json", max_files: int = 10_000, lake_fmt: str = "csv",
                   ingest_ctx: str | None = None, ingest_state: str | None = None,
                   lease_seconds: float = 600.0, lease_wait: float = 7200.0) -> int:
    """K4: deliver every lake-table file not yet delivered for ``ctx``.

    Same manifest protocol as ingest (intent, write, commit), in batches of at
    most ``max_files`` until none is left. Output goes to
    ``<entity_root>/batch_id=<id>/`` (rows carry ``run_date``) with dynamic
    overwrite, so a retried batch replaces its own folder. Returns the number
    of files taken.

    With ``ingest_ctx`` and ``ingest_state`` the ingest manifest decides: its
    recorded columns are read (``columns`` may be None), and in layout
    ``ymd_batch`` only the files of committed batches are taken. All day
    folders are listed, since a copied or restored lake may hold news in any.
    One run per context at a time, as in ``ingest``.
    """
    if ingest_ctx and ingest_state:
        columns = mf.last_columns(spark, ingest_state, ingest_ctx) or columns
    total = 0
    with Lease(spark, state_dir, ctx, lease_seconds, lease_wait) as lease:
        while True:
            n, retried, found = _deliver_batch(spark, ctx, table_root, columns or [], state_dir, entity_root, pairs, query,
                                               view, run_ts, layout, fmt, max_files, lake_fmt, ingest_ctx, ingest_state,
                                               total == 0, lease)
            total += n
            if not retried and found < max_files:
                return total


def _committed_only(spark: SparkSession, files: DataFrame, ingest_ctx: str, ingest_state: str) -> DataFrame:
    done = (mf.read_manifest(spark, ingest_state)
            .where((F.col("ctx") == ingest_ctx) & (F.col("state") == mf.COMMITTED)).select("batch_id").distinct())
    batch = F.regexp_extract("path", r"/batch_id=(\d+)/", 1).try_cast("bigint")
    return files.withColumn("batch_id", batch).join(done, "batch_id", "left_semi").drop("batch_id")


def _deliver_batch(spark, ctx, table_root, columns, state_dir, entity_root, pairs, query, view, run_ts, layout, fmt,
                   max_files, lake_fmt, ingest_ctx, ingest_state, first, lease) -> tuple[int, bool, int]:
    """(files delivered, whether it was a retry, files chosen)."""
    lease.check()
    manifest = mf.read_manifest(spark, state_dir)
    pending, last_batch = mf.batch_state(manifest, ctx)
    retried = pending is not None
    if retried:
        run_ts_sql, batch_id = mf.clock_of(pending[0])
        chosen = mf.existing(spark, mf.intent_files(manifest, ctx, batch_id))
        fs.delete(spark, f"{entity_root.rstrip('/')}/batch_id={batch_id}")
    else:
        run_ts_sql, batch_id = mf.next_clock(last_batch, run_ts)
        new = mf.new_files(src_files.list_files(spark, table_root, "*"), manifest, ctx)
        if ingest_ctx and ingest_state and layout == "ymd_batch":
            new = _committed_only(spark, new, ingest_ctx, ingest_state)
        chosen = mf.collect_files(new.orderBy("mtime", "path").limit(max_files))
    if not chosen:
        if retried:
            mf.append(mf.commit_rows(spark, mf.file_frame(spark, []), ctx, batch_id, run_ts_sql, lease.token), state_dir)
        elif first:
            mf.commit_empty_run(spark, state_dir, ctx, batch_id, run_ts_sql, lease.token)
        return 0, retried, 0
    file_df, paths = mf.file_frame(spark, chosen), [f[0] for f in chosen]
    reader = spark.read.option("basePath", table_root)
    if lake_fmt == "csv":
        rows = reader.schema(lake_ddl(columns, layout)).option("header", "true").csv(paths)
    else:
        rows = reader.option("mergeSchema", "true").format(lake_fmt).load(paths)
    out = shape_delivery(spark, rows, pairs, query, view)  # a plan that fails leaves no intent
    check_delivery(out)
    lease.check()
    if not retried:
        mf.append(mf.manifest_rows(file_df, ctx, batch_id, run_ts_sql, mf.INTENT, lease.token), state_dir)
    write_delivery(out, entity_root, run_ts_sql[:10], batch_id, fmt)
    lease.check()
    mf.append(mf.commit_rows(spark, file_df, ctx, batch_id, run_ts_sql, lease.token), state_dir)
    return len(chosen), retried, len(chosen)
