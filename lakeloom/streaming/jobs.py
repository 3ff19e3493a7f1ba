"""Structured Streaming forms: ingest on arrival (T1, T4), daily delivery (T2),
catalog-event stream (T3).

All run as ``readStream`` → ``foreachBatch`` with a checkpoint, so one query per
checkpoint gives the one-run-at-a-time rule, and a restarted query resumes from
its last committed micro-batch. Writes inside a micro-batch are keyed by the
batch id (dynamic overwrite), so a replayed batch replaces its own output.
"""

from __future__ import annotations

import datetime as dt
import functools
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lakeloom.functions.stamps import run_clock, stamp_upload_time
from lakeloom.plans.delivery import shape_delivery
from lakeloom.plans.dictionary import asset_events
from lakeloom.plans.ingest import ingest
from lakeloom.sinks.exports import EXPORT_KEYS, notification_rows, write_delivery
from lakeloom.sinks.snapshots import publish_batch
from lakeloom.sinks.tables import lake_ddl, write_partitioned
from lakeloom.sources.events import event_stream

Clock = Callable[[int], "dt.datetime | str | None"]


def _start(stream: DataFrame, fn, checkpoint: str, available_now: bool,
           processing_time: str | None) -> StreamingQuery:
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def ingest_on_arrival(spark: SparkSession, ctx: str, src: str, dst: str, state_dir: str,
                      checkpoint: str, max_files_per_trigger: int | None = None,
                      clock: Clock | None = None, available_now: bool = True,
                      processing_time: str | None = None, **ingest_kw) -> StreamingQuery:
    """T1 (manifest form): new files wake the query; each micro-batch runs the
    manifest ingest, which also catches files modified in place. The
    micro-batch rows are never read.

    A file rewritten in place under the same name does not wake a file
    stream on its own; it is taken by the next micro-batch, or by running
    ``ingest`` as a plain batch job on a schedule.
    """
    stream = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    signals = stream.load(src)

    def run(_batch: DataFrame, batch_id: int) -> None:
        ingest(spark, ctx, src, dst, state_dir,
               run_ts=clock(batch_id) if clock else None, **ingest_kw)

    return _start(signals, run, checkpoint, available_now, processing_time)


def ingest_stream_append(spark: SparkSession, src: str, dst: str, columns: list[str],
                         checkpoint: str, max_files_per_trigger: int | None = None,
                         clock: Clock | None = None, fmt: str = "csv",
                         available_now: bool = True,
                         processing_time: str | None = None) -> StreamingQuery:
    """T1 (append-only form) + T4: CSV rows stream in with a declared header,
    are stamped and written in layout ``ymd_batch`` keyed by the micro-batch.

    The file stream reads by position, so a file whose header differs from the
    declared columns fails the query; use the manifest form for drifting
    headers or modified files.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    r = (spark.readStream.schema(schema).option("header", "true").option("enforceSchema", "false")
         .option("recursiveFileLookup", "true"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = r.csv(src)

    def run(batch: DataFrame, batch_id: int) -> None:
        ts_sql, _ = run_clock(clock(batch_id) if clock else None)
        write_partitioned(stamp_upload_time(batch, ts_sql, batch_id), dst, layout="ymd_batch", fmt=fmt)

    return _start(rows, run, checkpoint, available_now, processing_time)


def deliver_daily(spark: SparkSession, table_root: str, columns: list[str], entity_root: str,
                  pairs: list[tuple[str, str]], checkpoint: str, query: str | None = None,
                  view: str = "increment", layout: str = "ymd", fmt: str = "json", lake_fmt: str = "csv",
                  clock: Clock | None = None, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Stream the lake table's (append-only) files; each micro-batch runs the
    SQL asset and mapper over just the new rows and writes them (K4), keyed by
    the query and its micro-batch."""
    ddl = lake_ddl(columns, layout)
    rows = spark.readStream.schema(ddl).option("header", "true").format(lake_fmt).load(table_root)

    def run(batch: DataFrame, batch_id: int) -> None:
        ts_sql, _ = run_clock(clock(batch_id) if clock else None)
        out = shape_delivery(spark, batch, pairs, query, view)
        write_delivery(out, entity_root, ts_sql[:10], batch_key(batch, batch_id), fmt)

    return _start(rows, run, checkpoint, available_now, processing_time)


def batch_key(batch: DataFrame, batch_id: int) -> int:
    """A micro-batch's number made unique across checkpoints: micro-batches
    restart at 0 with a new checkpoint, the query's id does not repeat. Outside
    a stream it is the number alone."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    return ((zlib.crc32(query.encode()) & 0x7FFFFFFF) << 32 | batch_id) if query else batch_id


def process_asset_batch(batch: DataFrame, batch_id: int, export_root: str, notify_root: str,
                        rejects_root: str, bucket: str = "dictionary-exports") -> None:
    """One micro-batch of T3: the dictionary objects of the assets whose latest
    event it holds (K5, ``sinks.snapshots``), then notification rows (K6) and
    rejects. A batch is published once and the rest replaces only its own
    ``batch_id`` partitions, so a replayed batch gives the same result as a
    single run. An event that is older than its asset's object announces the
    object as it is."""
    batch_id = batch_key(batch, batch_id)
    batch.persist()
    try:
        good = batch.where(F.col("reject_reason").isNull())
        live = publish_batch(good.select(*EXPORT_KEYS, "event_time", "event_id", "columns"), batch_id, export_root)
        made = [F.col(k).alias(f"_{k}") for k in EXPORT_KEYS]
        live = live.select(*made, F.col("batch_id"))
        same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in EXPORT_KEYS])
        told = good.select("event_id", *EXPORT_KEYS, F.col("event_time").alias("created")).join(live, same)
        notes = notification_rows(told.drop(*[f"_{k}" for k in EXPORT_KEYS]), bucket, batch="batch_id")
        (notes.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.partitionBy("batch_id").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(notify_root))
        (batch.where(F.col("reject_reason").isNotNull())
         .select("event_id", "detail_type", "reject_reason")
         .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.partitionBy("batch_id").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(rejects_root))
    finally:
        batch.unpersist()


def asset_event_stream(spark: SparkSession, events_path: str, projects: DataFrame,
                       units: DataFrame, domains: DataFrame, assets: DataFrame,
                       home_domain: str | None, export_root: str, notify_root: str,
                       rejects_root: str, checkpoint: str, bucket: str = "dictionary-exports",
                       max_files_per_trigger: int | None = None, available_now: bool = True,
                       processing_time: str | None = None) -> StreamingQuery:
    """JSON events → per micro-batch: match, extract, enrichment,
    ``process_asset_batch``. The lookups are sized anew for every micro-batch,
    so one that outgrows the broadcast bound is no longer broadcast."""
    events = event_stream(spark, events_path, max_files_per_trigger)

    def run(batch: DataFrame, batch_id: int) -> None:
        enriched = asset_events(batch, projects, units, domains, assets, home_domain)
        process_asset_batch(enriched, batch_id, export_root, notify_root, rejects_root, bucket)

    return _start(events, run, checkpoint, available_now, processing_time)
