"""Delivery and dictionary exports: K4, K5, K6."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.aggregates import latest_per_key
from lakeloom.session import shared_dir
from lakeloom.sinks.tables import CSV_WRITE_OPTIONS
from lakeloom.sources import fs

# Fixed values of the notification message.
NOTIFY_SUBJECT = "Asset Metadata Download Notification"
LINK_SECONDS = 86400
EXPORT_KEYS = ["domain_name", "domain_unit_name", "project_name", "asset_name"]


def check_delivery(df: DataFrame) -> None:
    """A mapped column may not take a name that the delivery itself writes."""
    taken = [c for c in df.columns if c.lower() in ("run_date", "batch_id")]
    if taken:
        raise ValueError(f"mapped columns {taken} would be overwritten by the delivery's own")


def write_delivery(df: DataFrame, entity_root: str, run_date: str, batch_id: int,
                   fmt: str = "json") -> None:
    """K4 write: the entity's mapped rows under ``<root>/batch_id=<b>/``, each
    row carrying its ``run_date``.

    Dynamic overwrite of that one folder makes a retry of the same batch
    idempotent, even when the retry runs on a later day; other batches are
    untouched.
    """
    check_delivery(df)
    (df.withColumn("run_date", F.lit(run_date)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
     .write.partitionBy("batch_id").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").format(fmt).save(entity_root))


def export_latest(rows: DataFrame, root: str, keys: list[str], order: list[str],
                  fmt: str = "csv", buckets: int = 64) -> None:
    """The latest row per key (A3), kept in a table of ``buckets`` hash buckets.

    Only the buckets that ``rows`` touch are written again: their earlier rows
    less the keys of ``rows``, and the new rows. The number of folders, which
    the driver renames at commit, does not grow with the keys. The merged rows
    are checkpointed, since a bucket cannot be read and written at once.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys]), F.lit(buckets)).cast("int")
    new = latest_per_key(rows, keys, order).withColumn("key_bucket", bucket).checkpoint(eager=True)
    if fs.exists(spark, root):
        touched = [r[0] for r in new.select("key_bucket").distinct().collect()]  # at most ``buckets``
        reader = spark.read.schema(new.schema).format(fmt)
        if fmt == "csv":
            reader = reader.options(**CSV_WRITE_OPTIONS)
        old = reader.load(root).where(F.col("key_bucket").isin(touched)).select(new.columns)
        same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
        kept = old.alias("o").join(new.select(*keys).alias("n"), functools.reduce(lambda x, y: x & y, same), "left_anti")
        new = new.unionByName(kept).checkpoint(eager=True)
    w = new.repartition("key_bucket").write.partitionBy("key_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    w.format(fmt).save(root)


def export_dictionary(rows: DataFrame, root: str, order: list[str] | None = None) -> None:
    """K5: one CSV (column_name, description) per (domain, unit, project, asset).

    The latest event per key wins (A3, on ``order``); only those keys' folders
    are overwritten. A latest event without columns leaves an object with one
    blank line, so an earlier list does not stay. ``rows``: EXPORT_KEYS +
    event_time + event_id + columns array.
    """
    order = order or ["event_time", "event_id"]
    last = latest_per_key(rows.select(*EXPORT_KEYS, *order, "columns"), EXPORT_KEYS, order)
    out = last.select(*EXPORT_KEYS, F.explode_outer("columns").alias("c")).select(
        *EXPORT_KEYS, F.col("c.columnIdentifier").alias("column_name"),
        F.col("c.description").alias("description"))
    (out.write.partitionBy(*EXPORT_KEYS).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").options(**CSV_WRITE_OPTIONS).csv(root))


# The characters that Spark writes as %XX in a partition folder.
ESCAPED = "%\"#'*/:=?\\{[]^"


def object_folder(keys: list[str]) -> Column:
    """The folder K5 writes for a key: ``name=value/`` per column, as Spark
    spells it; K6 announces the same one."""
    def spelled(c: str) -> Column:
        v = F.col(c).cast("string")
        for ch in ESCAPED:
            v = F.replace(v, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
        return F.concat(F.lit(f"{c}="), F.when(F.coalesce(v, F.lit("")) == "", F.lit("__HIVE_DEFAULT_PARTITION__")).otherwise(v), F.lit("/"))

    return F.concat(*map(spelled, keys))


def notification_rows(exports: DataFrame, bucket: str, prefix: str = "dictionary",
                      batch: str | None = None) -> DataFrame:
    """K6: one message row per export: subject, bucket, key (the folder that
    ``export_dictionary`` writes, or, with the column ``batch``, the object that
    batch published), link expiry.

    ``exports`` has EXPORT_KEYS and ``created`` (timestamp).
    """
    key = F.concat(F.lit(prefix + "/"), *([object_folder([batch])] if batch else []), object_folder(EXPORT_KEYS))
    return exports.select(
        *[c for c in exports.columns if c != batch],
        F.lit(NOTIFY_SUBJECT).alias("subject"),
        F.lit(bucket).alias("bucket"),
        key.alias("key"),
        (F.col("created") + F.expr(f"INTERVAL {LINK_SECONDS} SECONDS")).alias("expires_at"))
