"""Dictionary exports as a versioned snapshot table.

A batch writes its objects, one CSV per (domain, unit, project, asset), once
under ``batch_id=<id>/`` and nothing is ever overwritten. Which object is an
asset's current one is decided by keyed state: per key the time and id of its
latest event and the batch that holds the object, in hash buckets. A batch
merges its events into the buckets it touches, so an older event that comes in
a later batch replaces nothing. The new buckets are written under the batch too,
and one snapshot file, created whole or not at all, names the batch of every
bucket and makes all of it visible in one step.

Readers resolve keys through the latest snapshot, and the tasks open just the
current objects: nothing lists the folders, whose number grows with the keys. A
crash before the snapshot
leaves an invisible folder that the batch's replay removes; a batch that is in
the snapshot already is not applied again. A second writer that publishes the
same version fails. Since nothing is visible before the snapshot, tasks write
their objects in place and the driver renames none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import shared_dir
from lakeloom.sinks.exports import EXPORT_KEYS, object_folder
from lakeloom.sinks.tables import CSV_WRITE_OPTIONS
from lakeloom.sources import fs

ORDER = ["event_time", "event_id"]
EMPTY = {"version": 0, "buckets": {}, "applied": {}}


class ConcurrentPublish(RuntimeError):
    """Another writer published the version this batch was made for."""


class StoppedBeforePublish(RuntimeError):
    """Raised by ``stop_before_publish`` to test recovery."""


def _split(batch_id: int) -> tuple[str, int]:
    """A batch key is a query's number and its micro-batch (see ``batch_key``)."""
    return str(batch_id >> 32), batch_id & 0xFFFFFFFF


def latest_snapshot(spark: SparkSession, root: str) -> dict:
    """version, buckets (bucket -> batch that holds its state) and applied
    (query -> its last published micro-batch); the version is 0 before the
    first batch."""
    names = [n for n in fs.list_names(spark, f"{root}/_snapshots") if n.endswith(".json")]
    return json.loads(fs.read_text(spark, f"{root}/_snapshots/{names[-1]}")) if names else EMPTY


def current_objects(spark: SparkSession, root: str, snapshot: dict | None = None) -> DataFrame:
    """The state: EXPORT_KEYS, event_time, event_id, n_columns, batch_id (of the
    current object) and key_bucket, one row per asset."""
    snap = snapshot or latest_snapshot(spark, root)
    schema = ", ".join(f"{k} STRING" for k in EXPORT_KEYS) + ", event_time TIMESTAMP, event_id STRING, n_columns INT, batch_id BIGINT, key_bucket INT"
    paths = [f"{root}/_state/batch={b}/key_bucket={k}" for k, b in snap["buckets"].items()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/_state").parquet(*paths).select(
        *EXPORT_KEYS, *ORDER, "n_columns", "batch_id", "key_bucket")


def read_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """(EXPORT_KEYS, column_name, description) of every asset's current object.
    An object without columns gives no row."""
    live = current_objects(spark, root)
    if fs.python_reaches(spark, root):
        wanted = live.where("n_columns > 0").select(object_folder(["batch_id", *EXPORT_KEYS]), _object_name(), *EXPORT_KEYS)
        wanted = wanted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *EXPORT_KEYS)
        lines = fs.get_files(wanted, root).select(*EXPORT_KEYS, F.explode(F.slice(F.split("text", "\r\n|\r|\n"), 2, 1 << 30)).alias("line"))
        rows = lines.where("line != ''").select(*EXPORT_KEYS, F.from_csv("line", "column_name STRING, description STRING").alias("r"))
        return rows.select(*EXPORT_KEYS, "r.*").where("column_name IS NOT NULL")
    schema = "column_name STRING, description STRING, batch_id BIGINT, " + ", ".join(f"{k} STRING" for k in EXPORT_KEYS)
    if not [n for n in fs.list_names(spark, root) if n.startswith("batch_id=")]:
        return spark.createDataFrame([], schema).drop("batch_id")
    rows = spark.read.schema(schema).options(header="true").csv(root).where("column_name IS NOT NULL").alias("o")
    key = live.select("batch_id", *EXPORT_KEYS).alias("k")
    same = F.col("o.batch_id") == F.col("k.batch_id")
    for c in EXPORT_KEYS:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"k.{c}"))
    return rows.join(key, same, "left_semi").select(*EXPORT_KEYS, "column_name", "description")


def publish_batch(rows: DataFrame, batch_id: int, root: str, buckets: int = 64,
                  stop_before_publish: bool = False) -> DataFrame:
    """K5 for one batch of good events (EXPORT_KEYS, event_time, event_id,
    columns array): write the objects of the assets whose latest event it
    holds, and publish them. Returns the current objects afterwards.

    A batch that was published before changes nothing. An empty batch publishes
    nothing. An event without a time is older than any other.
    """
    spark = rows.sparkSession
    shared_dir(spark)  # make sure a checkpoint folder is set
    query, number = _split(batch_id)
    snap = latest_snapshot(spark, root)
    if snap["applied"].get(query, -1) >= number:
        return current_objects(spark, root, snap)
    for left in (f"{root}/batch_id={batch_id}", f"{root}/_state/batch={batch_id}"):
        fs.delete(spark, left)  # of a try that was not published
    bucket = F.pmod(F.xxhash64(*EXPORT_KEYS), F.lit(buckets)).cast("int")
    new = rows.select(*EXPORT_KEYS, *ORDER, "columns", F.lit(1).alias("is_new"), F.lit(batch_id).cast("bigint").alias("batch_id"),
                      F.coalesce(F.size("columns"), F.lit(0)).alias("n_columns"), bucket.alias("key_bucket"))
    new = _latest(new).checkpoint()
    touched = [r[0] for r in new.select("key_bucket").distinct().collect()]  # at most ``buckets``
    if not touched:
        return current_objects(spark, root, snap)
    old = current_objects(spark, root, snap).where(F.col("key_bucket").isin(touched)) \
        .withColumn("is_new", F.lit(0)).withColumn("columns", F.lit(None).cast(new.schema["columns"].dataType))
    merged = _latest(new.unionByName(old)).checkpoint() if snap["buckets"] else new
    won = merged.where("is_new = 1").select(*EXPORT_KEYS, "columns")
    _write_objects(won, f"{root}/batch_id={batch_id}")
    (merged.select(*EXPORT_KEYS, *ORDER, "n_columns", "batch_id", "key_bucket").repartition("key_bucket")
     .write.partitionBy("key_bucket").parquet(f"{root}/_state/batch={batch_id}"))
    if stop_before_publish:
        raise StoppedBeforePublish(f"batch {batch_id} is written, not published")
    after = {"version": snap["version"] + 1, "buckets": snap["buckets"] | {str(k): batch_id for k in touched},
             "applied": snap["applied"] | {query: number}}
    if not fs.write_once(spark, f"{root}/_snapshots/{after['version']:012d}.json", json.dumps(after, sort_keys=True)):
        raise ConcurrentPublish(f"snapshot {after['version']} of {root} was published by another writer")
    return current_objects(spark, root, after)


def _object_name() -> F.Column:
    """The name of an asset's object in its folder. Of a null and an empty key,
    which share a folder, each has its own."""
    return F.concat(F.lit("part-"), F.lpad(F.lower(F.hex(F.xxhash64(*[F.coalesce(F.concat(F.lit("="), k), F.lit("")) for k in EXPORT_KEYS]))), 16, "0"), F.lit(".csv"))


def _write_objects(won: DataFrame, folder: str) -> None:
    """One CSV (column_name, description) per row of ``won`` (EXPORT_KEYS and
    columns) under ``folder``; without columns it has one blank line."""
    spark = won.sparkSession
    # Objects are many and small: a fixed number of tasks, which adaptive
    # execution does not merge, each with whole objects.
    won = won.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *EXPORT_KEYS)
    if not fs.python_reaches(spark, folder):
        c = won.select(*EXPORT_KEYS, F.explode_outer("columns").alias("c"))
        (c.select(*EXPORT_KEYS, F.col("c.columnIdentifier").alias("column_name"), F.col("c.description").alias("description"))
         .write.partitionBy(*EXPORT_KEYS).options(**CSV_WRITE_OPTIONS)
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(folder))
        return

    def line(c: F.Column) -> F.Column:
        return F.to_csv(F.struct(c["columnIdentifier"].alias("column_name"), c["description"].alias("description")))

    some = F.when(F.size("columns") > 0, F.col("columns")).otherwise(F.array(F.lit(None).cast(won.schema["columns"].dataType.elementType)))
    text = F.concat(F.lit("column_name,description\n"), F.array_join(F.transform(some, line), "\n"), F.lit("\n"))
    fs.put_files(won.select(F.concat(object_folder(EXPORT_KEYS), _object_name()).alias("path"), text.alias("text")), folder)


def _latest(rows: DataFrame) -> DataFrame:
    """The latest event per key; between equal events the state's own row."""
    rest = [c for c in rows.columns if c not in EXPORT_KEYS]
    last = F.max_by(F.struct(*rest), F.struct(*ORDER, -F.col("is_new")))
    return rows.groupBy(*EXPORT_KEYS).agg(last.alias("_last")).select(*EXPORT_KEYS, "_last.*")


def collect_superseded(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove what no snapshot but the latest ``keep`` refers to: older snapshot
    files, state buckets of batches they do not name, and the folders of batches
    none of whose objects is current in them. Returns these batches' ids. A
    reader of an older snapshot than those kept may lose its files.
    """
    names = [n for n in fs.list_names(spark, f"{root}/_snapshots") if n.endswith(".json")]
    kept = [json.loads(fs.read_text(spark, f"{root}/_snapshots/{n}")) for n in names[-keep:]]
    if not kept:
        return []
    for n in names[:-keep]:
        fs.delete(spark, f"{root}/_snapshots/{n}")
    live, states = set(), set()
    for snap in kept:
        live |= {r[0] for r in current_objects(spark, root, snap).select("batch_id").distinct().collect()}
        states |= set(snap["buckets"].values())
    done = {int(n.split("=")[1]) for n in fs.list_names(spark, root) if n.startswith("batch_id=")}
    # A batch being written now is in no snapshot yet: it is left alone.
    last = kept[-1]["applied"]
    over = sorted(b for b in done - live if last.get(_split(b)[0], -1) >= _split(b)[1])
    for b in over:
        fs.delete(spark, f"{root}/batch_id={b}")
    for n in fs.list_names(spark, f"{root}/_state"):
        b = int(n.split("=")[1])
        if b not in states and last.get(_split(b)[0], -1) >= _split(b)[1]:
            fs.delete(spark, f"{root}/_state/{n}")
    return over
