"""Session settings and the shared work folder.

Every job that stages files, keeps a manifest or cuts lineage writes under one
shared folder: the one the cluster names in ``spark.checkpoint.dir``. Only when
that setting is absent (a laptop, a test) do we make a local folder and point
the checkpoint directory at it.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every session of this library relies on. Time zone is pinned so the
# run stamp and its date parts do not depend on the machine; AQE re-plans joins
# and aggregations from runtime sizes and splits skewed shuffle partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lakeloom", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_defaults(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lakeloom`` importable in the Python workers (``mapInPandas``).

    The package is zipped once per application and handed to
    ``SparkContext.addPyFile``, which copies it to every executor, the same
    as ``spark-submit --py-files``. Nothing is done where the workers can
    already import it from a zip shipped earlier in this application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    # A driver-side build artifact that Spark itself ships; not a data folder.
    target = os.path.join(tempfile.mkdtemp(prefix="lakeloom-pyfiles-"), "lakeloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def apply_runtime_defaults(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (no-op if equal).

    File listings of many folders (per-key exports, date partitions, source
    drops) run as a Spark job with, by default, one task per folder up to
    10,000. A few listing tasks per core are enough: the cap scales with the
    cluster's default parallelism and never exceeds Spark's own default.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism",
                   str(min(10_000, max(8, 4 * cores))))


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for state, staging and checkpoints.

    Read from ``spark.checkpoint.dir`` (or a checkpoint dir already set on the
    context). Only where neither is set is a local folder created and used.
    """
    conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        # setCheckpointDir adds a random child folder; use its parent as root.
        return current.rstrip("/").rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="lakeloom-")
    spark.sparkContext.setCheckpointDir(root + "/checkpoints")
    return spark.sparkContext.getCheckpointDir().rstrip("/").rsplit("/", 1)[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared folder."""
    return f"{shared_dir(spark)}/lakeloom/{name}-{uuid.uuid4().hex[:12]}"
