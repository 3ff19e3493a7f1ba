"""Lake tables: partitioned write (K1), catalog registration (K2), retention (K7)."""

from __future__ import annotations

import datetime as dt
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.profiles import profile_rows, profiled, type_of
from lakeloom.session import shared_dir
from lakeloom.sources import fs

LAYOUTS = {
    "ymd": ["year", "month", "day"],
    "ymd_batch": ["year", "month", "day", "batch_id"],
}
PARTITION_TYPES = {"year": "INT", "month": "INT", "day": "INT", "batch_id": "BIGINT"}

# CSV written by this library keeps timestamps to the microsecond (Spark's
# default CSV format stops at milliseconds).
CSV_WRITE_OPTIONS = {
    "header": "true",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def lake_ddl(columns: list[str], layout: str = "ymd", with_partitions: bool = True) -> str:
    """Schema of a lake table written by K1: the run stamp first, then the data
    columns as strings in their recorded order, then the partition columns.

    CSV is read by position, so the stamp leads: columns that drift in later
    are appended at the end and older files read them as null.
    """
    cols = ["upload_time TIMESTAMP"] + [f"`{c}` STRING" for c in columns]
    if with_partitions:
        cols += [f"{p} {PARTITION_TYPES[p]}" for p in LAYOUTS[layout]]
    return ", ".join(cols)


def batch_folder(run_ts_sql: str, batch_id: int) -> str:
    """Where a batch's rows are, under a table of layout ``ymd_batch``."""
    d = dt.date.fromisoformat(run_ts_sql[:10])
    return f"year={d.year}/month={d.month}/day={d.day}/batch_id={batch_id}"


def write_partitioned(df: DataFrame, path: str, layout: str = "ymd", fmt: str = "csv",
                      max_records_per_file: int | None = None) -> None:
    """K1: write under year=/month=/day=[/batch_id=].

    ``ymd`` appends (as the reference does: at-least-once on a crash before the
    commit). ``ymd_batch`` overwrites only the partitions this batch writes, so
    writing the same batch again gives one copy. No shuffle: all rows of a run
    share one date, each task writes its own file.
    """
    cols = LAYOUTS[layout]
    w = df.write.partitionBy(*cols).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    if layout == "ymd_batch":
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.save(path)


def read_lake_table(spark: SparkSession, path: str, columns: list[str], fmt: str = "csv",
                    layout: str = "ymd") -> DataFrame:
    """Read a table written by K1 with string data columns and typed stamps."""
    if fmt != "csv":
        return spark.read.option("mergeSchema", "true").format(fmt).load(path)
    return spark.read.schema(lake_ddl(columns, layout)).option("header", "true").csv(path)


def infer_types(rows: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The type that gives every value of a text column back (see
    ``operators.profiles``); None for a column without values. One aggregate
    over the rows."""
    df, metrics = profiled(rows, columns)
    if not metrics:
        return {}
    got = df.agg(*metrics).first().asDict()
    return {c: type_of(classes, digits, low, high) for _, _, c, classes, _, digits, low, high in profile_rows(got, columns)}


# Types whose values another one holds unchanged.
WIDER = {("BIGINT", "DECIMAL(38,0)"): "DECIMAL(38,0)"}


def wider(old: str | None, new: str | None) -> str | None:
    """The least type that holds the values of both; STRING if there is none."""
    if old is None or new is None or old == new:
        return old or new
    return WIDER.get((old, new)) or WIDER.get((new, old)) or "STRING"


def partition_spec(batch_id: int, layout: str) -> dict[str, int]:
    """The partition that a batch writes."""
    d = dt.datetime.fromtimestamp(batch_id, dt.timezone.utc)
    parts = {"year": d.year, "month": d.month, "day": d.day, "batch_id": batch_id}
    return {k: parts[k] for k in LAYOUTS[layout]}


def register_table(spark: SparkSession, database: str, table: str, location: str,
                   columns: list[str], layout: str = "ymd", fmt: str = "csv",
                   db_location: str | None = None, batches: list[int] | None = None,
                   types: dict[str, str | None] | None = None) -> str:
    """K2: create the database and an external partitioned table over ``location``.

    The types of a CSV table's columns are ``types`` (of all its rows; ``ingest``
    profiles them as it writes), or else inferred from the rows of the run's
    ``batches`` (all rows without them) and joined with those the table has. A
    column without values is text for now. When a type changes, a second entry
    with all partitions is made and takes the first one's name; the data stays
    as it is. New columns are added on drift. Of a table that exists, only the
    batches' partitions are added. Returns ``db.table``.
    """
    from lakeloom.sinks.assets import ensure_database

    name, parts = f"`{database}`.`{table}`", LAYOUTS[layout]
    ensure_database(spark, database, db_location)
    exists = spark.catalog.tableExists(name)
    specs = [partition_spec(b, layout) for b in batches or []]
    have = {f.name.lower(): f.dataType.simpleString().upper() for f in spark.table(name).schema} if exists else {}
    if fmt != "csv":
        want: dict[str, str] = dict.fromkeys(columns, "STRING")
    elif types is not None:
        want = {c: types.get(c) or "STRING" for c in columns}
    else:
        rows = read_lake_table(spark, location, columns, fmt, layout)
        if specs:
            rows = rows.where(functools.reduce(lambda x, y: x | y, [
                functools.reduce(lambda x, y: x & y, [F.col(k) == v for k, v in s.items()]) for s in specs]))
        found = infer_types(rows, columns) if specs or not exists else dict.fromkeys(columns)
        want = {c: wider(have.get(c.lower()), found[c]) or "STRING" for c in columns}
    if not exists:
        _create(spark, name, columns, want, layout, fmt, location)
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return f"{database}.{table}"
    if any(have.get(c.lower(), t) != t for c, t in want.items()):
        known = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]  # names only
        known = [dict(x.split("=", 1) for x in p.split("/")) for p in known]
        fresh, old = (f"`{database}`.`{table}_{x}_{uuid.uuid4().hex[:8]}`" for x in ("new", "old"))
        _create(spark, fresh, columns, want, layout, fmt, location)
        _add_partitions(spark, fresh, known + specs)
        # Both renames only change names; readers between them find no table.
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        spark.sql(f"DROP TABLE {old}")  # external: the files stay
    else:
        extra = [c for c in columns if c.lower() not in have]
        if extra:
            spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{c}` {want[c]}' for c in extra)})")
        _add_partitions(spark, name, specs)
    if batches is None:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return f"{database}.{table}"


def _create(spark: SparkSession, name: str, columns: list[str], types: dict[str, str], layout: str, fmt: str, location: str) -> None:
    parts = LAYOUTS[layout]
    opts = "OPTIONS (header 'true')" if fmt == "csv" else ""
    ddl = ["upload_time TIMESTAMP"] + [f"`{c}` {types[c]}" for c in columns] + [f"{p} {PARTITION_TYPES[p]}" for p in parts]
    spark.sql(f"CREATE TABLE {name} ({', '.join(ddl)}) USING {fmt} "
              f"{opts} PARTITIONED BY ({', '.join(parts)}) LOCATION '{location}'")


def _add_partitions(spark: SparkSession, name: str, specs: list[dict]) -> None:
    for i in range(0, len(specs), 500):  # one statement per chunk keeps the command's size bounded
        clause = " ".join("PARTITION (" + ", ".join(f"{k}={v}" for k, v in s.items()) + ")" for s in specs[i:i + 500])
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {clause}")


def expire_partitions(spark: SparkSession, table: str, keep_days: int = 90,
                      now: dt.date | str | None = None) -> list[dict]:
    """K7: drop partitions whose date is more than ``keep_days`` before ``now``.

    Works from the catalog's partition list (metadata only). For an external
    table the partition folders are deleted as well, since dropping the
    partition alone leaves the files. Returns the dropped partition specs.
    """
    if now is None:
        now = dt.datetime.now(dt.timezone.utc).date()
    if isinstance(now, str):
        now = dt.date.fromisoformat(now[:10])
    cutoff = now - dt.timedelta(days=keep_days)
    parts = (spark.sql(f"SHOW PARTITIONS {table}")
             .select(F.regexp_extract("partition", r"year=(\d+)", 1).alias("y"),
                     F.regexp_extract("partition", r"month=(\d+)", 1).alias("m"),
                     F.regexp_extract("partition", r"day=(\d+)", 1).alias("d"),
                     "partition")
             # try_: a folder that is not a valid date is kept, never a failure.
             .where(F.try_to_date(F.concat_ws("-", "y", "m", "d"), "y-M-d") < F.lit(cutoff))
             .collect())
    if not parts:
        return []
    meta = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name IN ('Type', 'Location')").collect()
    info = {r["col_name"]: r["data_type"] for r in meta}
    specs = []
    for r in parts:
        kv = dict(item.split("=", 1) for item in r["partition"].split("/"))
        specs.append(kv)
    # One statement per chunk keeps the command size bounded.
    for i in range(0, len(specs), 500):
        chunk = specs[i:i + 500]
        clause = ", ".join("PARTITION (" + ", ".join(f"{k}={v}" for k, v in s.items()) + ")"
                           for s in chunk)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {clause}")
    if info.get("Type", "").upper() == "EXTERNAL":
        root = info["Location"].rstrip("/")
        for s in specs:
            fs.delete(spark, root + "/" + "/".join(f"{k}={v}" for k, v in s.items()))
    return specs


def expire_rows(spark: SparkSession, table: str, time_col: str, keep_days: int = 90,
                now: dt.datetime | dt.date | str | None = None) -> tuple[str, bool]:
    """K7 for a managed table without date partitions: rows whose ``time_col``
    is more than ``keep_days`` before ``now`` go; rows without a time stay.

    Of a partitioned table only the partitions that hold such rows are written
    again (their kept rows are checkpointed first, since a partition cannot be
    read and written at once) and those left empty are dropped. Another table's
    kept rows are written as a new table, which then takes the old one's name;
    only then is the old one dropped, so a crash leaves one whole table under its
    own name or, between two renames, beside it. Nothing is written if no row is
    too old. Returns the table's name and whether it was rewritten.
    """
    if now is None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    cutoff = F.lit(str(now)).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(keep_days)} DAYS")
    info = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(
        "col_name IN ('Type', 'Provider', 'Database', 'Table')").collect()}
    if info.get("Type", "").upper() != "MANAGED":
        raise ValueError(f"{table} is no managed table; drop its files where they are made")
    rows = spark.table(table)
    old = F.try_to_timestamp(F.col(time_col).cast("string")).cast("timestamp_ntz") < cutoff
    if rows.where(old).isEmpty():
        return table, False
    database, name, tag = info["Database"], info["Table"], uuid.uuid4().hex[:8]
    fresh, gone = f"`{database}`.`{name}_new_{tag}`", f"`{database}`.`{name}_old_{tag}`"
    parts = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    kept = rows.where(~F.coalesce(old, F.lit(False)))
    if parts:
        shared_dir(spark)  # make sure a checkpoint folder is set
        touched = rows.where(old).select(*parts).distinct().checkpoint()
        same = functools.reduce(lambda x, y: x & y, [F.col(f"r.`{c}`").eqNullSafe(F.col(f"t.`{c}`")) for c in parts])
        kept = kept.alias("r").join(touched.alias("t"), same, "left_semi").checkpoint()
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(f"`{database}`.`{name}`")
        left = kept.select(*parts).distinct()
        for r in touched.alias("r").join(left.alias("t"), same, "left_anti").collect():  # partition values only
            spec = ", ".join(f"`{c}` = " + ("NULL" if r[c] is None else "'" + str(r[c]).replace("\\", "\\\\").replace("'", "\\'") + "'") for c in parts)
            spark.sql(f"ALTER TABLE `{database}`.`{name}` DROP IF EXISTS PARTITION ({spec})")
        return f"{database}.{name}", True
    kept.write.format(info.get("Provider", "parquet")).saveAsTable(fresh)
    spark.sql(f"ALTER TABLE `{database}`.`{name}` RENAME TO {gone}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO `{database}`.`{name}`")
    spark.sql(f"DROP TABLE {gone}")
    return f"{database}.{name}", True
