"""Run stamp, date parts and batch id."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_clock(run_ts: dt.datetime | str | None = None) -> tuple[str, int]:
    """The run time truncated to whole seconds, as SQL text, and its batch id.

    ``run_ts`` is read as UTC (the session time zone); the batch id is its epoch
    second (P3).
    """
    if run_ts is None:
        run_ts = dt.datetime.now(dt.timezone.utc)
    if isinstance(run_ts, str):
        run_ts = dt.datetime.fromisoformat(run_ts)
    if run_ts.tzinfo is None:
        run_ts = run_ts.replace(tzinfo=dt.timezone.utc)
    run_ts = run_ts.astimezone(dt.timezone.utc).replace(microsecond=0)
    return run_ts.strftime("%Y-%m-%d %H:%M:%S"), int(run_ts.timestamp())


def batch_id_of(ts: Column) -> Column:
    """Epoch seconds of a timestamp column."""
    return F.unix_timestamp(ts)


def date_parts(ts: Column, prefix: str = "") -> list[Column]:
    """Year, month and day (unpadded ints) of a timestamp column."""
    return [F.year(ts).alias(f"{prefix}year"), F.month(ts).alias(f"{prefix}month"),
            F.dayofmonth(ts).alias(f"{prefix}day")]


def stamp_upload_time(df: DataFrame, run_ts_sql: str, batch_id: int | None = None) -> DataFrame:
    """P1 + P2 (+ P3): one constant run timestamp and its partition columns.

    The stamp is the first column (see ``sinks.tables.lake_ddl``); the
    partition columns go last and become folders.
    """
    ts = F.expr(f"CAST('{run_ts_sql}' AS TIMESTAMP)")
    cols = date_parts(ts)
    if batch_id is not None:
        cols.append(F.lit(batch_id).cast("bigint").alias("batch_id"))
    return df.select(ts.alias("upload_time"), "*", *cols)
