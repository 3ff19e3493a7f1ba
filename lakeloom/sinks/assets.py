"""Running a SQL asset (K3)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


# What a query's text may hold besides names: literals and comments.
_QUIET = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*.*?\*/""", re.S)


def _reads_name(query: str, name: str) -> bool:
    query = _QUIET.sub(" ", query)
    return re.search(r"(?<![\w.`])`?" + re.escape(name) + r"`?(?![\w`])", query, re.I) is not None


def ensure_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    """``CREATE DATABASE IF NOT EXISTS``, placed under ``location`` when given
    (a shared folder) instead of the session's default warehouse."""
    where = f" LOCATION '{location.rstrip('/')}/{database}.db'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")


def run_sql_asset(spark: SparkSession, database: str, table: str, query: str,
                  publish: str = "view", location: str | None = None) -> tuple[str, DataFrame]:
    """K3: run the asset's query in its database and publish the result.

    ``publish="view"`` creates or replaces a view in the asset's database, which
    other sessions of the catalog can read; a query over temp views, which the
    catalog cannot keep, becomes a temp view instead. ``"table"`` saves a
    managed table in the database. When the query also reads ``table`` itself,
    the result is called ``<table>_asset``, in every run, so it does not hide its
    own source. Returns (name, result).
    The session's current database is restored afterwards.
    """
    ensure_database(spark, database, location)
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(database)
    try:
        text = query.strip().rstrip(";").strip()
        result = spark.sql(text)
        return _publish(spark, database, table, text, result, publish)
    finally:
        spark.catalog.setCurrentDatabase(before)


def _publish(spark: SparkSession, database: str, table: str, text: str, result: DataFrame,
             publish: str) -> tuple[str, DataFrame]:
    name = table
    if publish == "view":
        if _reads_name(text, table):
            name = f"{table}_asset"  # the same in every run, which replaces it
        try:
            spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS {text}")
            return f"{database}.{name}", spark.table(f"`{database}`.`{name}`")
        except AnalysisException as e:
            if e.getCondition() != "INVALID_TEMP_OBJ_REFERENCE":
                raise
        result.createOrReplaceTempView(name)
        return name, spark.table(name)
    if publish == "table":
        if _reads_name(text, table):
            name = f"{table}_asset"
        result.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
        return f"{database}.{name}", spark.table(f"`{database}`.`{name}`")
    raise ValueError(publish)
