"""Configuration records kept as CSV: mapper (S4) and SQL asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAPPER_SCHEMA = T.StructType([T.StructField("from", T.StringType()),
                              T.StructField("to", T.StringType())])
SQL_ASSET_SCHEMA = T.StructType([T.StructField("database_name", T.StringType()),
                                 T.StructField("table_name", T.StringType()),
                                 T.StructField("sql_query", T.StringType())])


def mapper_scan(spark: SparkSession, path: str) -> DataFrame:
    """``from,to`` pairs; lines starting with ``#`` are comments."""
    return (spark.read.schema(MAPPER_SCHEMA).option("header", "true")
            .option("comment", "#").option("ignoreLeadingWhiteSpace", "true")
            .option("ignoreTrailingWhiteSpace", "true").csv(path))


def mapper_pairs(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The mapper as an ordered list (a configuration file: small and bounded).

    Read as one file in one task so file order is kept.
    """
    rows = mapper_scan(spark, path).coalesce(1).collect()
    return [(r["from"], r["to"]) for r in rows if r["from"] is not None]


def sql_asset_scan(spark: SparkSession, path: str) -> DataFrame:
    """``database_name,table_name,sql_query``; the query may hold commas,
    doubled quotes and newlines."""
    return (spark.read.schema(SQL_ASSET_SCHEMA).option("header", "true")
            .option("multiLine", "true").option("escape", '"').csv(path))


def sql_asset(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """The single record of a SQL asset file; anything but one row raises."""
    rows = sql_asset_scan(spark, path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a SQL asset holds exactly one record, {path} has {len(rows)}+")
    r = rows[0]
    return r["database_name"], r["table_name"], r["sql_query"]


def write_sql_asset(spark: SparkSession, path: str, database: str, table: str, query: str) -> None:
    """Write a SQL asset record (one small config file) as CSV with doubled quotes."""
    (spark.createDataFrame([(database, table, query)], SQL_ASSET_SCHEMA).coalesce(1)
     .write.mode("overwrite").option("header", "true").option("escape", '"')
     .option("quoteAll", "true").csv(path))


def write_mapper(spark: SparkSession, path: str, pairs: list[tuple[str, str]]) -> None:
    """Write a mapper file (one small config file)."""
    (spark.createDataFrame(pairs, MAPPER_SCHEMA).coalesce(1)
     .write.mode("overwrite").option("header", "true").csv(path))
