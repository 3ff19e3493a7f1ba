"""Small tables for the operators' edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, as further columns of a table.
CLASH = ("id", "fp", "h", "w", "k1", "k2", "raw", "node", "root", "src", "t", "n", "u", "score", "row", "start", "x", "y", "block")


def docs(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """(doc_id, text[, lang, source]) rows as a documents table."""
    full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, df["doc_id"].cast("string"))
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
