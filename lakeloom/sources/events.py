"""Event envelopes (S7): JSON with nested fields; missing fields read as null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

EVENT_SCHEMA = T.StructType([
    T.StructField("id", _S),
    T.StructField("source", _S),
    T.StructField("detail-type", _S),
    T.StructField("time", _S),
    T.StructField("detail", T.StructType([
        T.StructField("metadata", T.StructType([
            T.StructField("user", _S),
            T.StructField("id", _S),
            T.StructField("domain", _S),
            T.StructField("owningProjectId", _S),
        ])),
        T.StructField("data", T.StructType([
            T.StructField("assetId", _S),
            T.StructField("userId", _S),
        ])),
        T.StructField("bucket", T.StructType([T.StructField("name", _S)])),
    ])),
])


def event_scan(spark: SparkSession, path: str) -> DataFrame:
    """Batch read of JSON-lines envelopes with the fixed schema (no inference)."""
    return spark.read.schema(EVENT_SCHEMA).json(path)


def malformed_events(spark: SparkSession, path: str) -> DataFrame:
    """(line, id): the lines that are no envelopes, which ``event_scan`` reads
    as rows of nulls and matching then drops; ``id`` is what could be read."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("line", _S)])
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "line").json(path)
    # Spark refuses a query of the corrupt-record column alone, hence the id.
    return rows.where(F.col("line").isNotNull()).select("line", "id")


def event_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of the same envelopes (T3 input; T4 batch size)."""
    r = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path)
