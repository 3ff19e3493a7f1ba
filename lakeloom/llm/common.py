"""Small helpers shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import apply_runtime_defaults, shared_dir

# Every helper column starts with this, so tables may carry any other names.
TMP = "__ll_"


def prepare(spark: SparkSession) -> None:
    """Session settings, package shipping and the shared checkpoint folder."""
    apply_runtime_defaults(spark)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from the columns' values."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def fold(id_col: str, mod: int) -> Column:
    """``crc32(id as text) mod mod``: the fold of a document."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)


def sample_by_count(df: DataFrame, n_rows: int, cap: int, *cols: str, seed: int = 7) -> DataFrame:
    """About ``cap`` of ``n_rows`` rows, chosen by a hash of ``cols``; all of
    them if there are no more than ``cap``."""
    if n_rows <= cap:
        return df
    return df.filter(unit_hash(*[F.col(c) for c in cols], seed=seed) < F.lit(cap / n_rows))


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder."""
    return f"{shared_dir(spark)}/lakeloom-llm/{name}-{uuid.uuid4().hex[:12]}"
