"""Integer vectors: what the vector operators share.

``integers`` keeps the rows whose vector has exactly ``dims`` components, none
of them null or non-finite, and turns each component x (as a double) into
floor(scale * x). Integers make every distance, sum and tie exact. A component
so large that squared distances might not fit a long raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources import fs

from .common import TMP, fresh

ID, VEC = f"{TMP}id", f"{TMP}v"


def integers(df: DataFrame, keep: list[Column], vec_col: str, dims: int, scale: int) -> DataFrame:
    """The ``keep`` columns and the integer vector ``__ll_v`` (array of int)."""
    v, limit = F.col(vec_col), float(math.isqrt((1 << 62) // (5 * dims)))
    x = F.transform(v, lambda e: e.cast("double"))
    # A null component makes forall null, which the filter takes as false.
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    far = F.raise_error(F.lit(f"a vector component times {scale} is over {limit:.0f}")).cast("int")
    ints = F.transform(x, lambda e: F.when(F.abs(e * F.lit(float(scale))) < F.lit(limit),
                                           F.floor(e * F.lit(float(scale))).cast("int")).otherwise(far))
    return df.filter(F.coalesce((F.size(v) == dims) & whole, F.lit(False))).select(*keep, ints.alias(VEC))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as an (n, dims) array of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a new folder of the shared directory, and that folder."""
    folder = fresh(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def drop(df: DataFrame, folder: str) -> None:
    """Remove a folder that ``kept`` made, once nothing reads it any more."""
    fs.delete(df.sparkSession, folder)


def slot_sums(rows: DataFrame, count) -> dict[int, int]:
    """Sums over all rows of an integer vector of counters, by position.
    ``count(batch)`` gives the counters of a batch; each task adds up its
    batches, so one row per counter and task is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                c = count(b)
                total = c if total is None else total + c
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    parts = rows.mapInArrow(run, "slot long, n long")
    return {r.slot: int(r.n) for r in parts.groupBy("slot").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
