"""Column mapping (P4) and the data-dictionary projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_mapper(pairs: list[tuple[str, str]], columns: list[str]) -> None:
    """Raise before any job runs on an unknown ``from`` or a repeated ``to``."""
    have = set(columns)
    unknown = [f for f, _ in pairs if f not in have]
    if unknown:
        raise ValueError(f"mapper names unknown columns: {unknown}")
    seen, dup = set(), []
    for _, t in pairs:
        if t in seen:
            dup.append(t)
        seen.add(t)
    if dup:
        raise ValueError(f"mapper repeats target names: {dup}")


def apply_mapper(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Ordered projection with renames; unmapped columns are dropped."""
    check_mapper(pairs, df.columns)
    return df.select(*[F.col(f"`{f}`").alias(t) for f, t in pairs])


def dictionary_columns(columns_md: DataFrame) -> DataFrame:
    """P5 + P6: ``columnIdentifier`` → ``column_name``; keep name and description.

    Input: one row per column record (after P12), other key columns kept in front.
    """
    keys = [c for c in columns_md.columns if c not in ("columnIdentifier", "description")]
    return columns_md.withColumnRenamed("columnIdentifier", "column_name").select(
        *keys, "column_name", "description")
