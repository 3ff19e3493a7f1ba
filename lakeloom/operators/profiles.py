"""Column profiles and the types that follow from them (K2).

A value of a text column belongs to one lexical class: how it is spelled and
which type would give the same spelling back. A column's profile counts its
values per class, with lengths, digits and decimal places; profiles of batches
add up. A type is chosen only if every value reads back as it was written, so
leading zeros, plus signs, long ids and trailing zeros keep their text. The one
exception is a column of whole and real numbers: it becomes DOUBLE if all whole
ones have at most 15 digits, where the numbers stay equal though not their
spelling.

Profiles are collected while the rows are written (``observe``), so no second
pass over the data is needed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lexical classes.
SHORT_WHOLE = "whole, 15 digits at most"
LONG_WHOLE = "whole, fits BIGINT"
WIDE_WHOLE = "whole, 38 digits at most"
REAL = "decimal point, DOUBLE spells it alike"
FIXED = "decimal point, trailing zeros or many digits"
FLOATING = "exponent or special number"
BOOL, DAY, TIME, TEXT = "true or false", "date", "timestamp", "text"
CLASSES = [SHORT_WHOLE, LONG_WHOLE, WIDE_WHOLE, REAL, FIXED, FLOATING, BOOL, DAY, TIME, TEXT]

PROFILE_SCHEMA = ("ctx STRING, batch_id BIGINT, column STRING, classes MAP<STRING, BIGINT>, max_length INT, "
                  "max_digits INT, min_scale INT, max_scale INT")


def _digits(v: Column, others: Column | int = 0) -> Column:
    """How many digits a number has that is known to hold, besides them, at
    most a leading minus and ``others`` more characters."""
    return F.length(v) - F.when(F.startswith(v, F.lit("-")), 1).otherwise(0) - others


def lexical_class(v: Column) -> Column:
    """The number (in CLASSES) of a text value's class; null for null.

    This runs for every value of a table, so the shape is told by its first
    character, length and point, and each test is made only where it can hold:
    a parser that fails by an exception sees no value that is no number.
    """
    cls = {c: F.lit(i) for i, c in enumerate(CLASSES, 1)}

    def spelled(kind: str) -> Column:
        return v.try_cast(kind).cast("string") == v

    size, digit = F.length(v), F.substring(v, 1, 1).between("0", "9")
    point = F.when(spelled("double"), cls[REAL]).when((_digits(v, 1) <= 38) & ~v.rlike(r"^-0\.0+\z"), cls[FIXED]).otherwise(cls[TEXT])
    whole = F.when(_digits(v) <= 15, cls[SHORT_WHOLE]).when(v.try_cast("bigint").isNotNull(), cls[LONG_WHOLE]) \
        .when(_digits(v) <= 38, cls[WIDE_WHOLE]).otherwise(cls[TEXT])
    time = size.between(19, 26) & v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?\z") & spelled("timestamp_ntz")
    with_point = (F.when(v.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+\z"), point).when(time, cls[TIME])
                  .when(v.rlike(r"^-?[0-9]+\.[0-9]+E-?[0-9]+\z"), F.when(spelled("double"), cls[FLOATING]).otherwise(cls[TEXT]))
                  .otherwise(cls[TEXT]))
    without = (F.when(v.rlike(r"^(0|-?[1-9][0-9]*)\z"), whole).when(digit & (size == 10) & spelled("date"), cls[DAY]).when(time, cls[TIME])
               .when(v == "-Infinity", cls[FLOATING]).otherwise(cls[TEXT]))
    return (F.when(v.isNull(), F.lit(None)).when(digit | F.startswith(v, F.lit("-")), F.when(F.contains(v, F.lit(".")), with_point).otherwise(without))
            .when(v.isin("true", "false"), cls[BOOL]).when(v.isin("NaN", "Infinity"), cls[FLOATING]).otherwise(cls[TEXT])).cast("int")


def profiled(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with helper columns, and the aggregates that make the profile;
    drop the helpers (their names start with ``_pf``) after observing."""
    extra, metrics = {}, []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        extra[f"_pf_class_{i}"] = lexical_class(v)
        extra[f"_pf_scale_{i}"] = F.when(F.contains(v, F.lit(".")) & v.rlike(r"^-?[0-9]+\.[0-9]+\z"), F.length(F.substring_index(v, ".", -1)))
        k, scale = F.col(f"_pf_class_{i}"), F.col(f"_pf_scale_{i}")
        metrics += [F.count_if(k == j).alias(f"{i}_{j}") for j in range(1, len(CLASSES) + 1)]
        metrics += [F.max(F.length(v)).alias(f"{i}_length"), F.min(scale).alias(f"{i}_low"), F.max(scale).alias(f"{i}_high"),
                    F.max(F.when(k <= 5, _digits(v, F.when(k >= 4, 1).otherwise(0)))).alias(f"{i}_digits")]
    return rows.withColumns(extra) if extra else rows, metrics


def without_helpers(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith("_pf_")])


def profile_rows(got: dict, columns: list[str], ctx: str = "", batch_id: int = 0) -> list[tuple]:
    """PROFILE_SCHEMA rows from the aggregates' values."""
    return [(ctx, batch_id, c, {name: int(got[f"{i}_{j}"] or 0) for j, name in enumerate(CLASSES, 1) if got[f"{i}_{j}"]},
             got[f"{i}_length"], got[f"{i}_digits"], got[f"{i}_low"], got[f"{i}_high"]) for i, c in enumerate(columns)]


def merged(profiles: DataFrame) -> list[tuple]:
    """(column, classes present, max_digits, min_scale, max_scale): one row per
    column over all batches; a batch that was recorded again counts alike."""
    return [tuple(r) for r in profiles.select("*", F.explode_outer(F.map_keys("classes")).alias("k")).groupBy("column").agg(
        F.collect_set("k").alias("k"), F.max("max_digits").alias("d"), F.min("min_scale").alias("l"), F.max("max_scale").alias("h")).collect()]


def type_of(classes: Iterable[str], max_digits: int | None, min_scale: int | None, max_scale: int | None) -> str | None:
    """The least type that gives every value of these classes back; None
    without values."""
    have = set(classes)
    if not have:
        return None
    for kinds, name in (({SHORT_WHOLE, LONG_WHOLE}, "BIGINT"), ({SHORT_WHOLE, LONG_WHOLE, WIDE_WHOLE}, "DECIMAL(38,0)"),
                        ({REAL, FLOATING, SHORT_WHOLE}, "DOUBLE"), ({BOOL}, "BOOLEAN"), ({DAY}, "DATE"), ({TIME}, "TIMESTAMP_NTZ")):
        if have <= kinds:
            return name
    # Before the point and behind it there must be room for every value.
    if have <= {REAL, FIXED} and min_scale == max_scale and (max_digits or 0) <= 38:
        return f"DECIMAL(38,{max_scale})" if (max_digits or 0) + max_scale <= 38 else "STRING"
    return "STRING"
