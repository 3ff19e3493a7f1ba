"""Mixing sources to target weights by temperature.

**Exponent.** A source's share p of all tokens becomes a weight proportional to
p ** a, with a in steps of 1/1024 from 0 (all sources alike) to 1 (as they
are). Bisection finds the flattest mixture in which no source repeats more than
``max_repeats`` times within the budget, or the mixture closest to the natural
one whose entropy is at least ``min_entropy`` (in nats). Both bounds move one
way with a. A source's token total is one row; one tiny aggregate over these
rows answers each step.

**Realisation.** A source's budget of t tokens is spent in blocks. Every full
block is a permutation of all its documents, and the last, partial block takes
the documents of one more permutation while their running total stays within
what is left. A permutation is the order of a hash of (seed, block, id), so
each document decides by itself in which blocks it occurs: it only needs its
source's row, whose ``u_cut`` is the hash up to which the partial block goes.
``u_cut`` comes from sums over hash bands and a running total inside the one
band where the budget ends, so no source is ever held by a single task.
``position`` (0 to 1) interleaves the sources in proportion to their budgets.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.operators.lookups import fits_broadcast

from .common import TMP, cut, prepare

STEPS = 1024
BANDS = 4096
WORDS = r"[^ \t\n\x0B\f\r]+"


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key that is never null: null is a source of its own."""
    s = source.cast("string")
    return F.when(s.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), s))


def unit(seed: int, block: Column, ident: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def exponent(sources: DataFrame, total: int, budget: int, max_repeats: float | None,
             min_entropy: float | None) -> int:
    """The step (0 to 1024) of the exponent for ``sources`` (src, n)."""
    def measure(step: int) -> tuple[float, float]:
        p = F.col("n") / F.lit(float(total))
        raw = F.pow(p, F.lit(step / STEPS))
        r = sources.select(raw.alias("r"), "n").agg(
            F.sum("r").alias("z"), F.sum(F.col("r") * F.log("r")).alias("rl"), F.max(F.col("r") / F.col("n")).alias("rep")).first()
        # Entropy of r / z: log z - sum(r log r) / z.
        return math.log(r.z) - r.rl / r.z, r.rep / r.z * budget

    def fine(step: int) -> bool:
        h, rep = measure(step)
        return rep <= max_repeats + 1e-9 if max_repeats is not None else h >= min_entropy - 1e-9

    lo, hi = 0, STEPS
    if max_repeats is not None:  # the least step within the limit; 1024 if there is none
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if fine(mid) else (mid + 1, hi)
        return lo
    while lo < hi:  # the greatest step with enough entropy; 0 if there is none
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fine(mid) else (lo, mid - 1)
    return lo


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: int | None,
         max_repeats: float | None, min_entropy: float | None, seed: int) -> DataFrame:
    """One row per source with tokens: src, n (its tokens), weight, t (its
    budget), full (number of full blocks), u_cut."""
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("give either max_repeats or min_entropy")
    rows = cut(docs.select(_key(F.col(source_col)).alias("src"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("k")))
    sources = cut(rows.groupBy("src").agg(F.sum("k").alias("n")).filter("n > 0"))
    total = sources.agg(F.sum("n")).first()[0] or 0
    budget = total if budget is None else budget
    step = exponent(sources, total, budget, max_repeats, min_entropy) if total else 0
    raw = F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(step / STEPS))
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    src = sources.withColumn("weight", raw / F.lit(z)) \
        .withColumn("t", F.floor(F.col("weight") * budget + F.lit(1e-6))) \
        .withColumn("full", F.expr("t div n")).withColumn("left", F.expr("t % n"))
    src = cut(src)
    # Where the partial block ends: first its band, then the hash inside it.
    mine = rows.join(_small(src.select("src", "full", "left")), "src") \
        .select("src", "k", "left", unit(seed, F.col("full"), F.col("id")).alias("u")) \
        .withColumn("band", F.floor(F.col("u") * BANDS).cast("int"))
    bands = mine.groupBy("src", "band").agg(F.sum("k").alias("k"), F.first("left").alias("left"))
    so_far = W.partitionBy("src").orderBy("band").rowsBetween(W.unboundedPreceding, W.currentRow)
    bands = bands.withColumn("upto", F.sum("k").over(so_far))
    last = bands.filter(F.col("upto") > F.col("left")).groupBy("src").agg(F.min_by(F.struct(
        "band", (F.col("upto") - F.col("k")).alias("before")), "band").alias("b")).select("src", "b.band", "b.before")
    inside = mine.join(_small(last), ["src", "band"])
    run = W.partitionBy("src", "band").orderBy("u")  # ties together: both or none
    inside = inside.withColumn("upto", F.col("before") + F.sum("k").over(run)).filter(F.col("upto") <= F.col("left"))
    # If no document of the band fits, everything below the band is in.
    ends = last.join(inside.groupBy("src").agg(F.max("u").alias("u")), "src", "left").select(
        "src", F.coalesce(F.col("u"), F.col("band") / F.lit(float(BANDS)) - F.lit(2.0 ** -53)).alias("u_cut"))
    return cut(src.join(ends, "src", "left").select(
        "src", "n", "weight", "t", "full", F.when(F.col("left") == 0, F.lit(-1.0)).otherwise(F.col("u_cut")).alias("u_cut")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        budget: int | None = None, max_repeats: float | None = None, min_entropy: float | None = None,
        seed: int = 0) -> DataFrame:
    """``docs``, each row as often as its blocks say, with ``__ll_tokens``,
    ``__ll_block`` (0, 1, ...) and ``__ll_position``.

    ``budget`` is in tokens, by default that of the whole table. Null texts
    count as empty. Empty documents cost nothing and occur in every block of
    their source; a source without any token has weight zero and no rows. Null
    is a source of its own. Rows alike in id are in a partial block together or
    not at all. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    src = plan(docs, id_col, text_col, source_col, budget, max_repeats, min_entropy, seed)
    names = {c: f"{TMP}{c}" for c in ("src", "n", "t", "full", "u_cut")}
    src = src.select(*[F.col(a).alias(b) for a, b in names.items()])
    d = docs.withColumn(names["src"], _key(F.col(source_col))).join(_small(src), names["src"])
    full, cut_ = F.col(names["full"]), F.col(names["u_cut"])
    whole = F.when(full > 0, F.sequence(F.lit(0).cast("long"), full - 1)).otherwise(F.array().cast("array<bigint>"))
    more = F.when(unit(seed, full, F.col(id_col)) <= cut_, F.array(full)).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn(f"{TMP}tokens", tokens(F.col(text_col))) \
        .withColumn(f"{TMP}block", F.explode_outer(F.concat(whole, more))).filter(F.col(f"{TMP}block").isNotNull())
    block = F.col(f"{TMP}block")
    d = d.withColumn(f"{TMP}position", (block + unit(seed, block, F.col(id_col))) * F.col(names["n"]) / F.col(names["t"]))
    return d.drop(*names.values())
