"""Document fingerprints: bottom-k sketches of shingle hashes.

A fingerprint holds the ``k`` least distinct 64-bit hashes of a text's word
shingles (five words between white space, lower-cased; a text of fewer words
has one shingle, its whole sequence; without words it has none), ascending.
Equal texts have equal fingerprints. Fingerprints of parts merge into that of
the whole: the ``k`` least of their union.

Estimates from two fingerprints a and b, with u the ``k`` least hashes of both:
resemblance is the share of u that is in a and in b; the number of distinct
shingles is (k - 1) / (greatest hash, scaled to 0..1), exact below k; the
common shingles are resemblance times distinct(u); containment is these over
distinct(a). All are exact while the sets have at most ``k`` shingles.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import TMP, prepare

K = 64
N = 5
SPACE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def sketch(name: str, n: int = N, k: int = K) -> Column:
    """The fingerprint of the word array in column ``name`` (a column by name,
    so that the words are made once)."""
    w = F.col(name)
    full = F.transform(F.sequence(F.lit(0), F.size(w) - n),
                       lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    short = F.array(F.xxhash64(*[F.get(w, F.lit(j)) for j in range(n)]))
    hashes = F.when(F.size(w) >= n, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))
    return bottom(hashes, k)


def bottom(hashes: Column, k: int = K) -> Column:
    """The ``k`` least distinct values, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def union(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; two empty sets are alike (1)."""
    u = union(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), u))
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that are in b; 1 if a has none."""
    common = resemblance(a, b, k) * distinct_count(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def encode(a: Column) -> Column:
    """A fingerprint as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_parts(parts: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One fingerprint per key from the fingerprints of its parts.

    Hashes are ranked per key; Spark keeps only the first ``k`` of a key in
    each task before the shuffle, so a hot key sends ``k`` rows a task. Keys
    may be null; parts without shingles leave an empty fingerprint.
    """
    ident = F.struct(*[F.col(f"`{c}`") for c in keys])
    rows = parts.select(ident.alias(f"{TMP}k"), F.explode_outer(sketch_col).alias(f"{TMP}h"))
    rank = W.partitionBy(f"{TMP}k").orderBy(F.col(f"{TMP}h").asc_nulls_last())
    least = rows.withColumn(f"{TMP}r", F.dense_rank().over(rank)).filter(F.col(f"{TMP}r") <= k)
    got = least.groupBy(f"{TMP}k").agg(F.sort_array(F.collect_set(f"{TMP}h")).alias(f"{TMP}s"))
    return got.select(*[F.col(f"{TMP}k.`{c}`").alias(c) for c in keys], F.col(f"{TMP}s").alias(sketch_col))


# -- each document against its edited text and the next document ---------------

def _cuts(ids: DataFrame, n: int) -> list[int]:
    """At most ``n - 1`` ascending ids that cut the ids into blocks of like size."""
    got = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 100 * n))).first()[0] if n > 1 else None
    return sorted(set(got or []))


def _block(cuts: list[int]) -> Column:
    """Number of cuts that are at most ``id``, in two short looks instead of
    one long one; -1 for a null id."""
    def below(xs: Column) -> Column:
        return F.size(F.filter(xs, lambda c: c <= F.col("id")))

    every = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    step = max(1, int(len(cuts) ** 0.5))
    coarse = below(F.array(*map(F.lit, cuts[::step])).cast("array<bigint>"))
    fine = F.when(coarse == 0, F.lit(0)).otherwise(
        (coarse - 1) * step + below(F.slice(every, F.greatest(coarse - 1, F.lit(0)) * step + 1, F.lit(step))))
    return F.when(F.col("id").isNull(), F.lit(-1)).otherwise(fine)


def with_next(docs: DataFrame, id_col: str, text_col: str, n_blocks: int, n: int = N, k: int = K) -> DataFrame:
    """(id, text, fp, next_text, next_fp): each document, its fingerprint, and
    the next document in descending id order; after the last comes the first.

    The ids are cut into ``n_blocks`` blocks. A block also gets, as a guest,
    the first row of the block that follows it, so every row finds its
    successor in its own block, and each text is shuffled once. Only the
    blocks' first ids reach the driver. Rows alike in id are ordered by a hash
    of their texts, null ids come last.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = _cuts(d.filter("id IS NOT NULL"), n_blocks)
    d = d.withColumn("tie", F.xxhash64("text")).withColumn("blk", _block(cuts))
    heads = d.groupBy("blk").agg(F.max(F.struct("id", "tie")).alias("head")).orderBy("blk").collect()
    # A block's successor is the block below it; the lowest is followed by the top.
    hosts = [(heads[i].blk, heads[i].head.tie, heads[(i + 1) % len(heads)].blk, heads[i].head.id is None, heads[i].head.id or 0)
             for i in range(len(heads))]
    guests = docs.sparkSession.createDataFrame(hosts, "blk int, tie bigint, host int, none boolean, head bigint") if hosts else None
    d = d.withColumn("w", words(F.col("text"))).select("id", "text", "tie", "blk", sketch("w", n, k).alias("fp"))
    if guests is None:
        return d.select("id", "text", "fp", F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))
    d = d.withColumn("none", F.col("id").isNull()).withColumn("head", F.coalesce("id", F.lit(0)).cast("bigint"))
    d = d.join(F.broadcast(guests), ["blk", "tie", "none", "head"], "left")
    seats = F.array(F.struct(F.col("blk").alias("b"), F.lit(False).alias("guest")),
                    F.struct(F.col("host").alias("b"), F.lit(True).alias("guest")))
    d = d.withColumn("seat", F.explode_outer(F.filter(seats, lambda s: s["b"].isNotNull())))
    w = W.partitionBy("seat.b").orderBy("seat.guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    d = d.select("id", "text", "fp", "seat", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp"))
    return d.filter(~F.col("seat.guest")).drop("seat")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, k: int = K) -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, ``fp``, ``edited_fp``
    (arrays), near_edited, near_next.

    The edited text swaps the last third (rounded down, code points) for as
    many code points from the start of the next document, or all it has. A null
    text counts as empty; a single row is followed by itself. Only the two
    named columns are read. An empty table gives an empty result. Ids are whole
    numbers, since blocks are ranges of them; text that is no number fails the
    job. Rows without an id, and rows that share one, are in one block.
    """
    spark = docs.sparkSession
    prepare(spark)
    # Blocks are dealt to partitions by hash: several small ones each even out.
    blocks = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = with_next(docs, id_col, text_col, blocks, n, k)
    size, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    d = d.withColumn("n_chars", size.cast("bigint")).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third)))
    d = d.withColumn("w", words(F.col("edited"))).withColumn("edited_fp", sketch("w", n, k))
    return d.select(F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp",
                    resemblance(F.col("fp"), F.col("edited_fp"), k).alias("near_edited"),
                    resemblance(F.col("fp"), F.col("next_fp"), k).alias("near_next"))
