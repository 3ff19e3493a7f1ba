"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item counts as leaked into a document if at least ``threshold`` of the
item's distinct word shingles occur in the document. Documents may be far
longer than items, so similarity of whole sets says nothing; containment does.

**Size partitions.** Items fall into classes by their number n of shingles,
[1], [2, 3], [4, 7], ... An item's MinHash sketch holds the m least of its
shingle hashes, m = allowed(u) + 1 for the class's upper bound u, where
allowed(n) shingles may be missing from a document that still contains n at
the threshold. Of any m shingles such a document has at least
m - allowed(n) >= 1, so no leak is missed, and a document with fewer of the
sketch's values, or fewer shingles than the threshold asks for, is no candidate.

**Verification.** The shingles of candidate documents are then compared as
text with those of their candidate items.

Words are runs of letters and digits, lower-cased. A text with fewer words
than ``n`` has one shingle, its whole sequence; without words it has none. For
items that short, documents also have the shingles of the lengths that occur
among them (n - 1 at most), so such an item is found inside a longer document.

Only DataFrame functions are used. Arrays are exploded by ``explode_outer``:
for ``explode`` the optimizer adds a test of the array's size below the
projection that makes it, which splits each text again for every shingle. A document's shingle hashes come from one
pass over its words. The sketch table is broadcast if its measured size allows
it, and otherwise joined by a shuffle, in which adaptive execution splits hot
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lookups import fits_broadcast

from .common import TMP, cut, prepare


def words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def shingle_hashes(name: str, n: int, also: tuple[int, ...] = ()) -> Column:
    """Distinct 64-bit hashes of the ``n``-word shingles of a word array, and of
    those of the lengths ``also``. It is a column by name, so that the words are
    split once and not once a shingle."""
    w, none = F.col(name), F.array().cast("array<bigint>")

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

    short = F.array(F.xxhash64(*[F.get(w, F.lit(k)) for k in range(n)]))
    full = F.when(F.size(w) >= n, F.array_distinct(of(n))).when(F.size(w) > 0, short).otherwise(none)
    if not also:
        return full
    return F.array_distinct(F.concat(full, *[F.when(F.size(w) >= k, of(k)).otherwise(none) for k in also]))


def shingle_texts(name: str, n: int, also: tuple[int, ...] = ()) -> Column:
    """Distinct shingles of a word array as text, and those of lengths ``also``."""
    w, none = F.col(name), F.array().cast("array<string>")

    def of(k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))

    full = F.when(F.size(w) >= n, F.array_distinct(of(n))).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(none)
    if not also:
        return full
    return F.array_distinct(F.concat(full, *[F.when(F.size(w) >= k, of(k)).otherwise(none) for k in also]))


def short_lengths(items: DataFrame, n: int) -> tuple[int, ...]:
    """The numbers of words, 1 to n - 1, that occur among the items' texts."""
    size = F.size(words(F.col("text")))
    return tuple(sorted(r[0] for r in items.select(size.alias("k")).filter(F.col("k").between(1, n - 1)).distinct().collect()))


def _allowed(n: Column, threshold: float) -> Column:
    """Shingles of ``n`` that may be missing at the threshold."""
    return n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))


def sketches(items: DataFrame, item_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """(item, n_item, need, h): one row per sketch value. ``need`` is how many
    values of the sketch a document must have."""
    sets = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")) \
        .select("item", F.array_sort(shingle_hashes("w", n)).alias("hs")) \
        .withColumn("n_item", F.size("hs")).filter("n_item > 0")
    upper = F.expr("shiftleft(1, length(bin(n_item))) - 1")  # of its class
    sets = sets.withColumn("m", F.least(F.col("n_item"), _allowed(upper, threshold) + 1))
    return sets.select("item", "n_item", F.greatest(F.lit(1), F.col("m") - _allowed(F.col("n_item"), threshold)).alias("need"),
                       F.explode_outer(F.slice("hs", F.lit(1), F.col("m").cast("int"))).alias("h"))


def _keys(ident: str, text: str, name: str) -> list[Column]:
    return [F.xxhash64(ident, text).alias(name), F.xxhash64(F.lit(1), F.col(ident), F.col(text)).alias(f"{name}2")]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """(row_key, row_key2, doc_id, item_id, n_item, n_common, containment) for
    every item leaked into a document; the two keys are hashes of id and text,
    together 128 bits. The first alone serves the search for candidates, where
    documents that share it are more candidates and nothing else.

    Rows alike in id and text count once. Null and empty texts, on either
    side, match nothing; null ids are kept as null. Items alike in id and text
    count once. Only the named columns are read. Empty tables give no rows.
    """
    prepare(docs.sparkSession)
    items = cut(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"),
                             *_keys(item_col, item_text_col, "ikey")).dropDuplicates(["ikey", "ikey2"]))
    short = short_lengths(items, n)
    sk = cut(sketches(items, "ikey", "text", n, threshold))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), *_keys(id_col, text_col, "row_key"))
    grams = d.select("row_key", words(F.col("text")).alias("w")).select("row_key", shingle_hashes("w", n, short).alias("hs")) \
        .select("row_key", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("h"))
    met = grams.join(_small(sk), "h").filter(F.col("n_doc") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))
    pairs = cut(met.groupBy("row_key", "item").agg(F.countDistinct("h").alias("seen"), F.first("need").alias("need"))
                .filter("seen >= need").select("row_key", F.col("item").alias("ikey")))
    some = pairs.select("row_key").distinct()
    texts = d.join(_small(some), "row_key", "left_semi").dropDuplicates(["row_key", "row_key2"])
    texts = texts.select("row_key", "row_key2", "doc", words(F.col("text")).alias("w")) \
        .select("row_key", "row_key2", "doc", F.explode_outer(shingle_texts("w", n, short)).alias("s"))
    its = items.select("ikey", "ikey2", "item", words(F.col("text")).alias("w")) \
        .select("ikey", "ikey2", "item", shingle_texts("w", n).alias("ss"))
    its = its.select("ikey", "ikey2", "item", F.size("ss").alias("n_item"), F.explode_outer("ss").alias("s"))
    hit = texts.join(_small(its), "s").join(pairs, ["row_key", "ikey"], "left_semi")
    out = hit.groupBy("row_key", "row_key2", "ikey", "ikey2").agg(F.first("doc").alias(id_col), F.first("item").alias(item_col),
                                             F.first("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_common"))
    out = out.withColumn("containment", F.col("n_common") / F.col("n_item"))
    return out.filter(F.col("n_common") >= F.ceil(F.col("n_item") * F.lit(threshold) - F.lit(1e-9))).drop("ikey", "ikey2")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the documents into which an item leaked."""
    names = [f"{TMP}key", f"{TMP}key2"]
    bad = cut(leaks(docs, items, id_col, text_col, item_col, item_text_col, n, threshold).select(
        F.col("row_key").alias(names[0]), F.col("row_key2").alias(names[1])).distinct())
    return docs.select("*", *_keys(id_col, text_col, names[0])).join(_small(bad), names, "left_anti").drop(*names)
