"""SimHash near-dedup with pigeonhole blocks.

**Fingerprint.** A-Z are lower-cased, words are runs of bytes other than ASCII
white space, shingles are ``n`` words joined by a space, repeats included. Each
shingle votes with its XXH64 (seed 42); a bit is 1 if set in over half of the
hashes. A text with fewer words has one shingle, the whole sequence; a text
without words (null included) has fingerprint zero, which links like any other.

**Links.** Two fingerprints with at most ``bits`` differing bits agree on at
least ``blocks - bits`` of ``blocks`` blocks. Every set of that many blocks is
a join key (six blocks and four bits: 15 keys of some 21 bits), so each close
pair meets under some key, and the Hamming distance is then checked. The number
of blocks follows from the number of distinct fingerprints: the fewest whose keys
are wide enough for a key to hold two of them on average (``blocks_for``). More
blocks mean wider and more keys, so candidates stay in proportion to the
fingerprints at any size; the links found are the same.

**Large groups.** Equal fingerprints are one node. Under each key the members
are first held against the key's least member only, which is linear and joins
most of a group of near copies. The exact join then runs over keys whose
members are still in different components, and only for pairs of different
components, so a group of copies is never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TMP, cut, prepare
from .graph import components

SEED = 42
_STEP = 1 << 16


def fingerprint(raw: bytes, n: int) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = raw.lower().split()  # bytes.split: exactly \\x20 and \\x09-\\x0D
    if not words:
        return 0
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total, votes, h = len(words) - n + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, total, _STEP):
        part = words[lo:lo + _STEP + n - 1]
        grams = zip(*(part[i:] for i in range(n)))
        hs = np.fromiter((h(b" ".join(g), SEED) for g in grams), np.dtype(">u8"))
        votes += np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str, keep: list[Column], n: int) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint as a signed long)."""
    cols = df.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(f"{TMP}raw"))
    schema = cols.drop(f"{TMP}raw").schema.add(f"{TMP}fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(b.num_columns - 1)
            fps = np.fromiter((fingerprint(x.as_py(), n) for x in raw), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=[*b.schema.names[:-1], f"{TMP}fp"])

    return cols.mapInArrow(run, schema).withColumnRenamed(f"{TMP}fp", "fp")


def blocks_for(n: int, bits: int) -> int:
    """The fewest blocks, from ``bits`` + 2, whose narrowest key has at least
    log2(n) - 1 bits: 6 up to 2 million fingerprints at a distance of 4,
    7 to 268 million, 8 to 8.6 billion."""
    blocks = bits + 2
    while blocks < 16:
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        narrow = sum(sorted(hi - lo for lo, hi in zip(edges, edges[1:]))[:blocks - bits])
        if narrow >= math.log2(max(n, 2)) - 1:
            break
        blocks += 1
    return blocks


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """The join keys of a fingerprint: one per set of ``blocks - bits`` blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    keys = []
    for i, which in enumerate(combinations(range(blocks), blocks - bits)):
        mask = sum(masks[b] for b in which)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(mask)).alias("v")))
    return F.array(*keys)


def _close(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def near_components(fps: DataFrame, bits: int, blocks: int | None = None) -> DataFrame:
    """``fps`` (distinct fp) -> (fp, root): the component of every fingerprint,
    root its least fingerprint. ``blocks`` follows from their number if not given."""
    blocks = blocks or blocks_for(fps.count(), bits)
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), bits, blocks)).alias("k")) \
        .select("fp", F.col("k.t").alias("t"), F.col("k.v").alias("v"))
    # Linear pass: every member against the least member of its key.
    first = keyed.groupBy("t", "v").agg(F.min("fp").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    near = keyed.join(first, ["t", "v"]).filter((F.col("fp") != F.col("p")) & _close("fp", "p", bits))
    stars = cut(near.select(F.col("fp").alias("a"), F.col("p").alias("b")).distinct())
    roots = components(stars)
    noted = cut(fps.join(roots, F.col("fp") == F.col("node"), "left")
                .select("fp", F.coalesce("root", "fp").alias("root")))
    # Exact pass: what is left between different components under one key.
    keyed = noted.select("fp", "root", F.explode(block_keys(F.col("fp"), bits, blocks)).alias("k")) \
        .select("fp", "root", F.col("k.t").alias("t"), F.col("k.v").alias("v"))
    mixed = keyed.groupBy("t", "v").agg(F.min("root").alias("r1"), F.max("root").alias("r2")) \
        .filter("r1 < r2").select("t", "v")
    open_ = keyed.join(mixed, ["t", "v"])
    a = open_.select("t", "v", F.col("fp").alias("fa"), F.col("root").alias("ra"))
    b = open_.select("t", "v", F.col("fp").alias("fb"), F.col("root").alias("rb"))
    rest = a.join(b, ["t", "v"]).filter((F.col("ra") < F.col("rb")) & _close("fa", "fb", bits)) \
        .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    tops = components(rest).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return noted.join(tops, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   n: int = 4, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (long), ``text_hash``, ``root``
    (least fingerprint of the component, signed) and ``component_id`` (least id
    of the component).

    Null and empty texts have fingerprint zero and form one component with any
    fingerprint near zero. Repeated rows stay repeated. Rows without an id get
    the component's least id, null if no member has one. Only the id and text
    columns are read, so further columns may have any name. An empty table
    gives an empty result.
    """
    prepare(docs.sparkSession)
    every = with_fingerprint(docs, text_col, [F.col(id_col).alias(f"{TMP}id"), F.xxhash64(text_col).alias("text_hash")], n)
    every = cut(every)
    least = every.groupBy("fp").agg(F.min(f"{TMP}id").alias("low"))
    least = cut(least)
    roots = cut(near_components(least.select("fp"), bits, blocks))
    comp = roots.join(least, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    label = roots.join(comp, "root").select("fp", "root", "component_id")
    return every.join(label, "fp").select(F.col(f"{TMP}id").alias(id_col), "fp", "text_hash", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             n: int = 4, bits: int = 4, blocks: int | None = None) -> DataFrame:
    """One row of each component stays, the one with the least id (ties: least
    text hash; rows alike in id and text: any one). A component none of whose
    rows has an id keeps its row of least text hash. All columns stay. Ids are
    whole numbers."""
    g = simhash_groups(docs, id_col, text_col, n, bits, blocks)
    pick = g.groupBy("root").agg(F.min(F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))).alias("p"))
    keys = (f"{TMP}k", f"{TMP}d")
    chosen = pick.select(F.xxhash64("p.id", "p.h").alias(keys[0]), F.coalesce("p.id", F.lit(-1)).alias(keys[1])).distinct()
    marked = docs.withColumn(keys[0], F.xxhash64(F.col(id_col), F.xxhash64(text_col))) \
        .withColumn(keys[1], F.coalesce(F.col(id_col), F.lit(-1)))
    return marked.join(chosen, list(keys), "left_semi").dropDuplicates(list(keys)).drop(*keys)
