"""Connected components of a link table, by alternating star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the
large-star step hangs every larger neighbour of a node on its smallest
neighbour, the small-star step does the same with the smaller ones. Both are a
grouped minimum and a join on the node. Node minima combine before the shuffle,
so a hub costs one row per task there; a hub's rows in the join are split by
the skew-join rule of adaptive execution. Links never reach the driver: only
one row with two checksums does, per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) rows, u > v. Returns (u, v) rows, u > v."""
    if large:
        nb = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        nb = links
    low = nb.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = nb.join(low, "u")
    if large:
        new = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = out.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v")))
    return new.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links`` (a, b) of one comparable type -> (node, root), root the least
    node of the component. Nodes without a link to another node are absent.

    An empty table gives an empty table. Self links and repeats are harmless.
    """
    cur = cut(links.filter(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        cur = cut(_star(_star(cur, True), False))
        got = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(got) == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = tuple(got)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
