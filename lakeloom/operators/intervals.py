"""The unit tree as nested intervals, and what they answer.

A tour of the tree gives every node a number and the half-open interval of the
numbers in its subtree, so "is below" is a comparison and a grant that covers a
subtree is one row, however many nodes it covers.

The tour is numbered in parallel. Every internal node has an arc that enters it
and one that leaves it; what follows an arc is known from the node's first
internal child, next internal sibling or parent. Pointer doubling over these
arcs sums the nodes entered after each in log2(arcs) rounds, whatever the depth.
Leaves take no part in it: they are numbered right after their parent.

Neither numbering siblings nor any other step keeps a node's children in one
task: siblings are ordered by one range-partitioned sort of all nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lookups import DEFAULT_BROADCAST_ROWS, skew_join
from lakeloom.session import shared_dir


def in_order(df: DataFrame, cols: list[Column], name: str = "pos") -> DataFrame:
    """``df`` with each row's 0-based position in the order of ``cols``: a range
    partitioned sort, and one offset per partition (the only rows on the
    driver)."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")).checkpoint()
    offsets, total = [], 0
    for p, k in sorted((r["_p"], r["count"]) for r in rows.groupBy("_p").count().collect()):
        offsets.append((p, total))
        total += k
    off = spark.createDataFrame(offsets, "_p int, _o long")
    return rows.join(F.broadcast(off), "_p").withColumn(name, F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def tree_of(edges: DataFrame) -> DataFrame:
    """(node, parent, internal), one row per node; a parent that has no row of
    its own is a root. Rows without a node are left out, repeated rows count
    once; a node with two parents raises."""
    shared_dir(edges.sparkSession)  # make sure a checkpoint folder is set
    e = edges.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("parent")) \
        .where(F.col("node").isNotNull())
    up = e.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    # A parent's own rows combine before the shuffle, so a parent of very many
    # nodes is one row per task.
    both = e.withColumn("kids", F.lit(0)).unionByName(up.withColumn("kids", F.lit(1)))
    t = both.groupBy("node").agg(F.min("parent").alias("parent"), F.max("parent").alias("_other"), (F.max("kids") == 1).alias("internal")).checkpoint()
    two = t.where(F.col("parent") != F.col("_other")).select("node").first()
    if two is not None:
        raise ValueError(f"node {two['node']!r} has two parents")
    return t.drop("_other")


def _sums(arcs: DataFrame) -> DataFrame:
    """(a, s) for arcs (a, nxt, w): the weights from an arc to the list's end.
    After round r an arc points 2^r arcs ahead; one that still points somewhere
    when that exceeds the list is on a cycle."""
    cur = arcs.select("a", "nxt", F.col("w").alias("s")).checkpoint()
    for _ in range(math.ceil(math.log2(max(2, cur.count()))) + 1):
        if cur.where(F.col("nxt").isNotNull()).isEmpty():
            return cur.select("a", "s")
        ahead = cur.select(F.col("a").alias("_a"), F.col("nxt").alias("_nxt"), F.col("s").alias("_s"))
        cur = cur.join(ahead, F.col("nxt") == F.col("_a"), "left").select(
            "a", F.col("_nxt").alias("nxt"), (F.col("s") + F.coalesce("_s", F.lit(0))).alias("s")).checkpoint()
    if cur.where(F.col("nxt").isNotNull()).isEmpty():
        return cur.select("a", "s")
    raise ValueError("the tree has a node that is its own ancestor")


def tree_intervals(edges: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(node, parent, lo, hi) for ``edges`` (node, parent): ``lo`` numbers the
    nodes from 0 in the order of a tour that takes a node before its children,
    leaves before internal children, else by name; the subtree of a node has
    the numbers from ``lo`` to below ``hi``. A cycle raises."""
    t = in_order(tree_of(edges), [F.col("parent").asc_nulls_first(), F.col("internal").asc(), F.col("node").asc()]).checkpoint()
    root = F.lit("r").alias("_of")  # the group of the roots; other groups are "n" and the parent's name
    group = F.when(F.col("parent").isNull(), root).otherwise(F.concat(F.lit("n"), F.col("parent")))
    kids = t.groupBy(group.alias("_of")).agg(
        F.min("pos").alias("_first"), F.sum((~F.col("internal")).cast("long")).alias("_leaves"),
        F.min(F.when(F.col("internal"), F.col("pos"))).alias("_child")).checkpoint()
    inner = t.where("internal").select("node", "parent", "pos")
    inner = inner.join(kids.withColumnRenamed("_of", "_k"), F.concat(F.lit("n"), F.col("node")) == F.col("_k")).drop("_k", "_first")
    after = inner.select((F.col("pos") - 1).alias("_before"), F.col("parent").alias("_same"), F.col("pos").alias("_next"))
    above = inner.select(F.col("node").alias("_up"), F.col("pos").alias("_above"))
    j = inner.join(after, (F.col("pos") == F.col("_before")) & F.col("parent").eqNullSafe(F.col("_same")), "left")
    j = skew_join(j, above, [("parent", "_up")], "left", salt_by=["node"], max_rows=max_broadcast_rows).checkpoint()
    enter, leave = F.col("pos") * 2, F.col("pos") * 2 + 1
    arcs = j.select(enter.alias("a"), F.coalesce(F.col("_child") * 2, leave).alias("nxt"), (F.col("_leaves") + 1).alias("w")).unionByName(
        j.select(leave.alias("a"), F.coalesce(F.col("_next") * 2, F.col("_above") * 2 + 1).alias("nxt"), F.lit(0).cast("long").alias("w")))
    sums = _sums(arcs)
    total = j.agg(F.coalesce(F.sum(F.col("_leaves") + 1), F.lit(0))).first()[0]
    alone = (kids.where(F.col("_of") == "r").select("_leaves").first() or [0])[0]  # roots without children come first
    at = F.lit(alone + total) - F.col("s")
    ends = sums.select(F.expr("a div 2").alias("pos"), (F.col("a") % 2).alias("side"), at.alias("n")) \
        .groupBy("pos").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("hi"))
    inner = j.select("node", "parent", "pos").join(ends, "pos").select("node", "parent", "lo", "hi").checkpoint()
    leaves = skew_join(t.where(~F.col("internal")).withColumn("_g", group), kids.select("_of", "_first"), [("_g", "_of")],
                       salt_by=["node"], max_rows=max_broadcast_rows)
    heads = inner.select(F.col("node").alias("_up"), F.col("lo").alias("_lo"))
    leaves = skew_join(leaves, heads, [("parent", "_up")], "left", salt_by=["node"], max_rows=max_broadcast_rows)
    lo = F.coalesce("_lo", F.lit(-1)) + 1 + F.col("pos") - F.col("_first")
    return inner.unionByName(leaves.select("node", "parent", lo.alias("lo"), (lo + 1).alias("hi")))


def grant_intervals(grants: DataFrame, intervals: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """J7 in linear size: every grant (entity, include_child, ...) with the
    numbers ``lo`` to below ``hi`` of the nodes it acts on: its entity's
    subtree, or its entity alone. Grants on an unknown entity are left out."""
    iv = intervals.select(F.col("node").alias("_n"), "lo", F.col("hi").alias("_hi"))
    j = skew_join(grants, iv, [("entity", "_n")], max_rows=max_broadcast_rows)
    return j.withColumn("hi", F.when(F.col("include_child"), F.col("_hi")).otherwise(F.col("lo") + 1)).drop("_n", "_hi")


def _cells(lo: Column, hi: Column, bits: int) -> Column:
    """The fewest aligned ranges of 2^k numbers that make up [lo, hi), as
    (level k, number). At level k what is left goes from lo / 2^k, rounded up,
    to hi / 2^k, rounded down; an odd end is a cell of this level."""
    def at(k: int) -> Column:
        a, b = F.shiftright(lo + F.lit((1 << k) - 1), k), F.shiftright(hi, k)
        level = F.lit(k).alias("level")
        return F.array(F.when((a < b) & (a % 2 == 1), F.struct(level, a.alias("cell"))),
                       F.when((a < b) & (b % 2 == 1), F.struct(level, (b - 1).alias("cell"))))

    return F.filter(F.flatten(F.array(*[at(k) for k in range(bits + 1)])), lambda x: x.isNotNull())


def grants_on(nodes: DataFrame, grants: DataFrame, intervals: DataFrame,
              max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The grants that act on the given ``nodes`` (node): ``grant_intervals``'
    columns less lo and hi, and ``node``.

    Intervals become aligned cells, at most two per level of 2^k numbers, and a
    node's number lies in one cell per level, so the containment is an equality
    join with one row per answer.
    """
    top = intervals.agg(F.max("hi")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(top + 1)))
    g = grants.select("*", F.explode(_cells(F.col("lo"), F.col("hi"), bits)).alias("_c"))
    g = g.select(*[f"`{c}`" for c in grants.columns if c not in ("lo", "hi")], F.col("_c.level").alias("_gl"), F.col("_c.cell").alias("_gc"))
    known = intervals.select(F.col("node").alias("_n"), F.col("lo").alias("_lo"))
    p = nodes.select("node").distinct().join(known, F.col("node") == F.col("_n"))
    p = p.select("node", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("_lo", k).alias("cell")) for k in range(bits + 1)])).alias("_q"))
    p = p.select("node", F.col("_q.level").alias("_ql"), F.col("_q.cell").alias("_qc"))
    salt = [c for c, kind in g.dtypes if "map<" not in kind]
    return skew_join(g, p, [("_gl", "_ql"), ("_gc", "_qc")], salt_by=salt, max_rows=max_broadcast_rows).drop("_gl", "_gc", "_ql", "_qc")
