"""Hierarchy as tables: entity fan-out (J4), closure (J5), grant fan-out (J6),
effective grants (J7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.names import database_name, entity_path, snake_name, target_name
from lakeloom.operators.lookups import DEFAULT_BROADCAST_ROWS, bounded_broadcast, skew_join
from lakeloom.session import shared_dir


def fan_out_entities(units: DataFrame) -> DataFrame:
    """J4 (+P13–P16): one row per (unit, project, entity).

    ``units`` has ``parent_unit``, ``unit`` and ``projects`` =
    array<struct<name, description, entities array<struct<entity_type,
    source_bucket, schedule_trigger_timing>>>>. Plain ``explode``: a unit with
    no project or a project with no entity gives no row.
    """
    p = units.select("parent_unit", "unit", F.explode("projects").alias("p"))
    e = p.select("parent_unit", "unit", F.col("p.name").alias("project"),
                 F.col("p.description").alias("description"),
                 F.explode("p.entities").alias("e"))
    return e.select(
        "parent_unit", "unit", "project", "description",
        F.col("e.entity_type").alias("entity_type"),
        F.col("e.source_bucket").alias("source_bucket"),
        F.col("e.schedule_trigger_timing").alias("schedule"),
        entity_path("parent_unit", "unit", F.col("e.entity_type")).alias("entity_path"),
        target_name(F.col("e.source_bucket")).alias("target_bucket"),
        database_name(F.col("project")).alias("database"),
        F.concat(F.col("e.entity_type"), F.lit("_")).alias("table_prefix"),
        snake_name(F.col("project")).alias("project_key"),
    )


def ancestor_jumps(links: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> list[DataFrame]:
    """Pointer doubling: the r-th table has (node, up) for every node with an
    ancestor at distance 2^r, so a tree of depth d takes log2(d) rounds.

    ``links`` is (node, up), one step each. A node that is its own ancestor
    keeps a pointer for ever: when 2^r exceeds the links and one is left, the
    call raises. Each round is checkpointed to the shared folder.
    """
    jumps = [links.select("node", "up").distinct().checkpoint()]
    n = jumps[0].count()
    while True:
        last = jumps[-1]
        if last.isEmpty():
            return jumps[:-1]
        if 1 << (len(jumps) - 1) > n:
            raise ValueError(f"node {last.first()['node']!r} has no end of ancestors: the tree has a cycle")
        ahead = last.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        jumps.append(skew_join(last, ahead, [("up", "_node")], salt_by=["node"], max_rows=max_broadcast_rows)
                     .select("node", F.col("_up").alias("up")).distinct().checkpoint())


def hierarchy_depths(spark: SparkSession, edges: DataFrame,
                     max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """J5 in linear size: (node, root, depth) of every node. Only the internal
    nodes walk up, by pointer doubling: after r rounds a node points 2^r steps
    up, or to its root, so a tree of depth d takes log2(d) joins of a row per
    internal node. Leaves take their parent's root and one step more. For trees:
    of a node with several parents any way up is taken. A cycle raises."""
    shared_dir(spark)  # make sure a checkpoint folder is set
    _, internal, ilinks = _links(edges)
    up = ilinks.groupBy(F.col("_child").alias("_node")).agg(F.min("_up").alias("_up"))
    top = F.col("_up").isNull()  # a root points to itself, no step away
    at = internal.join(up, F.col("_inode") == F.col("_node"), "left").select(
        F.col("_inode").alias("node"), F.coalesce("_up", "_inode").alias("root"),
        F.when(top, 0).otherwise(1).alias("depth"), top.alias("_end")).checkpoint()
    n, r = at.count(), 0
    while not (walk := at.where("NOT _end")).isEmpty():
        if 1 << r > 2 * n:
            raise ValueError(f"node {walk.first()['node']!r} has no end of ancestors: the tree has a cycle")
        ahead = at.select(F.col("node").alias("_node"), F.col("root").alias("_up"), F.col("depth").alias("_more"), F.col("_end").alias("_top"))
        walk = skew_join(walk, ahead, [("root", "_node")], salt_by=["node"], max_rows=max_broadcast_rows).select(
            "node", F.col("_up").alias("root"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_top").alias("_end"))
        at, r = walk.unionByName(at.where("_end")).checkpoint(), r + 1
    at = at.drop("_end")
    own = edges.select(F.col("node").cast("string").alias("node"), F.col("parent").cast("string").alias("_up"))
    own = own.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("_up").alias("_up"))
    leaves = own.join(at.select("node"), "node", "left_anti").checkpoint()
    heads = at.select(F.col("node").alias("_head"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
    leaves = skew_join(leaves, heads, [("_up", "_head")], "left", salt_by=["node"], max_rows=max_broadcast_rows)
    return at.unionByName(leaves.select("node", F.coalesce("_root", "node").alias("root"),
                                        F.coalesce(F.col("_depth") + 1, F.lit(0)).alias("depth")))


def _links(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(child, up) of all edges, the internal nodes, and the links among them."""
    e = edges.select(F.col("node").cast("string").alias("_child"), F.col("parent").cast("string").alias("_up"))
    links = e.where(F.col("_up").isNotNull() & F.col("_child").isNotNull())
    internal = links.select(F.col("_up").alias("_inode")).distinct().checkpoint()
    ilinks = links.join(internal, F.col("_child") == F.col("_inode"), "left_semi").checkpoint()
    return links, internal, ilinks


def hierarchy_closure(spark: SparkSession, edges: DataFrame,
                      max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(node, ancestor, depth) for every node and each of its ancestors.

    ``edges`` is (node, parent); roots have a null parent or no row. Depth 0 is
    the node itself.

    Only internal nodes (those that are someone's parent) take part in the walk
    up. It doubles: the ancestors at distance 2^r and more, below 2^(r+1), are
    those of the ancestor at distance 2^r, so a tree of depth d takes log2(d)
    joins, each checkpointed to the shared folder (a lost executor does not
    replay earlier rounds). Leaves, usually the bulk of a tree, are then
    attached with a single join: a node's ancestors at distance d >= 1 are its
    parent's ancestors at distance d - 1. The joins go through ``skew_join``,
    because one ancestor may be that of a large share of all nodes. A node that
    is its own ancestor (a cycle) raises, before any closure is built.
    """
    shared_dir(spark)  # make sure a checkpoint folder is set
    links, internal, ilinks = _links(edges)
    jumps = ancestor_jumps(ilinks.select(F.col("_child").alias("node"), F.col("_up").alias("up")), max_broadcast_rows)
    inner = internal.select(F.col("_inode").alias("_anode"), F.col("_inode").alias("_anc"), F.lit(0).alias("_d"))
    for r, jump in enumerate(jumps):
        far = skew_join(jump, inner, [("up", "_anode")], salt_by=["node"], max_rows=max_broadcast_rows)
        far = far.select(F.col("node").alias("_anode"), "_anc", (F.col("_d") + (1 << r)).alias("_d"))
        inner = inner.unionByName(far).checkpoint()
    # Every node with its parent's closure.
    up = skew_join(links, inner, [("_up", "_anode")], salt_by=["_child"],
                   max_rows=max_broadcast_rows)
    above = up.select(F.col("_child").alias("node"), F.col("_anc").alias("ancestor"),
                      (F.col("_d") + 1).alias("depth"))
    named = edges.select(F.col("node").cast("string").alias("node"))
    nodes = named.union(internal.select(F.col("_inode").alias("node")))
    self_rows = nodes.distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    return self_rows.unionByName(above)


def fan_out_grants(units: DataFrame, unit_col: str, creator: str, users: list[str]) -> DataFrame:
    """Per unit, a CREATE_PROJECT grant for the creator (children included)
    and an ADD_TO_PROJECT_MEMBER_POOL grant for the creator and every user.

    The role list is configuration (bounded, held in the plan as a literal
    array), so each unit row expands in place; no join, no shuffle.
    """
    roles = [creator] + [u for u in users if u != creator]
    grants = F.array(
        F.struct(F.lit(creator).alias("principal"), F.lit("CREATE_PROJECT").alias("policy_type"),
                 F.lit(True).alias("include_child")),
        *[F.struct(F.lit(r).alias("principal"), F.lit("ADD_TO_PROJECT_MEMBER_POOL").alias("policy_type"),
                   F.lit(False).alias("include_child")) for r in roles])
    return (units.select(F.col(unit_col).alias("unit_id"), F.explode(grants).alias("g"))
            .select("unit_id", "g.principal", "g.policy_type", "g.include_child"))


def child_flag(c) -> Column:
    """Include-children flag from text: true/false/1/0/yes/no; else false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def effective_policies(grants: DataFrame, closure: DataFrame, by: list[str],
                       max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """J7 for all nodes: how many grants of each kind (``by``) act on a node.

    Grants are counted per entity and kind first, so the join has one row per
    closure row and kind, however many grants an entity has, and the result
    one row per node and kind: ``n_grants``, of which ``n_direct`` on the node
    itself. ``effective_grants`` lists the grants behind a node's counts.
    """
    per = grants.groupBy("entity", *by).agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col("include_child").cast("long")).alias("_down"))
    c = closure.select(F.col("node"), F.col("ancestor").alias("_anc"), F.col("depth"))
    j = skew_join(c, per, [("_anc", "entity")], salt_by=["node"], max_rows=max_broadcast_rows)
    direct = F.when(F.col("depth") == 0, F.col("_all"))
    return (j.groupBy("node", *by).agg(F.sum(F.coalesce(direct, F.col("_down"))).alias("n_grants"),
                                       F.sum(F.coalesce(direct, F.lit(0))).alias("n_direct"))
            .where(F.col("n_grants") > 0))


def effective_grants(grants: DataFrame, closure: DataFrame,
                     max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """A grant on ``entity`` covers the entity itself and, when
    ``include_child`` is true, every descendant.

    ``grants`` has entity, include_child (+ any other columns); ``closure`` is
    J5's output. Result: the grant columns plus ``node`` and ``depth``. The
    closure's ancestor column is highly skewed (every leaf lists the roots),
    so the join goes through ``skew_join``. Give the closure of the nodes asked
    about: over all nodes the list has a row per grant and descendant, which
    ``effective_policies`` counts instead.
    """
    c = closure.select(F.col("node"), F.col("ancestor").alias("_anc"), F.col("depth"))
    return (skew_join(c, grants, [("_anc", "entity")], salt_by=["node"], max_rows=max_broadcast_rows)
            .where(F.col("include_child") | (F.col("depth") == 0))
            .drop("_anc"))
