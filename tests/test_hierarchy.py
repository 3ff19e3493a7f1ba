"""Pointer doubling and nested intervals against plain recursion."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import hierarchy as h
from lakeloom.operators import intervals as iv

E = "node string, parent string"


def forest(n, seed, hot=False):
    rng = random.Random(seed)
    names = [f"n{i}" for i in rng.sample(range(10 * n), n)]
    up = {names[0]: None}
    for i, x in enumerate(names[1:], 1):
        up[x] = None if rng.random() < 0.05 else names[0 if hot and rng.random() < 0.7 else rng.randint(max(0, i - 6), i - 1)]
    rows = [(x, p) for x, p in up.items()]
    rng.shuffle(rows)
    return rows


def tour(rows):
    """lo and hi of every node by recursion."""
    up = dict(rows)
    for _, p in rows:
        up.setdefault(p, None) if p is not None else None
    kids: dict = {}
    for x, p in up.items():
        kids.setdefault(p, []).append(x)
    out, n, stack = {}, 0, [(x, False) for x in sorted(kids.get(None, []), key=lambda x: (x in kids, x))[::-1]]
    while stack:
        x, leaving = stack.pop()
        if leaving:
            out[x] = (out[x], n)
            continue
        out[x], n = n, n + 1
        stack.append((x, True))
        stack += [(c, False) for c in sorted(kids.get(x, []), key=lambda c: (c in kids, c))[::-1]]
    return out, up


@pytest.mark.parametrize("n, hot, bound", [(1, False, 200_000), (60, False, 200_000), (300, True, 200_000), (60, True, 0)])
def test_intervals_equal_recursion(spark, n, hot, bound):
    rows = forest(n, n, hot)
    if n > 1:
        rows = [r for r in rows if r[1] is not None or r[0] != rows[0][0]] + [rows[1], ("x", "no row of its own"), (None, "x"), ("alone", None)]
    got = {r.node: (r.lo, r.hi) for r in iv.tree_intervals(spark.createDataFrame(rows, E), bound).collect()}
    want, up = tour([r for r in rows if r[0] is not None] + ([("x", "no row of its own")] if n > 1 else []))
    if n > 1:  # the row without a node still names a parent
        want2, _ = tour([r for r in rows if r[0] is not None])
        want = want2
    assert got == want


def test_bad_trees_raise(spark):
    for rows, what in (([("a", "b"), ("b", "a")], "own ancestor"), ([("a", None), ("x", "a"), ("b", "c"), ("c", "d"), ("d", "b")], "own ancestor"),
                       ([("a", "b"), ("a", "c")], "two parents"), ([("a", "a")], "own ancestor")):
        with pytest.raises(ValueError, match=what):
            iv.tree_intervals(spark.createDataFrame(rows, E))
    assert iv.tree_intervals(spark.createDataFrame([], E)).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        h.hierarchy_depths(spark, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None), ("d", "c")], E))


@pytest.mark.parametrize("bound", [200_000, 0])
def test_grants_on_nodes_equal_the_closure(spark, bound):
    rows, rng = forest(80, 7, True), random.Random(2)
    names = [x for x, _ in rows]
    grants = [(i, rng.choice([*names, names[0], "unknown"]), rng.random() < 0.5) for i in range(300)]
    g = spark.createDataFrame(grants, "grant int, entity string, include_child boolean")
    edges = spark.createDataFrame(rows, E)
    numbers = iv.tree_intervals(edges).checkpoint()
    listed = iv.grant_intervals(g, numbers, bound)
    assert listed.count() == sum(e != "unknown" for _, e, _ in grants)
    asked = spark.createDataFrame([(x,) for x in [*names[:30], names[0], "unknown"]], "node string")
    got = iv.grants_on(asked, listed, numbers, bound)
    assert set(got.columns) == {"node", "grant", "entity", "include_child"}
    closure = h.hierarchy_closure(spark, edges).where(F.col("node").isin(names[:30]))
    want = h.effective_grants(g, closure).select("node", "grant")
    assert sorted((r.node, r.grant) for r in got.collect()) == sorted(map(tuple, want.collect()))


def test_cells_cover_exactly(spark):
    rng = random.Random(0)
    rows = [(a, a + rng.randint(0, 70)) for a in (rng.randint(0, 60) for _ in range(200))]
    got = spark.createDataFrame(rows, "lo long, hi long").select("lo", "hi", iv._cells(F.col("lo"), F.col("hi"), 8).alias("c")).collect()
    for r in got:
        covered = [x for c in r.c for x in range(c.cell << c.level, (c.cell + 1) << c.level)]
        assert sorted(covered) == list(range(r.lo, r.hi)) and len(r.c) <= 16


def test_deep_chain_in_few_rounds(spark):
    n = 5000
    edges = spark.range(n).select(F.concat(F.lit("n"), F.col("id")).alias("node"),
                                  F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent"))
    links = edges.where("parent is not null").select("node", F.col("parent").alias("up"))
    assert len(h.ancestor_jumps(links)) <= 15
    got = {r.node: (r.root, r.depth) for r in h.hierarchy_depths(spark, edges).collect()}
    assert got == {f"n{i}": ("n0", i) for i in range(n)}


def test_depths_and_closure_equal_recursion(spark):
    rows = forest(150, 11)
    up = dict(rows)

    def way(x):
        out = [x]
        while up.get(out[-1]) is not None:
            out.append(up[out[-1]])
        return out

    edges = spark.createDataFrame([*rows, ("leaf", rows[3][0])], E)
    up["leaf"] = rows[3][0]
    got = {r.node: (r.root, r.depth) for r in h.hierarchy_depths(spark, edges).collect()}
    assert got == {x: (way(x)[-1], len(way(x)) - 1) for x in up}
    closure = sorted(map(tuple, h.hierarchy_closure(spark, edges).collect()))
    assert closure == sorted((x, a, d) for x in up for d, a in enumerate(way(x)))


def test_depths_take_one_join_a_round(spark, monkeypatch):
    """A chain of 300: root and depth of every node, by one join a doubling and
    one for the leaves."""
    calls = []
    real = h.skew_join
    monkeypatch.setattr(h, "skew_join", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(300)] + [("leaf", "c299"), ("alone", None), ("late", "gone"), (None, "c1")]
    got = {r.node: (r.root, r.depth) for r in h.hierarchy_depths(spark, spark.createDataFrame(rows + rows[:5], E)).collect()}
    want = {f"c{i}": ("c0", i) for i in range(300)} | {"leaf": ("c0", 300), "alone": ("alone", 0), "late": ("gone", 1), "gone": ("gone", 0)}
    assert got == want and len(calls) <= 12
    with pytest.raises(ValueError, match="cycle"):
        h.hierarchy_depths(spark, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], E)).collect()
