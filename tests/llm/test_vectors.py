"""Centroid clustering and vector codes against plain integer k-means."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import centroids, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"
CLASH = ("id", "v", "cluster", "distance", "code", "error", "near", "low", "deep", "slot", "n")


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def usable(rows, dims, scale):
    return [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def nearest(x, book):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))


def lloyd(xs, book, rounds):
    for _ in range(rounds):
        at = [nearest(x, book)[1] for x in xs]
        for j in range(len(book)):
            mine = [x for x, a in zip(xs, at) if a == j]
            if mine:
                book[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return book, [nearest(x, book) for x in xs]


def rows_of(n, dims, seed, awkward=True, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)], rng.choice([0, 1, 1, 1, None])) for i in range(n)]
    if awkward:
        same = rows[0][1]
        rows += [(n, same, 3), (n, same, 3), (0, same, 1), (0, [-x for x in same], 1), (None, same, None), (n + 1, None, 1),
                 (n + 2, [], 1), (n + 3, same[:-1], 1), (n + 4, [*same[:-1], None], 1), (n + 5, [*same[:-1], math.nan], 1),
                 (n + 6, [*same[:-1], -math.inf], 1), (n + 7, [0.0] * dims, 2), (n + 8, [-0.0] * dims, 2)]
    return rows


@pytest.mark.parametrize("k, dims, scale, n", [(16, 6, 64, 300), (5, 4, 3, 200), (1, 4, 64, 20), (16, 4, 64, 3)])
def test_clusters_equal_brute_force(spark, k, dims, scale, n):
    rows = rows_of(n, dims, seed=k + n)
    got, books = centroids.cluster(table(spark, rows, clash=True), dims=dims, scale=scale, k=k, rounds=3)
    use = usable(rows, dims, scale)
    order = sorted(use, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    book, at = lloyd([v for _, v, _ in use], [v for _, v, _ in order[:k]], 3)
    assert books == book
    assert sorted(map(str, [(r.vec_id, r.cluster, r.distance) for r in got.collect()])) == \
        sorted(str((i, j, d)) for (i, _, _), (d, j) in zip(use, at))
    full = centroids.with_inertia(got, books).collect()
    assert {r.inertia for r in full} == {sum(d for d, _ in at)}
    for r in full:
        assert r.cluster_inertia == sum(d for d, j in at if j == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, book[r.cluster])).encode()).hexdigest()


def test_tournament_ties_go_to_the_smaller_number():
    book = np.array([[0, 0], [2, 0], [2, 0], [0, 2], [-2, 0]])
    x = np.array([[1, 0], [2, 0], [1, 1], [-1, 0], [0, 1], [5, 5], [1 << 26, -(1 << 26)]])
    pairs = centroids.Bisectors(book)
    assert pairs.winners(x).tolist() == [nearest(v, book.tolist())[1] for v in x.tolist()]


@pytest.mark.parametrize("k, dims, parts, scale, n, spread", [(16, 8, 2, 64, 400, 1.0), (16, 16, 8, 4, 300, 0.1), (4, 8, 4, 4096, 200, 3.0), (16, 8, 2, 64, 5, 1.0), (1, 4, 2, 64, 9, 1.0)])
def test_codes_equal_brute_force(spark, k, dims, parts, scale, n, spread):
    rows, m = rows_of(n, dims, seed=k + n, spread=spread), dims // parts
    got, books = vector_codes.compress(table(spark, rows, clash=True), [F.col("vec_id"), F.col("label")], dims=dims, parts=parts, scale=scale, k=k, rounds=6)
    use = usable(rows, dims, scale)
    first = sorted(use, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:k]
    codes, errors, want_books = [""] * len(use), [0] * len(use), []
    for p in range(parts):
        cutp = slice(p * m, p * m + m)
        book, at = lloyd([v[cutp] for _, v, _ in use], [v[cutp] for _, v, _ in first], 6)
        want_books.append(book)
        codes = [c + f"{j:02x}" for c, (_, j) in zip(codes, at)]
        errors = [e + d for e, (d, _) in zip(errors, at)]
    assert books == want_books
    rows_got = got.collect()
    assert sorted(map(str, [(r.vec_id, r.label, r["__ll_code"], r["__ll_error"]) for r in rows_got])) == \
        sorted(str((i, lab, c, e)) for (i, _, lab), c, e in zip(use, codes, errors))
    back = {r["__ll_code"]: r.v for r in got.select("__ll_code", vector_codes.decode(F.col("__ll_code"), books).alias("v")).collect()}
    for (_, v, _), c, e in zip(use, codes, errors):
        assert sum((a - b) ** 2 for a, b in zip(v, back[c])) == e


def test_bounds_never_exceed_distances():
    """After every step each bound is below the true distance it speaks of."""
    rng = np.random.default_rng(3)
    k, m, b = 16, 3, 4
    x = rng.integers(-50, 50, (400, 1, m))
    books = vector_codes.Books(rng.integers(-50, 50, (1, k, m)))
    near, low = (a.reshape(400, 1, b) for a in books.full(x[:, 0], np.zeros(400, int), b))
    skipped = 0
    for _ in range(6):
        books = vector_codes.Books(books.entries + rng.integers(-4, 5, (1, k, m)), books.entries)
        near, low, deep = books.step(x, near, low)
        skipped += (deep < b).sum()
        for i in range(400):
            d = [math.dist(x[i, 0], e) for e in books.entries[0]]
            assert near[i, 0, 0] == d.index(min(d))
            for z in range(b - 1):
                assert low[i, 0, z] <= d[near[i, 0, z + 1]]
            assert low[i, 0, -1] <= min((v for j, v in enumerate(d) if j not in near[i, 0]), default=math.inf)
            assert (np.diff(low[i, 0]) >= 0).all()
    assert skipped > 0


def test_empty_and_too_large(spark):
    for rows in ([], [(1, None, 1), (2, [math.nan] * 4, 2)]):
        got, books = centroids.cluster(table(spark, rows), dims=4)
        assert got.count() == 0 and books == [] and got.columns == ["vec_id", "cluster", "distance"]
        assert centroids.with_inertia(got, books).count() == 0
        got, books = vector_codes.compress(table(spark, rows), [F.col("vec_id")], dims=4, parts=2)
        assert got.count() == 0 and books == []
    with pytest.raises(Exception, match="vector component"):
        centroids.cluster(table(spark, [(1, [1e300] * 4, 1)]), dims=4)
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, []), [], dims=5, parts=2)
