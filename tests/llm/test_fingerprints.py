from __future__ import annotations

import hashlib
import random
import re

from helpers import docs, empty
from pyspark.sql import functions as F

from lakeloom.llm import fingerprints


def shingles(t, n=5):
    w = re.findall(r"[^ \t\n\x0b\f\r]+", (t or "").lower())
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def corpus(seed=6):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé😀") for _ in range(rng.randint(1, 6))) for _ in range(50)]
    rows = [(i * 3 - 20, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 4, 5, 8, 40])))) for i in range(70)]
    return rows + [(-100, None), (10 ** 6, ""), (10 ** 6 + 1, rows[5][1])]


def test_exact_below_k_and_order_of_documents(spark):
    rows = corpus()
    got = {r.doc_id: r for r in fingerprints.against_next(docs(spark, rows, clash=True)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[:len(t) - k] + nxt[:k]
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fp) == len(shingles(t)) and r.fp == sorted(r.fp)
        assert abs(r.near_edited - likeness(shingles(t), shingles(edited))) < 1e-9
        assert abs(r.near_next - likeness(shingles(t), shingles(nxt))) < 1e-9


def test_ties_nulls_and_one_row(spark):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "z"), (None, "q r s"), (None, None)]
    assert fingerprints.against_next(docs(spark, rows)).count() == 5
    one = fingerprints.against_next(docs(spark, [(1, "a b c")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b a").hexdigest()
    assert fingerprints.against_next(empty(spark)).count() == 0


def test_estimates_and_merging(spark):
    rng = random.Random(0)
    a = [rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(6000)]
    b = a[:3000] + [rng.getrandbits(63) * rng.choice([1, -1]) for _ in range(1000)]
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(
        fingerprints.bottom(F.col("a"), 512).alias("a"), fingerprints.bottom(F.col("b"), 512).alias("b"))
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("j"), fingerprints.distinct_count(F.col("a"), 512).alias("n"),
                  fingerprints.containment(F.col("b"), F.col("a"), 512).alias("c")).first()
    assert abs(r.j - 3000 / 7000) < 0.08 and abs(r.n / 6000 - 1) < 0.2 and abs(r.c - 0.75) < 0.2
    parts = spark.createDataFrame([("x", sorted(a[i::7])[:64]) for i in range(7)] + [(None, [])], "key string, s array<long>")
    got = {r.key: r.s for r in fingerprints.merge_parts(parts, ["key"], "s", 64).collect()}
    assert got == {"x": sorted(a)[:64], None: []}
