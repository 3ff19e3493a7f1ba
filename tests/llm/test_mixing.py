from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import pytest
from helpers import docs, empty

from lakeloom.llm import mixing


def unit(seed, block, i):
    return int(hashlib.md5(f"{seed}:{block}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2 ** 52


def brute(rows, budget=None, max_repeats=None, min_entropy=None, seed=0):
    k = lambda t: len((t or "").split())
    n = defaultdict(int)
    for _, t, _, s in rows:
        n[s] += k(t)
    n = {s: v for s, v in n.items() if v}
    total = sum(n.values())
    budget = total if budget is None else budget
    for step in range(1025) if max_repeats is not None else range(1024, -1, -1):
        raw = {s: (v / total) ** (step / 1024) for s, v in n.items()}
        q = {s: r / sum(raw.values()) for s, r in raw.items()}
        if max_repeats is not None and max(q[s] * budget / n[s] for s in n) <= max_repeats + 1e-9:
            break
        if min_entropy is not None and -sum(x * math.log(x) for x in q.values()) >= min_entropy - 1e-9:
            break
    out = []
    for s in n:
        full, left = divmod(math.floor(q[s] * budget + 1e-6), n[s])
        mine = [(i, k(t)) for i, t, _, x in rows if x == s]
        out += [(i, s, b) for i, _ in mine for b in range(full)]
        by = defaultdict(int)
        for i, c in mine:
            by[unit(seed, full, i)] += c
        run = 0
        for u in sorted(by):
            run += by[u]
            if run > left or not left:
                break
            out += [(i, s, full) for i, _ in mine if unit(seed, full, i) == u]
    return sorted(map(str, out))


def corpus(seed=0):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 30), None, rng.choices(["a", "b", "c", None], [30, 5, 2, 1])[0]) for i in range(300)]
    return rows + [(900, None, None, "a"), (901, "", None, "void"), (5, "x y z", None, "b"), (5, "x y z", None, "b"), (None, "one two", None, "c")]


@pytest.mark.parametrize("arg", [{"max_repeats": 1.25}, {"max_repeats": 3.0}, {"min_entropy": 1.0}, {"max_repeats": 2.5, "budget": 9000},
                                 {"max_repeats": 4.0, "budget": 500}, {"min_entropy": 9.0}])
def test_brute_force(spark, arg):
    rows = corpus()
    df = docs(spark, rows, clash=True)
    got = mixing.mix(df, **arg)
    assert got.columns[:len(df.columns)] == df.columns
    got = got.collect()
    assert sorted(str((r.doc_id, r.source, r["__ll_block"])) for r in got) == brute(rows, **arg)
    assert all(0 <= r["__ll_position"] <= 1.01 + 1 / max(1, r["__ll_tokens"]) or r["__ll_block"] == 0 for r in got)


def test_edge_tables(spark):
    assert mixing.mix(empty(spark), max_repeats=2.0).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None, "a"), (2, "", None, "b")]), max_repeats=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(empty(spark))
