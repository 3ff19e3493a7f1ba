"""Quality rules: counts and verdicts against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import docs, empty
from pyspark.sql import functions as F

from lakeloom.llm import rules


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(win)
    cover = {i + d for i, x in enumerate(win) if often[x] > 1 for d in range(5)}
    letters = [x for x in w if not any(c.isalpha() for c in x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_letterless": len(letters)}


def tail(n, x, p):
    return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(x + 1))


def brute(rows, labels, risk, level):
    marks = defaultdict(int)
    for i, q in labels:
        if i is not None and q in (0, 1):
            marks[i] = max(marks[i], q)
    stats = [(i, lang or "", hashlib.md5((t or "").encode()).hexdigest(), counts(t)) for i, t, lang in rows]
    base = [c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"] for *_, c in stats]
    at = {r: (lambda c, up=up, low=low, cuts=cuts: sum(x < c[up] / max(c[low], 1) for x in cuts)) for r, (up, low, cuts) in rules.RULES.items()}
    known = {}
    for (i, s, h, c), bad in zip(stats, base):
        if not bad and i in marks:
            known[s, h] = (max(marks[i], known.get((s, h), (0,))[0]), c)
    scored = []
    for k, r in enumerate(rules.RULES):
        for n in range(len(rules.RULES[r][2])):
            hit = [g for (s, h), (g, c) in known.items() if h < "8" and at[r](c) > n]
            if hit.count(0):
                scored.append((-hit.count(0) / (hit.count(1) + 1), k, r, n))
    pairs = [(r, n) for _, _, r, n in sorted(scored)]
    step = lambda c: next((t for t, (r, n) in enumerate(pairs, 1) if at[r](c) > n), len(pairs) + 1)
    first = [(step(c), g) for (s, h), (g, c) in known.items() if h < "8"]
    gain = [sum(1 - 2 * g for t, g in first if t <= n) for n in range(len(pairs) + 1)]
    pairs = pairs[:gain.index(max(gain))]
    hold = defaultdict(list)
    for (s, h), (g, c) in known.items():
        if g and not h < "8":
            hold[s].append(step(c))
    last = {}
    for s, steps in hold.items():
        last[s] = 0
        for t in range(len(pairs) + 1):
            if tail(len(steps), sum(x <= t for x in steps), risk) > level / len(hold):
                break
            last[s] = t
    return [(i, s, *c.values(), bad, not bad and step(c) > last.get(s, 0)) for (i, s, _, c), bad in zip(stats, base)], last, hold


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang, good = rng.choice(["en", "en", "en", "de", None]), rng.random() < 0.8
        w = [rng.choice("of and the lake river stone walked under bright morning while people".split()) + rng.choice(["", "s", "ing", ","]) for _ in range(rng.randint(8, 60))]
        if not good or rng.random() < 0.02:
            w = [x + rng.choice(["###", "$$", " |", "%"]) for x in w]
        rows.append((i, " ".join(w) + rng.choice(["", "\n" + " ".join(w[:3]), "\n\n" + w[0] + "\n" + w[0]]), lang))
        if rng.random() < 0.7:
            labels.append((i, int(good)))
    return rows, labels


def test_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n\x0b\f\r", "a", "a b c d e", "a a a a a a", "a b c d e a b c d e", "a b c d e f a b c d e", "x\ny\nx\n \n \nx \nx",
             "#*$%&|<>   1 ½ é 中文 😀 ab cd", "w " * 5000, " ".join(map(str, range(3000))) * 2, "a\r\na\r\na", "\x00 \x1f \x85 z"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(4, 200))) for _ in range(80)]
    texts += [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 400))) + "\n" * rng.randint(0, 2) for _ in range(80)]
    got = rules.text_counts(docs(spark, list(enumerate(texts)), clash=True), "text", [F.col("doc_id")]).collect()
    assert {r.doc_id: tuple(r[c] for c in rules.COUNTS) for r in got} == {i: tuple(counts(t)[c] for c in rules.COUNTS) for i, t in enumerate(texts)}
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


@pytest.mark.parametrize("n, risk, level", [(900, 0.1, 0.1), (400, 0.2, 0.3), (60, 0.05, 0.05)])
def test_verdicts_equal_brute_force(spark, n, risk, level):
    rows, labels = corpus(n, n)
    rows += [(5, rows[5][1], "en"), (5, rows[7][1], "en"), (None, rows[3][1], "en"), (n + 1, None, "en"), (n + 2, "", None), *[(n + 9 + i, rows[9][1], "de") for i in range(40)]]
    labels += [(5, 0), (5, 1), (6, None), (7, 3), (None, 1), (n + 999, 1), *[(n + 9 + i, 1) for i in range(40)]]
    df = docs(spark, [(i, t, lang) for i, t, lang in rows], clash=True)
    got, limits = rules.verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int"), risk=risk, level=level)
    want, last, hold = brute(rows, labels, risk, level)
    assert sorted(str((r.doc_id, r.stratum, *(r[c] for c in rules.COUNTS), r.base_failed, r.kept)) for r in got.collect()) == sorted(map(str, want))
    assert {r.stratum: (r.last_step, r.n_good) for r in limits.collect()} == {s: (last[s], len(hold[s])) for s in hold}
    assert all((r.rule is None) == r.kept and (r.rule == "base") == r.base_failed for r in got.collect())
    if n == 900:
        assert max(last.values()) > 0 and any(not r.kept and not r.base_failed for r in got.collect())


def test_binomial_tail_is_exact(spark):
    cases = [(n, x, p) for p in (0.01, 0.05, 0.3) for n in (1, 2, 10, 85, 600, 1000) for x in (0, 1, 2, 5, 20, 100) if x < n * p]
    for p in (0.01, 0.05, 0.3):
        rows = [(n, x) for n, x, q in cases if q == p]
        for r in spark.createDataFrame(rows, "n long, x long").select("n", "x", rules.binomial_tail(F.col("n"), F.col("x"), p).alias("p")).collect():
            assert r.p == pytest.approx(tail(r.n, r.x, p), rel=1e-8)
    big = spark.range(1).select(rules.binomial_tail(F.lit(10 ** 7), F.lit(498_000), 0.05).alias("p")).first().p
    assert big == pytest.approx(0.0018623, rel=0.02)  # normal approximation: z = -2.90


def test_risk_is_held(spark):
    """Over many draws, the share of true good texts rejected by the chosen
    step is above the risk in no more than the level."""
    rng, over, runs, risk, level = random.Random(1), 0, 120, 0.1, 0.2
    rows = [(f"s{s}", min(11, 1 + int(rng.random() * 40 // 1))) for s in range(runs) for _ in range(150)]
    ends = rules.cutoffs(spark.createDataFrame(rows, "stratum string, step int"), 10, risk, level * runs).collect()
    for r in ends:  # a step t rejects t in 40 good texts
        over += r.last_step / 40 > risk
    assert over <= runs * (level + 0.1) and max(r.last_step for r in ends) >= 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got, limits = rules.verdicts(empty(spark), none)
    assert got.count() == 0 and limits.count() == 0
    got, limits = rules.verdicts(docs(spark, [(1, "one two three four five six seven eight nine ten ###"), (2, None)]), none)
    assert {r.doc_id: r.kept for r in got.collect()} == {1: True, 2: False}
