from __future__ import annotations

import random
import re

import pytest
from helpers import docs, empty

from lakeloom.llm import decontamination


def shingles(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, items):
    out = set()
    short = {len(re.findall(r"[^\W_]+", x or "")) for _, x in items} & {1, 2, 3, 4}
    for d, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        have = shingles(t) | {" ".join(w[i:i + k]) for k in short for i in range(len(w) - k + 1)}
        for i, x in items:
            s = shingles(x)
            if s and len(s & have) >= 0.8 * len(s):
                out.add((d, i, len(s), len(s & have)))
    return out


def fixture(seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefü") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    items = [(i, " ".join(text(k))) for i, k in enumerate([1, 3, 4, 5, 6, 9, 12, 20, 40, 41, 64, 100, 300])]
    items += [(50, None), (51, ""), (52, items[7][1]), (7, items[7][1]), (53, "?? !!")]
    rows = [(1, None), (2, ""), (3, items[2][1]), (4, items[1][1].upper())]
    for k in range(60):
        words = text(rng.choice([5, 50, 400, 3000]))
        i, item = rng.choice(items[3:13])
        w = item.split()
        for _ in range(rng.randint(0, 4)):  # edits: some leave 0.8, some do not
            w[rng.randrange(len(w))] = "edit"
        at = rng.randrange(len(words))
        rows.append((10 + k, ", ".join(words[:at] + w + words[at:])))
    return rows + [rows[8], (None, rows[9][1])], items


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontamination, "fits_broadcast", lambda df: False)
    rows, items = fixture()
    it = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(docs(spark, rows, clash=True), it).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in got} == brute(rows, items)
    assert len(got) == len(brute(rows, items)) > 20


def test_decontaminate_keeps_clean_rows(spark):
    rows, items = fixture()
    it = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, rows, clash=True)
    kept = decontamination.decontaminate(df, it)
    assert kept.columns == df.columns
    bad = {d for d, *_ in brute(rows, items)}
    key = lambda x: -1 if x is None else x
    assert sorted(key(r.doc_id) for r in kept.collect()) == sorted(key(d) for d, _ in rows if d not in bad)


def test_short_items_inside_longer_texts(spark):
    it = spark.createDataFrame([(1, "red green blue"), (2, "red green"), (3, "a b c d e f")], "item_id long, text string")
    rows = [(1, "they saw Red, green; blue and more colours"), (2, "green blue red"), (3, "red green"), (4, "red blue"), (5, "a b c d e f")]
    got = {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in decontamination.leaks(docs(spark, rows), it).collect()}
    assert got == {(1, 1, 1, 1), (1, 2, 1, 1), (3, 2, 1, 1), (5, 3, 2, 2)}


def test_empty(spark):
    it = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(empty(spark), it).count() == 0
    assert decontamination.decontaminate(docs(spark, [(1, "a b c d e")]), it).count() == 1
