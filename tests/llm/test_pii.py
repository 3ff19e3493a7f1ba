from __future__ import annotations

import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from helpers import docs, empty

from lakeloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    out = [(m.start(), "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and (sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[1])))


HARD = ["a@b.c_d@e.f x@y ..@a-b.c. a@@b.c @b.c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.999 01.002.0003.4 1..2.3.4",
        "+1 (017) 555-7713 +12345678901234567 ++1 2 3 4 5 6 7 8 9 0 +1 -", "4111 1111 1111 1111 4111-1111-1111-1111  4111 1111 1111 1112",
        "9" * 300 + " " + "a" * 3000 + "@", "é 1.2.3.4 \U0001f600 a@b.cd", "", "1-" * 50 + "+", "٣@x.y ٣.٣.٣.٣"]


@pytest.mark.parametrize("text", HARD)
def test_base_spans(text):
    assert pii.base_spans(text)[0] == brute(text)


def test_base_spans_random():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice("a1.@+ -()%_94") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t)[0] == brute(t), t


def test_field_brute_force():
    """Marginals and the best segmentation, against all segmentations."""
    rng = np.random.default_rng(0)
    cands = [(0, 2, 0, 0), (1, 3, 0, 0), (2, 4, 0, 0), (0, 4, 0, 0), (3, 5, 0, 0), (1, 2, 0, 0)]
    score = rng.normal(size=(len(cands), 4))
    weight, marg = {}, np.zeros_like(score)
    for r in range(len(cands) + 1):
        for pick in itertools.combinations(range(len(cands)), r):
            if any(cands[a][0] < cands[b][1] and cands[b][0] < cands[a][1] for a, b in itertools.combinations(pick, 2)):
                continue
            for kinds in itertools.product(range(4), repeat=r):
                weight[tuple(zip(pick, kinds))] = sum(score[k, y] for k, y in zip(pick, kinds))
    z = sum(map(math.exp, weight.values()))
    for s, v in weight.items():
        for k, y in s:
            marg[k, y] += math.exp(v) / z
    assert np.allclose(pii.segment_marginals(5, cands, score), marg)
    assert sorted(pii.decode(5, cands, score)) == sorted(max(weight, key=weight.get))


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        rows.append((i, f"word {rng.choice('abcdefghijklmnop')}x +1 ({d(3)}) 555-{d(4)} or x.{d(2)}@mail{d(1)}.example.com then {d(16)} and 10.{rng.randint(0, 255)}.3.4 end"))
    return rows


def test_model_adds_spans_and_keeps_base(spark):
    rows = corpus() + [(500, "call (017) 555-7713 now"), (501, None), (502, ""), (501, "a@b.cd"), (None, "plain")]
    df = docs(spark, rows, clash=True)
    model = pii.fit(docs(spark, corpus() + [(1, None)], clash=True))
    for _, t in rows:
        base, spans = pii.find_spans(t or "", model)
        assert base == brute(t or "") and set(base) <= set(spans)
    # A phone number without its country code is no base span; the field knows it.
    assert pii.find_spans("call (017) 555-7713 now", model)[1] == [(5, "phone", 19)]
    assert pii.find_spans("in 256.1.1.1 and 12345", model)[1] == []
    got = pii.with_pii(df, model)
    assert got.columns[:len(df.columns)] == df.columns and got.count() == len(rows)
    by = {(r.doc_id, r.text): r for r in got.collect()}
    assert by[(501, None)]["__ll_redacted"] is None and by[(501, None)]["__ll_spans"] == ""
    assert by[(501, "a@b.cd")]["__ll_redacted"] == "[EMAIL]" and by[(501, "a@b.cd")]["__ll_n_email"] == 1


def test_without_windows_nothing_is_learnt(spark):
    model = pii.fit(docs(spark, [(1, "no data here"), (2, None)]))
    assert not model.weights.any()
    assert pii.with_pii(empty(spark), pii.fit(empty(spark))).count() == 0


def test_redact_overlaps():
    assert pii.redact("x 12 y", [(2, "phone", 4), (3, "card", 4)]) == "x [PHONE] y"


def held_out(seed, n=80):
    """(text, start, kind, end) of forms and words the training did not see."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        card = d(15)
        card += next(str(x) for x in range(10) if pii.luhn(card + str(x)))
        four = [card[i:i + 4] for i in range(0, 16, 4)]
        a, b, c = rng.randint(200, 899), d(3), d(4)
        forms = [("card", ".".join(four)), ("card", "  ".join(four)), ("phone", f"001 {a} {b} {c}"), ("phone", f"({a}) {b}-{c}"), ("phone", f"{a}-{b}-{c}"),
                 ("ip", " . ".join(str(rng.randint(0, 255)) for _ in range(4))), ("email", f"k{d(2)} at host{d(1)} dot org"), ("email", f"k.{d(2)} @ site{d(1)}.example.com")]
        kind, s = rng.choice(forms)
        left = rng.choice(["He wrote: ", "reach me on ", "see ", "Ruf an: ", "the line is "])
        out.append((f"{left}{s} {rng.choice(['please', 'or later.', 'und so', 'x'])}", len(left), kind, len(left) + len(s)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(docs(spark, corpus()))


def test_field_finds_unseen_forms_of_every_kind(model):
    right = wrong = missed = 0
    by_kind = {k: [0, 0] for k in pii.KINDS}
    for text, a, kind, b in held_out(11, 400):
        got = set(pii.find_spans(text, model)[1])
        hit = (a, kind, b) in got
        by_kind[kind][0] += hit
        by_kind[kind][1] += 1
        right, wrong, missed = right + hit, wrong + len(got - {(a, kind, b)}), missed + (not hit)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9, (right, wrong, missed, by_kind)
    assert all(x / n >= 0.8 for x, n in by_kind.values()), by_kind


def test_field_leaves_lookalikes_alone(model):
    rng, found = random.Random(5), 0
    texts = [f"{w} {s} {v}" for w in ("on", "version", "price of") for v in ("ended", "is it") for _ in range(6) for s in pii.decoys(rng)]
    for t in texts:
        if not brute(t):
            found += bool(pii.find_spans(t, model)[1])
    assert found <= 0.1 * len(texts)
    assert pii.find_spans("meet at noon dot then", model)[1] == []


def test_many_spans_in_one_text_take_linear_time(model):
    times = []
    for n in (2000, 8000):
        text = "".join(f"a{i}@mail{i % 9}.example.com +1 (017) 555-{i % 9999:04d} " for i in range(n))
        t0 = time.perf_counter()
        base, spans = pii.find_spans(text, model)
        times.append(time.perf_counter() - t0)
        assert len(base) == 2 * n and set(base) <= set(spans)
    assert times[1] < 8 * times[0] + 0.5 and times[1] < 4


def test_copies_are_merged_before_sampling(spark):
    """A text that is most of the table is one of the training texts."""
    rows = corpus()
    many = rows + [(1000 + i, "only this 12345678901 number here") for i in range(3000)]
    a, b = pii.fit(docs(spark, rows + many[-1:]), sample_docs=10 ** 6), pii.fit(docs(spark, many), sample_docs=10 ** 6)
    assert np.allclose(a.weights, b.weights)
