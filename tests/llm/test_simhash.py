from __future__ import annotations

import random
import re

import xxhash
from helpers import docs, empty

from lakeloom.llm import simhash


def brute_fp(text: str, n: int = 4) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows: list[tuple], bits: int = 4) -> list:
    fps = [brute_fp(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 30, 200]))]
        rows.append((100 - i, " ".join(words)))
        if len(words) >= 30:  # near copies: one word changed, upper case, other white space
            for k in range(6):
                w = list(words)
                w[rng.randrange(len(w))] = "changed"
                rows.append((1000 + 10 * i + k, "\t".join(w).upper() if k % 2 else "\n ".join(w)))
    rows += [(7, None), (8, ""), (9, " \x0b\x0c"), (100, rows[0][1]), (None, rows[5][1]), (3, "\x1c\x85\xa0 x")]
    return rows


def test_fingerprint_brute_force():
    for _, t in corpus():
        assert simhash.fingerprint((t or "").encode(), 4) == brute_fp(t)


def test_groups_brute_force(spark):
    rows = corpus()
    got = simhash.simhash_groups(docs(spark, rows, clash=True)).collect()
    want = brute_components(rows)
    as_key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(as_key((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in got) == sorted(map(as_key, want))


def test_a_chain_is_one_component_and_far_ones_stay_apart(spark):
    # Fingerprints of a chain: each link flips four new bits of the last one.
    chain = [0]
    for k in range(12):
        chain.append(chain[-1] ^ (0b1111 << (5 * k)))
    far = [((1 << 64) - 1) ^ 1]
    fps = spark.createDataFrame([((x + (1 << 63)) % (1 << 64) - (1 << 63),) for x in chain + far], "fp long")
    got = {r.fp: r.root for r in simhash.near_components(fps, 4, 6).collect()}
    assert len({got[x] if x < 1 << 63 else got[x - (1 << 64)] for x in chain}) == 1
    assert got[far[0] - (1 << 64)] == far[0] - (1 << 64)


def test_keep_one(spark):
    rows = corpus()
    df = docs(spark, rows, clash=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    want = sorted({c if c is not None else -1 for _, _, c in brute_components(rows)})
    assert got == want


def test_group_without_ids_keeps_one_row(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "zz " * 50)]
    assert sorted(r.text for r in simhash.keep_one(docs(spark, rows)).collect()) == ["a b c d e f", "zz " * 50]


def test_empty(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_blocks_grow_with_the_fingerprints(spark):
    for n, want in ((0, 6), (1, 6), (2_000_000, 6), (3_000_000, 7), (200_000_000, 7), (300_000_000, 8), (10 ** 9, 8), (10 ** 10, 9)):
        assert simhash.blocks_for(n, 4) == want, n
    rng = random.Random(3)
    fps = list({rng.getrandbits(63) for _ in range(60)})
    fps += [f ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 6))) for f in fps for _ in range(3)]
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long").checkpoint()
    got = [sorted(map(tuple, simhash.near_components(df, 4, blocks).collect())) for blocks in (None, 6, 7, 8, 9)]
    assert all(g == got[0] for g in got)
