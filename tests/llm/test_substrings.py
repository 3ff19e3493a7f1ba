from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from helpers import docs, empty

from lakeloom.llm import substrings
from lakeloom.llm.queries import op8_suffix_dedup


def brute(texts: list[bytes], length: int) -> list[tuple]:
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = set()
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover |= set(range(i, i + length))
        kept = bytes(c for i, c in enumerate(t) if i not in cover)
        runs = list(zip(sorted(i for i in cover if i - 1 not in cover), sorted(i + 1 for i in cover if i + 1 not in cover)))
        out.append((len(t), len(cover), len(runs), hashlib.sha256(kept).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda k, a="abcdé": "".join(rng.choice(a) for _ in range(k))
    base, passage = word(900), word(120)
    rows = [(1, None), (2, ""), (3, word(39)), (4, "ab" * 300), (5, "a" * 500), (6, "aab" * 100), (7, base), (8, base), (9, word(60, "\x00a"))]
    for i in range(30):
        a = rng.randint(0, 700)
        rows.append((20 + i, word(rng.randint(0, 90)) + base[a:a + rng.randint(0, 200)] + word(rng.randint(0, 20))))
        rows.append((60 + i, word(rng.randint(30, 90)) + passage + word(rng.randint(30, 90))))
    return rows + [(7, "x"), (None, rows[12][1]), rows[13]]


@pytest.mark.parametrize("seed", range(60))
def test_index_brute_force(seed):
    rng = random.Random(seed)
    src = bytes(rng.choice(b"ab") for _ in range(300))
    regions = []
    for _ in range(rng.randint(1, 8)):
        a = rng.randint(0, 200)
        part = rng.choice([src[a:a + rng.randint(0, 150)], b"ab" * rng.randint(0, 80), b"\x00" * rng.randint(0, 100)])
        regions.append(part + src[:rng.randint(0, 60)])
    length = rng.choice([40, 45, 56, 64, 70])
    seen = Counter(t[i:i + length] for t in regions for i in range(len(t) - length + 1))
    want = {(r, j) for r, t in enumerate(regions) for i in range(len(t) - length + 1)
            if seen[t[i:i + length]] > 1 for j in range(i, i + length)}
    assert {(r, j) for r, a, b in substrings.repeated_ranges(regions, length) for j in range(a, b)} == want


@pytest.mark.parametrize("shard_bytes", [3_000_000, 900])  # 900: also the counted path and split bundles
@pytest.mark.parametrize("length", [40, 101])
def test_brute_force(spark, shard_bytes, length):
    rows = corpus()
    got = substrings.remove_repeats(docs(spark, rows, clash=True), length=length, shard_bytes=shard_bytes).collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute([(t or "").encode() for _, t in rows], length))]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, want))


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 100)
    roll = substrings.Roller(0x9E3779B97F4A7C15, 100 + 40)
    rng = random.Random(0)
    raw = bytes(rng.choice(b"abcd") for _ in range(1000))
    seg = list(substrings.segments(raw, 40, roll))
    covered = sorted(i for _, lo, hi, _ in seg for i in range(lo, hi - 39))
    assert covered == list(range(len(raw) - 39))  # each window in one segment


def test_kept_bytes_and_empty(spark):
    got = substrings.remove_repeats(docs(spark, [(1, "q" + "xyz" * 20 + "r"), (2, "é" * 10)]), length=40, with_bytes=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {1: b"qr", 2: ("é" * 10).encode()}
    assert substrings.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(empty(spark), length=10)


def test_query_shows_what_is_left(spark, tmp_path):
    shared = "é" + "shared passage of the corpus " * 16
    rows = [(1, "one " + shared + "é end"), (2, "ab" + shared + "û"), (3, "unlike"), (4, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_suffix_dedup(spark, str(tmp_path)).collect()}
    raw = {i: (t or "").encode() for i, t in rows}
    for i, r in got.items():
        kept, at = b"", 0
        for a, b in (map(int, s.split(":")) for s in r.spans.split(",") if s):
            kept, at = kept + raw[i][at:a], b
        kept += raw[i][at:]
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and r.text == kept.decode(errors="replace")
    assert got[1].n_removed > 400 and got[2].n_removed == got[1].n_removed and got[3].text == "unlike" and got[4].text == ""


def test_query_flags_long_repeats_only(spark, tmp_path):
    """A passage of over 50 words is removed, and the row flagged, if it has 400
    bytes; 60 short words are fewer and stay, by the contract."""
    long = " ".join(f"passage{i}" for i in range(60))
    short = " ".join(f"w{i}" for i in range(60))
    assert len(short) < 400 < len(long)
    rows = [(1, f"one {long} end"), (2, f"another {long}"), (3, f"third {short} x"), (4, f"fourth {short}"), (5, "clean " * 3), (6, None), (6, long)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.repeated, r.n_bytes) for r in got) == sorted(
        (i, int(long in (t or "")), len(t or "")) for i, t in rows)
    assert all(r.repeated == (r.n_removed > 0) for r in got)
