"""Personal data by base patterns and a semi-Markov conditional random field.

**Base spans** follow four fixed patterns (see the scanners below), leftmost
and non-overlapping per kind; they always stay.

**The field.** A window is a maximal run of digits, ``+`` and the separators of
numbers, the run of address characters around an ``@``, or an address that is
spaced or spelled out ("name at host dot org"). Its tokens are digit groups,
words and single signs. Every segment of at most ``MAX_TOKENS`` tokens that could
be an entity is a candidate, described by features of the whole span: digits,
groups and their sizes, separators, prefix, checksum, octets, form of a date,
borders and the word before. A candidate of kind y scores the sum of its weights,
or nothing at all if it cannot be that kind (``possible``: a phone has 7 to 15
digits, a card 13 to 19, an address four parts up to 255); a token outside any
entity scores 0. Bounded-entity dynamic programming over the window sums all
segmentations (training, marginals) or takes the best one (decoding), which
fixes borders and kinds jointly. Text outside windows holds no candidate, so
windows are independent.

**Training.** Windows of a bounded sample of documents (``sample_docs``), each
text once, whose gold segments are the base spans. Further copies write each
gold span in forms that the base patterns do not know (``variants``: dotted and
wide cards, numbers with 00 or without country code, spaced parts, spelled
addresses) or put something else in its place (``decoys``: dates, prices,
versions, ranges, ids), which is no entity. Fitted by gradient ascent on the
conditional log-likelihood.

Decoded segments with a marginal of 0.5 or more that touch no base span are
added to the base spans.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, prepare, sample_by_count

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 16
Span = tuple[int, str, int]  # start, kind, end

# Fixed patterns of the base spans. Digits, "+" and separators of one number
# form a run; ip, card and phone are looked for inside runs only.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9+][\x20().0-9+-]{5,}")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PATTERN = {"email": re.compile(_LOCAL.pattern + "+" + _DOMAIN.pattern), "ip": _IP, "card": _CARD, "phone": _PHONE}
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
# Addresses that are spaced or spelled out: "name @ host.org", "name (at) host (dot) org".
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:@|[(\[]at[)\]])\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+"
                      r"(?:(?:\x20?(?:\.|[(\[]dot[)\]])\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,4}+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern. The local part is taken backwards from
    each ``@``, so a long run without ``@`` costs nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > free and _LOCAL.match(text, lo - 1):
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, m.end()))
        # The next local part starts after this match or after this "@".
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def number_spans(text: str, run: tuple[int, int]) -> list[Span]:
    """ip, card and phone matches inside one run."""
    lo, hi = run
    out: list[Span] = []
    for m in _IP.finditer(text, lo, hi):
        # Leading zeros aside, a part above 255 has over three digits or is too large.
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text, lo, hi):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text, lo, hi):
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Base spans by start and kind, and the number runs."""
    spans: list[Span] = [(a, "email", b) for a, b in email_spans(text)] if "@" in text else []
    runs = [m.span() for m in _RUN.finditer(text)]
    for run in runs:
        spans += number_spans(text, run)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))), runs


# -- windows, candidates and their features -----------------------------------

# Sizes of the categorical features, in the order of ``span_features``.
_SIZES = (21, 2, 8, 6, 8, 3, 2, 5, 5, 6, 64, 5, 3, 2, 64, 3)
# Common endings of host names.
_ENDINGS = frozenset("com org net edu gov io info biz eu de fr es uk us it nl ch".split())
_DATE = re.compile(r"(?:19|20)[0-9]{2}([-./ ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./ ])[0-9]{1,2}\2(?:19|20)?[0-9]{2}")
_OFFSET = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])
N_FEATURES = int(sum(_SIZES))


def _border(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".@+-" else 4


def span_features(text: str, lo: int, hi: int, before: int) -> list[int]:
    """Feature rows of the span as a whole; ``before`` is the bucket of the
    word in front of its window."""
    s = text[lo:hi]
    groups = _DIGITS.findall(s)
    digits = "".join(groups)
    kinds = {c for c in s if not c.isalnum()}
    seps = (0 if not kinds else 1 if kinds == {" "} else 2 if kinds == {"-"} else 3 if kinds == {"."}
            else 4 if kinds & {"(", ")"} else 5 if "@" in kinds else 6 if kinds <= {" ", "-", "."} else 7)
    octets = len(groups) == 4 and s == ".".join(groups) and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    sizes = tuple(map(len, groups))
    shape = 0 if octets else 1 if sizes == (4, 4, 4, 4) else 2 if sizes[-3:] == (3, 3, 4) else \
        3 if len(sizes) == 1 else 4 if len(sizes) > 1 else 5
    tail = re.split(r"[^A-Za-z0-9]", s)[-1]
    address = 0 if "@" not in s and " at" not in s.replace("(", " ").replace("[", " ") else \
        1 + 2 * (s.find("@") != 0) + (tail.isalpha() and 2 <= len(tail) <= 6) + (s.count("@") > 1)
    lead = 4 if s[0] == "+" else 0 if not digits else 1 if digits.startswith("00") else 2 if digits[0] == "0" else 3
    form = 1 if _DATE.fullmatch(s) else 2 if re.search(r"[0-9] [.-] ?[0-9]|[0-9]  +[0-9]", s) else 0
    split = zlib.crc32(repr(sizes[:7]).encode()) % 64 if "@" not in s else 0
    values = (min(len(digits), 20), int(len(digits) >= 13 and luhn(digits)), min(len(groups), 7), shape, seps,
              1 if s[0] == "+" else 2 if s[0] == "(" else 0, int(s[-1].isalnum()),
              _border(text[lo - 1:lo]), _border(text[hi:hi + 1]), address, before, lead, form, int(len(groups) > 1 and min(sizes) == 1), split,
              0 if not address else 1 + (tail.lower() in _ENDINGS))
    return [int(o) + v for o, v in zip(_OFFSET, values)]


def possible(s: str) -> list[bool]:
    """Which KINDS a span can be at all."""
    groups = _DIGITS.findall(s)
    n = sum(map(len, groups))
    dots = re.sub(r"[0-9\x20]+", "", s)
    plain = not re.search("[A-Za-z@]", s)
    ip = plain and len(groups) == 4 and dots == "..." and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    # A sign or word for "at", and behind the last "dot" a name.
    spelled = re.search(r"@|[ (\[]at[ )\]]", s) is not None and re.search(r"(?:\.|[ (\[]dot[ )\]])\x20?(?!(?:dot|at)$)[A-Za-z0-9-]+$", s) is not None
    return [spelled, ip, plain and 13 <= n <= 19 and luhn("".join(groups)), plain and 7 <= n <= 15 and not ip]


def window_candidates(text: str, lo: int, hi: int, address: bool) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Token count and the candidate segments (first, after last, start, end)."""
    toks = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    out = []
    if address:
        at = [i for i, (a, b) in enumerate(toks) if text[a] == "@" or (text[a:b] == "at" and 0 < i < len(toks) - 1)]
        for i in at:
            for a in range(max(0, i - MAX_TOKENS + 4), i):
                for b in range(i + 2, min(len(toks), a + MAX_TOKENS) + 1):
                    if text[toks[a][0]].isalnum() and text[toks[b - 1][0]].isalnum():
                        out.append((a, b, toks[a][0], toks[b - 1][1]))
        return len(toks), out
    size = [b - a if text[a].isdigit() else 0 for a, b in toks]
    for a in range(len(toks)):
        if not (size[a] or text[toks[a][0]] in "+("):
            continue
        n = 0
        for b in range(a + 1, min(len(toks), a + MAX_TOKENS) + 1):
            n += size[b - 1]
            if n > 19:
                break
            if size[b - 1] and (n >= 7 or b - a == 7):
                out.append((a, b, toks[a][0], toks[b - 1][1]))
    return len(toks), out


def windows(text: str, spans: list[Span], runs: list[tuple[int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is address) of the windows of a text."""
    out = [(a - (text[max(a - 1, 0):a] == "("), b, False) for a, b in runs
           if sum(map(len, _DIGITS.findall(text, a, b))) >= 7 or text.count(".", a, b) >= 3]
    if "@" in text or "at)" in text or "at]" in text or " dot " in text:
        spelled = [m.span() for m in _SPELLED.finditer(text)]
        out += [(a, b, True) for a, b in spelled if re.search(r"[\x20(\[]", text[a:b])]
    at = text.find("@")
    while at >= 0:
        lo, hi = at, at + 1
        while lo > 0 and at - lo < 64 and _LOCAL.match(text, lo - 1):
            lo -= 1
        while hi < len(text) and hi - at < 254 and _LOCAL.match(text, hi):
            hi += 1
        if lo < at and hi > at + 1:
            out.append((lo, hi, True))
        at = text.find("@", hi)
    return out


def _before(text: str, lo: int) -> int:
    m = re.search(r"(\w+)\W*$", text[max(0, lo - 40):lo])
    return zlib.crc32(m[1].lower().encode()) % 64 if m else 0


# -- the field ---------------------------------------------------------------

@dataclass
class PiiModel:
    """Weights by feature and kind."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((N_FEATURES, len(KINDS))))


def _logadd(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(min(a, b) - m))


def segment_marginals(n: int, cands: list, score: np.ndarray) -> np.ndarray:
    """Marginal of every candidate and kind over all segmentations."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    tot = np.logaddexp.reduce(score, axis=1)
    for k, c in enumerate(cands):
        ends[c[1]].append(k)
        starts[c[0]].append(k)
    alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        a = alpha[j - 1]
        for k in ends[j]:
            a = _logadd(a, alpha[cands[k][0]] + tot[k])
        alpha[j] = a
    for i in range(n - 1, -1, -1):
        b = beta[i + 1]
        for k in starts[i]:
            b = _logadd(b, beta[cands[k][1]] + tot[k])
        beta[i] = b
    edge = np.array([alpha[c[0]] + beta[c[1]] - alpha[n] for c in cands])
    return np.exp(edge[:, None] + score)


def decode(n: int, cands: list, score: np.ndarray) -> list[tuple[int, int]]:
    """Best segmentation: (candidate, kind) of its entities."""
    kind, top = score.argmax(axis=1), score.max(axis=1)
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, c in enumerate(cands):
        ends[c[1]].append(k)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in ends[j]:
            if (v := best[cands[k][0]] + top[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            out.append((back[j], int(kind[back[j]])))
            j = cands[back[j]][0]
    return out[::-1]


def _digits(rng: random.Random, k: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(k))


def variants(kind: str, s: str, rng: random.Random) -> list[str]:
    """Other spellings of a gold span, which the base patterns do not match."""
    d = "".join(_DIGITS.findall(s))
    if kind == "email":
        user, host = s.split("@", 1)
        dot = rng.choice([" dot ", " (dot) ", "[dot]"])
        return [f"{user} @ {host}", f"{user}{rng.choice([' at ', ' (at) ', '[at]'])}{host.replace('.', dot)}"]
    if kind == "ip":
        return [s.replace(".", " . "), s.replace(".", ". ")]
    if kind == "card":
        four = [d[i:i + 4] for i in range(0, len(d), 4)]
        return [".".join(four), "  ".join(four), " - ".join(four)]
    local = d[-10:] if len(d) > 10 else d
    three = f"{local[:-7]} {local[-7:-4]} {local[-4:]}".strip()
    return [f"00{d[:-10]}{' ' if d[:-10] else ''}{three}", f"({local[:-7] or '0'}) {local[-7:-4]}-{local[-4:]}", three, three.replace(" ", "-"), three.replace(" ", "."),
            f"00{d[:2]} {d[2:5]} {d[5:8]} {d[8:]}".strip()]


def decoys(rng: random.Random) -> list[str]:
    """Things that look like numbers or addresses and are none."""
    n, month, day, year = rng.randint(1, 999), rng.randint(1, 12), rng.randint(1, 28), rng.randint(1950, 2040)
    wide = _digits(rng, 16)
    while luhn(wide):
        wide = _digits(rng, 16)
    word = [rng.choice("look meet it this noon home here point line then spot once".split()) for _ in range(3)]
    return [f"{word[0]} at {word[1]} dot {word[2]}", f"{word[0]} @ {word[1]}. {word[2]}", f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d} {rng.randint(0, 23):02d}",
            f"{n}.{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 3)}", f"{n}.{_digits(rng, 3)}.{_digits(rng, 2)}", f"{n} 000 000",
            f"{rng.randint(0, 20)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}.{rng.randint(256, 99999)}", f"{rng.randint(0, 30)}.{rng.randint(0, 30)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 9)}",
            f"{n}-{n + rng.randint(1, 99)} {n + 100}-{n + 230}", f"{year}-{year + 3} {year + 4}-{year + 9}", _digits(rng, rng.randint(7, 12)), wide,
            f"{_digits(rng, 6)}.{_digits(rng, rng.randint(2, 8))}", f"{wide[:4]}.{wide[4:8]}.{wide[8:12]}.{wide[12:]}", " ".join(_digits(rng, rng.randint(1, 2)) for _ in range(8))]


def _example(text: str, lo: int, hi: int, address: bool, gold: dict) -> tuple | None:
    n, cands = window_candidates(text, lo, hi, address)
    if not cands:
        return None
    before = _before(text, lo)
    y = np.zeros((len(cands), len(KINDS)))
    for k, c in enumerate(cands):
        if (c[2], c[3]) in gold:
            y[k, gold[(c[2], c[3])]] = 1
    return (n, cands, *_scored_by(text, cands, before), y)


def _scored_by(text: str, cands: list, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the candidates, and a penalty for impossible kinds."""
    feats = np.array([span_features(text, c[2], c[3], before) for c in cands])
    return feats, np.where(np.array([possible(text[c[2]:c[3]]) for c in cands]), 0.0, -1e4)


def fit_field(wins: list[tuple[str, int, int, bool]], rounds: int = 40, l2: float = 0.05) -> PiiModel:
    """``wins``: (text around the window, start, end, is address)."""
    data = []

    def add(*args) -> None:
        if (x := _example(*args)) is not None:
            data.append(x)

    for text, lo, hi, address in wins:
        gold: dict = {}
        free = 0
        for a, kind, b in sorted(base_spans(text)[0], key=lambda s: (s[0], -s[2])):
            if a >= free:  # the longest of overlapping spans is gold
                gold[(a, b)] = KINDS.index(kind)
                free = b
        add(text, lo, hi, address, gold)
        rng = random.Random(zlib.crc32(text[lo:hi].encode()))
        # Copies with one entity each, between what stands around the window.
        left, right = text[:lo] or " ", text[hi:] or " "
        for (a, b), kind in gold.items():
            if lo <= a and b <= hi:
                written = variants(KINDS[kind], text[a:b], rng)
                for v, entity in [(rng.choice(written), True), (rng.choice(written), True), (rng.choice(decoys(rng)), False), (rng.choice(decoys(rng)[:2] if KINDS[kind] == "email" else decoys(rng)[2:]), False)]:
                    pad = "" if left[-1:].isspace() else " "
                    t = f"{left}{pad}{v} {right.lstrip()}"
                    at = len(left) + len(pad)
                    for w in windows(t, *base_spans(t)):
                        if w[0] < at + len(v) and w[1] > at:
                            add(t, *w, {(at, at + len(v)): kind} if entity else {x[::2]: KINDS.index(x[1]) for x in base_spans(t)[0]})
                            break
    model = PiiModel()
    if not data:
        return model
    w = model.weights
    mom, var = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        g = -l2 * w
        for n, cands, feats, mask, y in data:
            p = segment_marginals(n, cands, w[feats].sum(axis=1) + mask)
            np.add.at(g, feats, (y - p)[:, None, :])
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        w += 0.15 * (mom / (1 - 0.9 ** k)) / (np.sqrt(var / (1 - 0.99 ** k)) + 1e-8)
    return model


def fit(docs: DataFrame, text_col: str = "text", sample_docs: int = 2000, max_windows: int = 600) -> PiiModel:
    """Fit on about ``sample_docs`` of the documents that hold a window, at
    most ``max_windows`` windows. Copies of a text, and of a window, count once,
    so a frequent text cannot fill the sample. Without any, the model adds no
    span."""
    prepare(docs.sparkSession)
    d = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(r"@|[0-9][0-9 ().+-]{5,}[0-9]"))
    d = d.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    few = sample_by_count(d, d.count(), sample_docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(0):
                text = x.as_py()
                spans, runs = base_spans(text)
                for lo, hi, address in windows(text, spans, runs):
                    if hi - lo <= 400:
                        a = max(0, lo - 40)
                        out.append((text[a:hi + 40], lo - a, hi - a, address))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                cols, (pa.string(), pa.int32(), pa.int32(), pa.bool_()))], names=["t", "lo", "hi", "address"])

    wins = few.mapInArrow(run, "t string, lo int, hi int, address boolean").distinct() \
        .orderBy(F.xxhash64("t", "lo"), "t", "lo").limit(max_windows).collect()
    return fit_field([tuple(r) for r in wins])


def find_spans(text: str, model: PiiModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and kind (code points)."""
    base, runs = base_spans(text)
    if not runs and "@" not in text and "at)" not in text and "at]" not in text and " dot " not in text:
        return base, base
    added: list[Span] = []
    # Base spans as disjoint stretches: any number of them is searched in log time.
    starts, ends = [], []
    for a, _, b in base:
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def taken(a: int, b: int) -> bool:
        k = bisect_left(starts, b) - 1
        return k >= 0 and ends[k] > a

    free: list[tuple[int, int]] = []  # of what was added, by start
    for lo, hi, address in windows(text, base, runs):
        k = bisect_right(starts, lo) - 1
        if k >= 0 and ends[k] >= hi:
            continue
        n, cands = window_candidates(text, lo, hi, address)
        cands = [c for c in cands if not taken(c[2], c[3])]
        if not cands:
            continue
        feats, mask = _scored_by(text, cands, _before(text, lo))
        score = model.weights[feats].sum(axis=1) + mask
        if score.max() <= 0:
            continue
        marg = segment_marginals(n, cands, score)
        for k, y in decode(n, cands, score):
            a, b = cands[k][2:]
            # What a base pattern matches has been judged by the pattern's own check.
            if marg[k, y] >= 0.5 and not _PATTERN[KINDS[y]].fullmatch(text, a, b):
                j = bisect_left(free, (b,)) - 1  # an earlier window may have it
                if j < 0 or free[j][1] <= a:
                    insort(free, (a, b))
                    added.append((a, KINDS[y], b))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each maximal run of overlapping spans becomes ``[KIND]`` of its first."""
    out, done = [], 0
    for a, kind, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


ADDED = T.StructType([T.StructField(f"{TMP}n_{k}", T.LongType()) for k in KINDS] + [
    T.StructField(f"{TMP}base_sha256", T.StringType()), T.StructField(f"{TMP}spans", T.StringType()),
    T.StructField(f"{TMP}redacted", T.StringType())])


def with_pii(docs: DataFrame, model: PiiModel, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with the number of base spans by kind, ``__ll_base_sha256``,
    ``__ll_spans`` (base and added) and, if ``with_text``, ``__ll_redacted``.

    Null texts count as empty for the spans and stay null when redacted.
    Repeated rows stay, other columns pass through, empty tables stay empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            rows = []
            for x in b.column(at):
                text = x.as_py()
                base, spans = find_spans(text or "", model)
                rows.append((*(sum(k == s[1] for s in base) for k in KINDS),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                             None if text is None or not with_text else redact(text, spans) if spans else text))
            cols = list(zip(*rows)) if rows else [[] for _ in ADDED.fields]
            kinds = [pa.int64()] * len(KINDS) + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                             names=[*b.schema.names, *ADDED.fieldNames()])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED.fields]))
