"""Removal of long repeated byte strings with run-length Burrows-Wheeler indexes.

A byte goes if it is covered by a string of ``length`` bytes that also starts
elsewhere: in another document, or at another place of the same one.

**Sharding.** One index over a corpus does not fit a task, so equal strings are
first brought together. Every ``length``-byte window of a text is named by the
least hash of its ``GRAM``-byte substrings; equal windows have equal names.
Consecutive windows of one name form a segment (some 200 windows, or a whole
periodic stretch). Names that occur once are done. A segment that occurs twice
byte by byte is repeated as a whole. What is left are names with different
segments: one copy of each goes to an index shard. Names whose segments share
their least text go to the same shard, so neighbouring segments of near copies
meet there and are joined where they overlap.

**Index.** A shard's suffix array (prefix doubling, sorted groups are left
alone) gives its Burrows-Wheeler transform and that its runs. At the two ends
of each run the text position is sampled with its match length against the
neighbouring suffix. Inside a run both neighbours are preceded by the same
byte, so their match is one byte longer one place to the left: streaming the
samples in text order, matching statistics of every other position follow from
the last sample before it. Positions whose statistic reaches ``length`` mark
their match.

**Large groups.** A name whose segments exceed ``shard_bytes`` is not indexed:
its windows are counted by a 128-bit hash, in rows that combine before the
shuffle and salt nothing away. The result is the same.

Only repeated texts' keys, segment hashes and index shards move; each text is
shuffled twice, to cut out segments and to apply the marks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, cut, prepare

GRAM = 32
CHUNK = 1 << 18
_U = np.uint64


# -- names and segments ----------------------------------------------------------

class Roller:
    """Hashes of all substrings of a fixed length, by prefix sums of
    byte * base ** i modulo 2 ** 64."""

    def __init__(self, base: int, size: int) -> None:
        self.up, self.down = (self._powers(x, size) for x in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        x = np.full(size + 1, base, _U)
        x[0] = 1
        return np.cumprod(x, dtype=_U)

    def __call__(self, b: np.ndarray, k: int) -> np.ndarray:
        n = len(b)
        c = np.zeros(n + 1, _U)
        np.cumsum((b + _U(1)) * self.up[:n], out=c[1:])
        h = (c[k:] - c[:-k]) * self.down[:n - k + 1]
        h ^= h >> _U(31)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones, from block-wise prefix and
    suffix minima."""
    n = len(x)
    y = np.concatenate([x, np.full(-n % w, x[-1], x.dtype)]).reshape(-1, w)
    pre = np.minimum.accumulate(y, axis=1).ravel()
    suf = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[:n - w + 1], pre[w - 1:n])


def segments(raw: bytes, length: int, roll: Roller) -> Iterator[tuple[int, int, int, int]]:
    """(name, start, end, often) of the segments of one text: windows start..end
    - length of equal name. Only if the named substring occurs ``often`` (1) in
    a segment can the segment repeat a window within itself."""
    b = np.frombuffer(raw, np.uint8).astype(_U)
    w = length - GRAM + 1
    for lo in range(0, len(b) - length + 1, CHUNK):
        grams = roll(b[lo:lo + CHUNK + length - 1], GRAM)
        name = sliding_min(grams, w)
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        last = np.append(first[1:], len(name)) - 1
        for v, i, j in zip(name[first], first.tolist(), last.tolist()):
            yield int(v.view(np.int64)), i + lo, j + lo + length, int(np.count_nonzero(grams[i:j + w] == v) > 1)


# -- index ------------------------------------------------------------------------

def suffix_array(t: np.ndarray, end: np.ndarray, snapshot: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of regions laid end to end in ``t`` (``end``: where the
    region of each position ends, by a sign of its own below all bytes). Also,
    for each position, its class among suffixes compared to ``snapshot`` bytes
    (7 times a power of two); None if no two suffixes agree that far."""
    n = len(t)
    pad = np.concatenate([t, np.zeros(7, np.uint8)])
    rest = end - np.arange(n)
    key = np.zeros(n, _U)
    for i in range(7):  # seven bytes, zeros past the end, and how many are real
        key = (key << _U(8)) | np.where(i < rest, pad[i:n + i], 0).astype(_U)
    key = (key << _U(8)) | np.minimum(rest, 8).astype(_U)
    sa = np.arange(n)[::-1]
    sa = sa[np.argsort(key[sa], kind="stable")]
    edge = np.ones(n, bool)
    edge[1:] = (key[sa][1:] != key[sa][:-1]) | (rest[sa][1:] < 8)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    tied = ~edge
    tied[:-1] |= ~edge[1:]
    at, h, classes = np.flatnonzero(tied), 7, None
    while len(at):
        if h == snapshot:
            classes = rank.copy()
        p = sa[at]
        q = p + h
        # Past a region's end stands a sign of its own, later ones first.
        both = rank[p] * (2 * n + 2) + np.where(q < end[p], n + 1 + rank[np.minimum(q, n - 1)], n - p)
        o = np.argsort(both, kind="stable")
        p, both = p[o], both[o]
        sa[at] = p
        edge = np.ones(len(at), bool)
        edge[1:] = both[1:] != both[:-1]
        rank[p] = at[np.maximum.accumulate(np.where(edge, np.arange(len(at)), 0))]
        tied = ~edge
        tied[:-1] |= ~edge[1:]
        at, h = at[tied], 2 * h
    return sa, classes


def run_samples(t: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, match length) at the ends of the runs of the transform, for
    matches of ``length`` bytes and more."""
    depth = 7 << ((length - 1) // 7).bit_length() - 1
    sa, classes = suffix_array(t, end, depth)
    if classes is None or len(sa) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.where(sa == start[sa], 256 + np.arange(len(sa)), t[np.maximum(sa - 1, 0)])
    cut_ = np.flatnonzero(before[1:] != before[:-1])
    a, b = sa[cut_], sa[cut_ + 1]  # tail of one run, head of the next
    room = np.minimum(end[a] - a, end[b] - b)
    ok = room >= length
    a, b, room = a[ok], b[ok], room[ok]
    tail = length - depth
    near = classes[a] == classes[b]
    a, b, room = a[near], b[near], room[near]
    same = classes[a + tail] == classes[b + tail]
    # A suffix of just ``depth`` bytes is a class of its own: compare its bytes.
    rest = np.flatnonzero(~same & (room == length))
    for i in range(depth, length):
        rest = rest[t[a[rest] + i] == t[b[rest] + i]]
    same[rest] = True
    a, b, room = a[same], b[same], room[same]
    match = np.full(len(a), length)
    live = np.arange(len(a))
    while len(live):
        live = live[match[live] < room[live]]
        live = live[t[a[live] + match[live]] == t[b[live] + match[live]]]
        match[live] += 1
    return np.concatenate([a, b]), np.concatenate([match, match])


def repeated_ranges(regions: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(region, start, end) covered by strings of ``length`` bytes that start
    at two places of the regions."""
    size = np.array([len(r) for r in regions])
    t = np.frombuffer(b"".join(regions), np.uint8)
    if not len(t):
        return []
    base = np.concatenate([[0], np.cumsum(size)])
    start, end = np.repeat(base[:-1], size), np.repeat(base[1:], size)
    pos, match = run_samples(t, start, end, length)
    if not len(pos):
        return []
    # Matching statistics in text order: how far the matches seen so far reach.
    o = np.lexsort((match, pos))
    pos, reach = pos[o], (pos + match)[o]
    upto = np.maximum.accumulate(reach)
    head = np.concatenate([[True], (pos[1:] > upto[:-1]) | (start[pos[1:]] != start[pos[:-1]])])
    lo = pos[head]
    hi = np.maximum.reduceat(reach, np.flatnonzero(head))
    which = np.searchsorted(base, lo, side="right") - 1
    return list(zip(which.tolist(), (lo - base[which]).tolist(), (hi - base[which]).tolist()))


def _index_shard(length: int):
    """A shard's rows (k1, k2, start, raw) -> its marks (k1, k2, lo, hi)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k1", "k2", "start"], kind="stable").drop_duplicates(["k1", "k2", "start"])
        regions: list[bytearray] = []
        of: list[tuple[int, int, int]] = []
        for k1, k2, lo, raw in zip(pdf["k1"], pdf["k2"], pdf["start"], pdf["raw"]):
            if of and of[-1][:2] == (k1, k2) and lo <= of[-1][2] + len(regions[-1]):
                # The next segment of the same text: only what it adds.
                regions[-1] += raw[max(0, of[-1][2] + len(regions[-1]) - lo):]
            else:
                of.append((k1, k2, lo))
                regions.append(bytearray(raw))
        got = [(of[r][0], of[r][1], of[r][2] + a, of[r][2] + b) for r, a, b in repeated_ranges([bytes(x) for x in regions], length)]
        return pd.DataFrame(got, columns=["k1", "k2", "lo", "hi"]).astype("int64")

    return run


# -- plan -------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, k1, k2): texts as bytes with a 128-bit key."""
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("id"), raw.alias("raw")) \
        .withColumn("k1", F.xxhash64("raw")).withColumn("k2", F.xxhash64(F.lit(1), F.col("raw")))


def _all_segments(keyed: DataFrame, length: int) -> DataFrame:
    """(name, k1, k2, start, end, often, body) of every text long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Roller(0x9E3779B97F4A7C15, CHUNK + length)
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for raw, k1, k2 in zip(*(b.column(i).to_pylist() for i in range(3))):
                for name, lo, hi, often in segments(raw, length, roll):
                    for col, v in zip(rows, (name, k1, k2, lo, hi, often, xxhash.xxh64_intdigest(raw[lo:hi]) - (1 << 63))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows],
                                             names=["name", "k1", "k2", "start", "end", "often", "body"])

    return keyed.filter(F.length("raw") >= length).select("raw", "k1", "k2").mapInArrow(
        run, "name long, k1 long, k2 long, start long, end long, often long, body long")


def _cut_out(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (k1, k2, start, end, shard) with the bytes. Copies of a text
    give their parts once per task; the last ones are dropped where they meet."""
    per_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "shard")).alias("parts"))
    rows = keyed.select("k1", "k2", "raw").join(per_text, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for k1, k2, raw, parts in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (k1, k2) == last:  # a further copy of the same text: the join sorts by key
                    continue
                last = (k1, k2)
                for p in parts:
                    for col, v in zip(out, (p["shard"], k1, k2, p["start"], raw[p["start"]:p["end"]])):
                        col.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["shard", "k1", "k2", "start", "raw"])

    return rows.mapInArrow(run, "shard long, k1 long, k2 long, start long, raw binary")


def _counted(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Marks of names too large for a shard, by counting their windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, k1, k2, start, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                t = np.frombuffer(raw, np.uint8).astype(_U)
                hs = [Roller(base, len(t))(t, length).view(np.int64) for base in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
                n = len(hs[0])
                yield pa.RecordBatch.from_arrays([pa.array(hs[0]), pa.array(hs[1]), pa.array(np.full(n, k1)), pa.array(np.full(n, k2)),
                                                  pa.array(np.arange(start, start + n))], names=["h1", "h2", "k1", "k2", "lo"])

    once = _cut_out(keyed, wanted).dropDuplicates(["shard", "k1", "k2", "start"])
    rows = cut(once.mapInArrow(run, "h1 long, h2 long, k1 long, k2 long, lo long"))
    twice = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return rows.join(twice, ["h1", "h2"], "left_semi").select("k1", "k2", "lo", (F.col("lo") + length).alias("hi"))


def marks(keyed: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(k1, k2, lo, hi): ranges of texts to remove; they may overlap."""
    # Segments are made twice rather than kept: most names occur once and go here.
    seg = _all_segments(keyed, length)
    again = seg.groupBy("name").agg(F.count(F.lit(1)).alias("places"), F.max("often").alias("often")) \
        .filter("places > 1 OR often = 1").select("name")
    seg = cut(seg.join(again, "name", "left_semi"))
    bodies = seg.groupBy("name", "body").agg(F.count(F.lit(1)).alias("c"), F.max("often").alias("often"),
                                             F.min(F.struct("k1", "k2", "start", "end")).alias("rep"))
    size = (F.col("rep.end") - F.col("rep.start"))
    names = bodies.groupBy("name").agg(F.count(F.lit(1)).alias("n_bodies"), F.sum(size).alias("bytes"), F.min("rep.k1").alias("least"))
    bodies = cut(bodies.join(names, "name"))
    whole = seg.join(bodies.filter("c > 1").select("name", "body"), ["name", "body"]).select("k1", "k2", F.col("start").alias("lo"), F.col("end").alias("hi"))
    bodies = bodies.filter("n_bodies > 1 OR often = 1")
    hot = F.col("bytes") > shard_bytes
    bundles = bodies.filter(~hot).groupBy("least").agg(F.sum(F.col("rep.end") - F.col("rep.start")).alias("bundle"))
    some = bodies.filter(~hot).join(bundles, "least").withColumn(
        "bundle_key", F.when(F.col("bundle") <= shard_bytes, F.col("least")).otherwise(F.col("name")))
    total = bodies.filter(~hot).agg(F.sum(F.col("rep.end") - F.col("rep.start"))).first()[0] or 0
    n_shards = max(1, math.ceil(2 * total / shard_bytes))
    place = ["rep.k1", "rep.k2", "rep.start", "rep.end"]
    wanted = some.select(*place, F.pmod(F.xxhash64("bundle_key"), F.lit(n_shards)).alias("shard"))
    found = _cut_out(keyed, wanted).groupBy("shard").applyInPandas(_index_shard(length), "k1 long, k2 long, lo long, hi long")
    out = whole.unionByName(found)
    large = bodies.filter(hot).select(*place, F.lit(0).cast("long").alias("shard"))
    if large.limit(1).count():
        out = out.unionByName(_counted(keyed, large, length))
    return out


def _apply(raw: bytes, ranges: list[dict] | None) -> tuple[bytes, int, list[tuple[int, int]]]:
    """Kept bytes, removed bytes, maximal removed runs."""
    runs: list[tuple[int, int]] = []
    for r in sorted((x["lo"], x["hi"]) for x in ranges or []):
        if runs and r[0] <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], r[1]))
        else:
            runs.append(r)
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept), sum(hi - lo for lo, hi in runs), runs


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   shard_bytes: int = 3_000_000, with_bytes: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]): one row
    per row of ``docs``, lengths in UTF-8 bytes. ``spans`` lists the maximal
    removed runs as ``start:end``, comma-joined; ``kept`` has the bytes left.

    Null texts count as empty. Repeated rows repeat each other's text, so one
    of ``length`` bytes or more goes wholly. Texts under ``length`` bytes stay.
    Ids may be null or repeat. ``length`` is at least 40. Only the two named
    columns are read; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    keyed = _keyed(docs, id_col, text_col)
    per_text = marks(keyed, length, shard_bytes).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    rows = keyed.join(per_text, ["k1", "k2"], "left").select("id", "raw", "ranges")
    fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
              *(T.StructField(c, T.StringType()) for c in ("kept_sha256", "spans"))] + [T.StructField("kept", T.BinaryType())] * with_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for raw, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, removed, runs = _apply(raw, ranges)
                spans = ",".join(f"{lo}:{hi}" for lo, hi in runs)
                for col, v in zip(out, (len(raw), removed, len(runs), hashlib.sha256(kept).hexdigest(), spans, kept)):
                    col.append(v)
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:5])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(out[5], pa.binary())] * with_bytes, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)
