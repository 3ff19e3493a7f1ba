"""Quality scores by kernel ridge regression on document statistics.

**Statistics.** One row of numbers per document (``STATS``): length, word
shapes, shares of sign classes, repetition of words and lines, compressibility.
They are computed once, and everything after works on this narrow table.

**Random Fourier features.** The statistics are standardised over the learning
documents; cos(Wx + b) with W from a normal distribution approximates a
Gaussian kernel of width ``width * sqrt(number of statistics)``.

**Ridge.** Each task sums its part of the normal equations over all labelled
learning documents; Spark adds up the cells, the driver solves one system of
fixed size.

**Isotonic calibration.** A quarter of the learning documents, unseen by the
ridge, is counted by score in 2,000 bins; pooling adjacent violators gives a
non-decreasing curve, read linearly between its blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TMP, cut, fold, prepare, unit_hash

STATS = ("log_bytes", "log_words", "log_lines", "word_len", "word_len_sd", "upper", "digit", "sign", "bang", "pipe",
         "odd", "high", "space", "stop", "all_upper", "short", "distinct", "top_word", "dup_lines", "line_sd",
         "worst_line", "pack", "tail_sign", "dup_bigrams")
# Classes of bytes: 1 upper, 2 lower, 3 digit, 4 space, 5 other sign, 6 "!", 7 "|", 8 one of %$#&*, 9 above ASCII, 10 ".,"
_CLASS = np.full(256, 5, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 9
for _c, _k in ((" \t\n\r\x0b\x0c", 4), ("!", 6), ("|", 7), ("%$#&*", 8), (".,", 10)):
    _CLASS[[ord(x) for x in _c]] = _k


def statistics(text: str) -> list[float]:
    """The statistics of one whole text; zeros for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATS)
    n = len(raw)
    cls = _CLASS[np.frombuffer(raw, np.uint8)]
    share = np.bincount(cls, minlength=11) / n
    words = raw.split()
    k = max(len(words), 1)
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    count = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    worst = 0.0
    odd = np.flatnonzero((cls == 6) | (cls == 7) | (cls == 8))
    if len(odd) and lines:
        edge = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        at = np.bincount(np.searchsorted(edge, odd), minlength=len(edge) + 1)
        size = np.diff(np.concatenate([[-1], edge, [n]]))
        worst = float((at / np.maximum(size, 20)).max())
    pairs = len(set(zip(words, words[1:])))
    return [np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(sizes.mean()), float(sizes.std()),
            share[1], share[3], share[5] + share[10], share[6], share[7], share[8], share[9], share[4], share[10],
            sum(w.isupper() and len(w) > 1 for w in words) / k, float((sizes <= 3).mean()), len(count) / k,
            max(count.values(), default=0) / k, 1 - len(set(lines)) / max(len(lines), 1),
            float(np.std([len(x) for x in lines]) / 100) if lines else 0.0, worst,
            len(zlib.compress(raw, 1)) / n, sum(w[-1] in b"%$#&*!|" for w in words) / k, 1 - pairs / max(len(words) - 1, 1)]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every row; a null text counts as empty."""
    cols = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = pa.array([statistics(t.as_py() or "") for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), xs], names=["id", "x"])

    return cols.mapInArrow(run, T.StructType([cols.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class QualityModel:
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray  # statistics x features
    b: np.ndarray
    beta: np.ndarray
    knots: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        f = np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)
        return np.concatenate([f, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def isotonic(x: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins (centre, rows, sum of labels), rising
    centres; returns the blocks' centres and means."""
    blocks: list[list[float]] = []  # sum of x * n, n, sum of labels
    for xi, ni, yi in zip(x, n, y):
        blocks.append([xi * ni, ni, yi])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


def _batch(b: pa.RecordBatch, i: int) -> np.ndarray:
    return b.column(i).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", mod: int = 4,
        out: int = 2, features: int = 256, width: float = 0.6, ridge: float = 1e-3, seed: int = 5) -> QualityModel:
    """Learn from ``stats`` (id, x) and the labels of ids outside fold ``out``
    of ``mod``. Repeated labels of an id are averaged. Without labels every
    score is 0; with one label only, every score is that label."""
    prepare(stats.sparkSession)
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, mod) != out)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    train = cut(stats.join(y, "id").withColumn("part", unit_hash(F.col("id"), seed=3) < 0.75))
    d = len(STATS)
    moments = train.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(d)],
                        *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    rng = np.random.default_rng(seed)
    if not moments[0]:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(2))
    sd = np.array(moments[1 + d:], float)
    model = QualityModel(np.array(moments[1:1 + d], float), np.where(sd > 1e-9, sd, 1.0),
                         rng.normal(size=(d, features)) / (width * np.sqrt(d)), rng.uniform(0, 2 * np.pi, features),
                         np.zeros(features + 1))
    size = features + 1
    tri = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            if b.num_rows:
                f, y = model.features(_batch(b, 0)), b.column(1).to_numpy()
                a, c, n = a + f.T @ f, c + f.T @ y, n + b.num_rows
        if n:
            v = np.concatenate([a[tri], c, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["cell", "v"])

    cells = train.filter("part").select("x", "y").mapInArrow(sums, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    v = np.zeros(len(tri[0]) + size + 1)
    got = cells.toPandas()
    v[got["cell"].to_numpy()] = got["v"].to_numpy()
    a = np.zeros((size, size))
    a[tri] = v[:len(tri[0])]
    a = a + np.triu(a, 1).T
    n = v[-1]
    if n:
        penalty = ridge * n / features * np.eye(size)
        penalty[-1, -1] = 1e-9 * n
        model.beta = np.linalg.solve(a + penalty, v[len(tri[0]):-1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = model.raw(_batch(b, 0)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.round(r * 1000), -500, 1500).astype(np.int32)), b.column(1)],
                                             names=["bin", "y"])

    rest = train.filter("not part") if train.filter("not part").limit(1).count() else train
    bins = rest.select("x", "y").mapInArrow(raw, "bin int, y double").groupBy("bin") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.knots = isotonic(np.array([r.bin / 1000 for r in bins]), np.array([r.n for r in bins], float),
                           np.array([r.y for r in bins], float))
    return model


def score(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id_col, ``__ll_score``) of every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.score(_batch(b, 1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, f"{TMP}score"])

    return stats.mapInArrow(run, T.StructType([T.StructField(id_col, stats.schema["id"].dataType),
                                               T.StructField(f"{TMP}score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", mod: int = 4, out: int = 2) -> DataFrame:
    """(id_col, ``__ll_score``): one row per row of ``docs``. Null texts count
    as empty, ids may be null or repeat, an empty table gives an empty one."""
    prepare(docs.sparkSession)
    stats = cut(with_statistics(docs, id_col, text_col))
    return score(stats, fit(stats, labels, id_col, label_col, mod, out), id_col)
