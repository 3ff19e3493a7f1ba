"""Language identification by sparse multinomial logistic regression.

**Features.** Letters are lower-cased and every run of other signs becomes one
space. Character 1-, 2- and 3-grams are hashed into 65,536 features; their
weights are (1 + ln tf) * idf, scaled to length one. Document frequencies come
from all learning documents: each task counts for itself, Spark adds up.

**Training.** A bounded sample of learning documents (``sample_docs`` per
language) is dealt to ``shards`` tasks. Each runs follow-the-regularised-leader
with per-coordinate rates and elastic-net penalties over its share, ``epochs``
times; the shards' weights are averaged.

**Calibration.** On sampled documents that no shard has seen, one temperature
is fitted by golden-section search on the log-loss. The score is the largest
probability at that temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, cut, fold, prepare, unit_hash

DIM = 1 << 16
# Sizes and offsets of the hashed 1-, 2- and 3-grams inside DIM.
_SIZES, _STARTS = (1 << 11, 1 << 14, DIM - (1 << 11) - (1 << 14)), (0, 1 << 11, (1 << 11) + (1 << 14))
UND = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Feature numbers of the n-grams of a text, repeats included; empty if it
    has no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first sign after a letter stays, as a space
    s = np.where(letter, cp, 32)[keep].astype(np.uint64)
    s = np.concatenate([[32], s, [32]] if letter[-1] else [[32], s]).astype(np.uint64)
    out, h = [], np.zeros(len(s), np.uint64)
    for n, (size, start) in enumerate(zip(_SIZES, _STARTS), 1):
        h = h[:len(s) - n + 1] * np.uint64(0x100000001B3) + s[n - 1:]
        x = h * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(((x >> np.uint64(40)) % np.uint64(size)).astype(np.int64) + start)
    return np.concatenate(out)


def tf(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and how often each occurs."""
    if len(ids) < 1500:
        return np.unique(ids, return_counts=True)
    c = np.bincount(ids, minlength=DIM)
    at = np.flatnonzero(c)
    return at, c[at]


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(DIM, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM + 1, 0), np.float32))
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Features and values with a constant at DIM; None without letters."""
        ids = grams(text)
        if not len(ids):
            return None
        at, c = tf(ids)
        v = (1 + np.log(c)) * self.idf[at]
        norm = np.sqrt((v * v).sum())
        return np.append(at, DIM), np.append(v / norm if norm else v, 1.0).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = self.vector(text) if text and self.langs else None
        if x is None:
            return UND, 0.0
        p = softmax((x[1] @ self.weights[x[0]]) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int,
         rate: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal over (features, values, class) rows in the given order."""
    z, n = np.zeros((DIM + 1, n_langs)), np.zeros((DIM + 1, n_langs))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / rate + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for _ in range(epochs):
        for at, v, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p
            g2 = g * g
            z[at] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / rate * w
            n[at] = ni + g2
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray, lo: float = 0.02, hi: float = 20.0) -> float:
    """Golden-section search for the temperature of least log-loss, on a log
    scale; 1 without rows. Targets are smoothed by 1 / (rows + 2), so that a
    sample without errors does not call for certainty."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    eps = 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))
        own = p[np.arange(len(y)), y]
        return float(-((1 - eps) * own + eps * (p.sum(axis=1) - own) / (p.shape[1] - 1)).mean())

    a, b, g = np.log(lo), np.log(hi), (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(40):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = loss(d)
    return float(np.exp((a + b) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Of (text) rows: documents per feature, and documents with a letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for x in b.column(0):
                seen = np.zeros(DIM, bool)
                ids = grams(x.as_py())
                seen[ids] = True
                df += seen
                n += len(ids) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())],
                                         names=["f", "n"])

    rows = docs.mapInArrow(run, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIM, np.int64), 0
    for r in rows:
        if r.f < 0:
            n = r.n
        else:
            df[r.f] = r.n
    return df, n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        mod: int = 3, out: int = 1, sample_docs: int = 1500, shards: int = 4, epochs: int = 3) -> LanguageModel:
    """Learn from text and non-null language of documents outside fold ``out``
    of ``mod``. Without any, the model knows no language."""
    prepare(docs.sparkSession)
    train = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
                        & (fold(id_col, mod) != out)) \
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    model = LanguageModel(sorted(counts))
    if not counts:
        return model
    df, n = document_frequencies(train.select("text"))
    model.idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0).astype(np.float32)
    model.weights = np.zeros((DIM + 1, len(model.langs)), np.float32)
    number = {x: i for i, x in enumerate(model.langs)}
    # One pass samples every language at its own rate; the bounded sample is kept.
    rate = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1.0, sample_docs / c))])
    few = cut(train.filter(unit_hash(F.col("id"), seed=7) < F.element_at(rate, F.col("lang"))).select(
        "text", "lang", unit_hash(F.col("id"), seed=11).alias("u"), F.xxhash64("id", "text").alias("h"),
        F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")))
    empty = model
    langs = len(model.langs)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for text, lang, h, s in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = empty.vector(text)
                if x is not None:
                    parts.setdefault(s, []).append((h, *x, number[lang]))
        for rows in parts.values():
            rows.sort(key=lambda r: r[0])
            w = ftrl([r[1:] for r in rows], langs, epochs)
            at = np.flatnonzero(w.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array(list(w[at] * len(rows)), pa.list_(pa.float64()))], names=["f", "w"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([[float(len(rows))]], pa.list_(pa.float64()))],
                                             names=["f", "w"])

    fitted = few.filter("u >= 0.15").select("text", "lang", "h", "shard").repartition(shards, "shard") \
        .mapInArrow(shard, "f int, w array<double>").collect()
    total = sum(r.w[0] for r in fitted if r.f < 0) or 1.0
    for r in fitted:
        if r.f >= 0:
            model.weights[r.f] += np.array(r.w, np.float32) / np.float32(total)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            zs, ys = [], []
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = model.vector(text)
                if x is not None:
                    zs.append((x[1] @ model.weights[x[0]]).astype(float))
                    ys.append(number[lang])
            yield pa.RecordBatch.from_arrays([pa.array(zs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["z", "y"])

    seen = few.filter("u < 0.15").select("text", "lang").mapInArrow(logits, "z array<double>, y int").collect()
    model.temperature = fit_temperature(np.array([r.z for r in seen]), np.array([r.y for r in seen], int))
    return model


def with_language(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of ``docs``, ``__ll_lang`` and ``__ll_score``.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts if no language was learnt. Repeated rows stay; empty tables too."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(f"{TMP}text"))
    schema = cols.drop(f"{TMP}text").schema.add(f"{TMP}lang", "string").add(f"{TMP}score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.predict(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[*b.schema.names[:-1], f"{TMP}lang", f"{TMP}score"])

    return cols.mapInArrow(run, schema)
