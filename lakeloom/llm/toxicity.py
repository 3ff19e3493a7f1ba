"""Toxic spans and document scores by a linear-chain conditional random field.

**Labelled tokens.** Labels mark whole documents. Over all labelled learning
documents Spark counts in how many toxic and clean documents each word occurs,
and sums that by word start (3 to 8 letters). A group of near copies (SimHash
components) counts as one document of each of its labels, which holds every
word of the group. All words and starts that speak clearly for toxic documents
form the feature lexicon, which grows with the vocabulary; a token of a toxic
document that carries such a feature is labelled toxic, every other token clean.
Starts that no other word continues (their counts equal those of a longer start
or of the word) make a chain, one row of the lexicon with one weight, which a
token counts once for each feature of the chain that it carries.

**Model.** Two labels, a bias, one weight per lexicon feature and a 2 x 2
transition table, fitted by gradient ascent on the log-likelihood of token
sequences from a bounded sample of learning documents (``sample_docs`` per
class, one of each group of near copies). The expectations come from
forward-backward over the sequences. A feature that no sampled document holds
gets the weight that the fitted features have at its log odds (least squares).

**Scores.** Forward-backward marginals of the toxic label give the offending
spans (marginal of 0.5 or more). Their sum, maximum and share of the document
enter a logistic link, fitted on the sample with the classes weighted back to
their shares. Tokens without lexicon features all have the same potential, so
a run of them is a power of one 2 x 2 matrix; forward-backward visits the
tokens with features and is exact.

**Size.** A lexicon of at most ``max_lexicon`` chains (and 64 MiB) is broadcast.
A larger one stays a table: its part that the sample's words carry is fitted,
the other weights are computed in Spark, and scoring joins the distinct words of
the texts with it. Both ways give the same scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lakeloom.operators.lookups import DEFAULT_BROADCAST_ROWS, fits_broadcast, skew_join

from . import simhash
from .common import TMP, cut, fold, prepare, sample_by_count

WORD = re.compile(r"\w+")
STARTS = range(3, 9)
SEQ = 128
_CACHE = 300_000

SCORED = T.StructType([
    T.StructField(f"{TMP}score", T.DoubleType()),
    T.StructField(f"{TMP}spans", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("p", T.DoubleType())]))),
])


class Lexicon(Mapping):
    """Features ("^start" and "=word") to rows of the weights. A chain is kept as
    its shortest feature with its row and its longest feature."""

    def __init__(self, chains: Iterable[tuple[str, str]] = ()):
        self.chains = {first: (row, last) for row, (first, last) in enumerate(chains)}

    def features(self, first: str) -> list[str]:
        """All features of one chain."""
        last = self.chains[first][1]
        if first[0] == "=":
            return [first]
        starts = [last[1:k + 1] for k in range(len(first) - 1, min(STARTS[-1], len(last) - 1) + 1)]
        return ["^" + x for x in starts] + [last] * (last[0] == "=")

    def carried(self, word: str) -> list[int]:
        """The rows of a lower-cased token, one for each feature it carries."""
        got = [self.chains["=" + word][0]] if "=" + word in self.chains else []
        for k in STARTS:
            row, last = self.chains.get("^" + word[:k], (0, "")) if len(word) >= k else (0, "")
            if last:
                common = min(len(commonprefix((word, last[1:]))), STARTS[-1])
                got += [row] * (common - k + 1 + (last == "=" + word))
        return got

    def __getitem__(self, feature: str) -> int:
        for first in (feature, *("^" + feature[1:k + 1] for k in STARTS if k < len(feature))):
            if first in self.chains and feature in self.features(first):
                return self.chains[first][0]
        raise KeyError(feature)

    def __iter__(self) -> Iterator[str]:
        return (f for first in self.chains for f in self.features(first))

    def __len__(self) -> int:
        return sum(len(self.features(first)) for first in self.chains)


@dataclass
class ToxicityModel:
    """``lexicon`` maps "=word" and "^start" to a row of ``weights``. A lexicon
    above the bound is in ``table`` (first, last, weight), and ``lexicon`` is
    empty."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    link: np.ndarray | None = None  # of (1, log1p(sum), max, share)
    base: float = 0.0  # score when nothing could be learnt
    table: DataFrame | None = None


# -- learning ---------------------------------------------------------------

def learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                  label_col: str, mod: int, out: int) -> DataFrame:
    """(id, h, y, root): labelled documents outside the held-out fold, one per
    distinct text (hash ``h``); near copies share ``root``. Repeated labels of
    one id count as toxic if any does."""
    y = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, mod) != out)) \
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    d = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, mod) != out))
    d = simhash.with_fingerprint(d, text_col, [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")], 4)
    d = cut(d.join(y, "id").groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y"), F.first("fp").alias("fp")))
    return d.join(simhash.near_components(d.select("fp").distinct(), 4), "fp").select("id", "h", "y", "root")


def feature_names(word: Column) -> Column:
    """The features a lower-cased word can carry: itself and its starts."""
    starts = F.transform(F.sequence(F.lit(STARTS[0]), F.least(F.length(word), F.lit(STARTS[-1]))),
                         lambda k: F.concat(F.lit("^"), F.substring(word, F.lit(1), k)))
    return F.concat(F.array(F.concat(F.lit("="), word)),
                    F.when(F.length(word) >= STARTS[0], starts).otherwise(F.array().cast("array<string>")))


def build_lexicon(rows: DataFrame, n_toxic: int, n_clean: int,
                  min_docs: int, min_odds: float, min_g2: float) -> DataFrame:
    """Chains (first, last, o, g2) of the features of (text, y, root) rows that
    speak for y = 1: shortest and longest feature, log odds, likelihood ratio
    of their toxic and clean documents. Rows alike in y and root count as one
    document, rows without root as one each. Words are grouped once; their
    starts are sums of words."""
    words = rows.select("y", "root", F.explode_outer(F.array_distinct(
        F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("w")).filter("w != ''")
    words = words.groupBy("w", "root", "y").agg(F.count(F.lit(1)).alias("k")) \
        .withColumn("k", F.when(F.col("root").isNull(), F.col("k")).otherwise(1))
    words = words.groupBy("w").agg(F.sum(F.col("k") * F.col("y")).alias("t"), F.sum(F.col("k") * (1 - F.col("y"))).alias("c"))
    counts = words.select("t", "c", F.explode_outer(feature_names(F.col("w"))).alias("f")).groupBy("f") \
        .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).filter(F.col("t") >= min_docs)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    share = n_toxic / (n_toxic + n_clean)
    n = F.col("t") + F.col("c")
    g2 = 2 * (F.col("t") * F.log(F.col("t") / (n * share))
              + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    best = counts.withColumn("o", odds).withColumn("g2", g2).filter((F.col("o") >= min_odds) & (F.col("g2") >= min_g2))
    # In the order of their letters, features of equal counts that continue one
    # another stand together: nothing between two of them has other words.
    best = best.withColumn("s", F.expr("substring(f, 2)")).withColumn("p", F.substring("s", 1, STARTS[0]))
    near = W.partitionBy("p", "t", "c").orderBy("s", F.col("f").desc())
    before = F.lag("f").over(near)
    follows = before.startswith("^") & F.col("s").startswith(F.substring(before, F.lit(2), F.length(before)))
    best = best.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("chain", F.sum("new").over(near))
    size = F.struct(F.length("s"), F.col("f").startswith("="))
    return best.groupBy("p", "t", "c", "chain").agg(
        F.min_by("f", size).alias("first"), F.max_by("f", size).alias("last"), F.max("o").alias("o"), F.max("g2").alias("g2")) \
        .select("first", "last", "o", "g2")


def odds_line(w: np.ndarray, odds: np.ndarray) -> tuple[float, float, float, float]:
    """Intercept and slope of the line through the (odds, weight) points, and
    their least and greatest weight; zeros without points."""
    if not len(w):
        return 0.0, 0.0, 0.0, 0.0
    slope = ((odds - odds.mean()) @ (w - w.mean())) / max(((odds - odds.mean()) ** 2).sum(), 1e-9)
    return float(w.mean() - slope * odds.mean()), float(slope), float(w.min()), float(w.max())


def _words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` and the distinct lower-cased tokens (``words``) of each row."""
    kept = df.select(*keys, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted({w.lower() for w in WORD.findall(x.as_py() or "")}) for x in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keys)], pa.array(got, pa.list_(pa.string()))], names=[*keys, "words"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:len(keys)], T.StructField("words", T.ArrayType(T.StringType()))]))


def _sequences(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(text, y) rows -> one row per document: its sequences of feature rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, ns, pos, feats = [], [], [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = WORD.findall(text)
                hits = [(i, f) for i, w in enumerate(words) for f in lexicon.carried(w.lower())]
                ys.append(y)
                ns.append(len(words))
                pos.append([i for i, _ in hits])
                feats.append([f for _, f in hits])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(ns, pa.int32()),
                                              pa.array(pos, pa.list_(pa.int32())), pa.array(feats, pa.list_(pa.int32()))],
                                             names=["y", "n", "pos", "feat"])
    return df.select("text", "y").mapInArrow(run, "y int, n int, pos array<int>, feat array<int>")


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Padded (time, sequence) potentials of label 1 -> marginals of label 1,
    expected transitions, log-likelihood normaliser."""
    steps, n = emit.shape
    e, tr = np.exp(emit), np.exp(trans)
    alpha, scale = np.empty((steps, 2, n)), np.ones((steps, n))
    a = np.vstack([np.ones(n), e[0]])
    for t in range(steps):
        if t:
            a = np.vstack([a[0] * tr[0, 0] + a[1] * tr[1, 0], (a[0] * tr[0, 1] + a[1] * tr[1, 1]) * e[t]])
        live = t < length
        s = np.where(live, a.sum(0), 1.0)
        a = np.where(live, a / s, alpha[t - 1] if t else a)
        alpha[t], scale[t] = a, s
    marg, exp_tr = np.zeros((steps, n)), np.zeros((2, 2))
    beta = np.ones((2, n))
    for t in range(steps - 1, -1, -1):
        p = alpha[t] * beta
        marg[t] = np.where(t < length, p[1] / p.sum(0), 0)
        if t:
            # beta is 1 until the sequence's last token
            w = np.vstack([beta[0], beta[1] * e[t]]) / scale[t]
            live = t < length
            for i in (0, 1):
                for j in (0, 1):
                    exp_tr[i, j] += (alpha[t - 1][i] * tr[i, j] * w[j] * live).sum()
            beta = np.where(live, np.vstack([tr[0, 0] * w[0] + tr[0, 1] * w[1], tr[1, 0] * w[0] + tr[1, 1] * w[1]]), 1.0)
    return marg, exp_tr, float(np.log(scale).sum())


def fit_chain(docs: list[tuple[int, int, np.ndarray, np.ndarray]], n_features: int,
              rounds: int = 80, l2: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions from (y, n, pos, feat) documents."""
    length, seq_of, t_of, feat, gold = [], [], [], [], []
    for y, n, pos, fs in docs:
        first = len(length)
        length += [min(SEQ, n - lo) for lo in range(0, n, SEQ)]
        seq_of.append(first + pos // SEQ)
        t_of.append(pos % SEQ)
        feat.append(fs)
        gold.append(np.full(len(pos), y))
    if not length:
        return np.zeros(n_features), 0.0, np.zeros((2, 2))
    length = np.array(length)
    seq_of, t_of, feat = (np.concatenate(x).astype(np.int64) for x in (seq_of, t_of, feat))
    y = np.zeros((SEQ, len(length)))
    y[t_of, seq_of] = np.concatenate(gold)
    live = np.arange(SEQ)[:, None] < length
    pair = live[1:]
    seen_tr = np.array([[((y[:-1] == i) & (y[1:] == j) & pair).sum() for j in (0, 1)] for i in (0, 1)], float)
    seen_f = np.bincount(feat, weights=y[t_of, seq_of], minlength=n_features)
    total = float(length.sum())
    theta = np.concatenate([np.zeros(n_features), [-2.0], np.zeros(4)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, bias, trans = theta[:n_features], theta[n_features], theta[n_features + 1:].reshape(2, 2)
        emit = np.full(y.shape, bias)
        np.add.at(emit, (t_of, seq_of), w[feat])
        marg, exp_tr, _ = forward_backward(emit, length, trans)
        g = np.concatenate([seen_f - np.bincount(feat, weights=marg[t_of, seq_of], minlength=n_features),
                            [(y - marg)[live].sum()], (seen_tr - exp_tr).ravel()])
        # Counts of a feature, not of all tokens, set its step: Adam is free of scale.
        g -= l2 * theta * np.sqrt(total)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.2 * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return theta[:n_features], float(theta[n_features]), theta[n_features + 1:].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * beta * (np.arange(len(beta)) > 0)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", mod: int = 3, out: int = 1, sample_docs: int = 1000,
        min_docs: int = 4, min_odds: float = 1.5, min_g2: float = 18.0,
        max_lexicon: int = DEFAULT_BROADCAST_ROWS) -> ToxicityModel:
    """Learn from labelled documents outside fold ``out`` of ``mod``.

    Word counts cover all of them and every feature that passes ``min_docs``,
    ``min_odds`` and ``min_g2`` is used; the field is fitted on about
    ``sample_docs`` documents of each class. Only a lexicon of at most
    ``max_lexicon`` chains reaches the driver whole; of a larger one, the chains
    that the sample carries. Without labelled documents of both classes there
    are no spans, and every score is the share of toxic labels (0 if none).
    """
    prepare(docs.sparkSession)
    rows = cut(learning_rows(docs, labels, id_col, text_col, label_col, mod, out))
    groups = cut(rows.groupBy("root", "y").agg(F.min(F.struct("id", "h")).alias("one"), F.count(F.lit(1)).alias("k")))
    n = dict(groups.groupBy("y").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not (n1 and n0):
        return ToxicityModel(base=float(n1 > 0))
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, mod) != out)) \
        .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    copied = groups.filter("k > 1").select(F.col("root").alias("r"), F.col("y").alias("ry"))
    train = skew_join(rows, copied, [("root", "r"), ("y", "ry")], "left").select("id", "h", "y", F.col("r").alias("root"))
    chains = cut(build_lexicon(texts.join(train, ["id", "h"]), n1, n0, min_docs, min_odds, min_g2))
    ones = groups.select("one.id", "one.h", "y")
    few = sample_by_count(ones.filter("y = 1"), n1, sample_docs, "id").unionByName(
        sample_by_count(ones.filter("y = 0"), n0, sample_docs, "id"))
    sample = texts.join(few, ["id", "h"]).dropDuplicates(["id", "h"])
    small = fits_broadcast(chains, max_lexicon)
    near = chains if small else chains.join(
        _words(sample, [], "text").select(F.explode_outer("words").alias("w")).distinct()
        .select(F.explode_outer(feature_names(F.col("w"))).alias("first")).distinct(), "first", "left_semi")
    lex = sorted(near.collect(), key=lambda r: (-r["g2"], r["first"]))
    lexicon = Lexicon((r["first"], r["last"]) for r in lex)
    rows = [(r.y, r.n, np.array(r.pos, np.int64), np.array(r.feat, np.int64)) for r in _sequences(sample, lexicon).collect()]
    w, bias, trans = fit_chain(rows, len(lex))
    odds = np.array([r["o"] for r in lex], float)
    seen = np.bincount(np.concatenate([feat for *_, feat in rows]), minlength=len(lex)) > 0 if rows else np.zeros(len(lex), bool)
    icpt, slope, low, high = odds_line(w[seen], odds[seen])
    w = np.where(seen, w, np.clip(icpt + slope * odds, low, high))
    model = ToxicityModel(lexicon, w, bias, trans, None, n1 / (n1 + n0))
    x, y = [], []
    for label, length, pos, feat in rows:
        at, inv = np.unique(pos, return_inverse=True)
        x.append(_summary(_marginals(at, bias + np.bincount(inv, weights=w[feat], minlength=len(at)), length, model), length))
        y.append(label)
    y = np.array(y, float)
    if 0 < y.sum() < len(y):
        share = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum())) * len(y) / (n1 + n0)
        model.link = _logistic(np.array(x), y, share)
    if not small:
        fitted = docs.sparkSession.createDataFrame([(r["first"], float(v)) for r, v in zip(lex, w)], "first string, fitted double")
        line = F.greatest(F.lit(low), F.least(F.lit(high), F.lit(icpt) + F.lit(slope) * F.col("o")))
        model.table = cut(chains.join(fitted, "first", "left").select("first", "last", F.coalesce("fitted", line).alias("weight")))
        model.lexicon, model.weights = Lexicon(), np.zeros(0)
    return model


# -- scoring ----------------------------------------------------------------

def _marginals(at: np.ndarray, emit: np.ndarray, n: int, model: ToxicityModel) -> np.ndarray:
    """Marginals of label 1 at the tokens ``at`` of a chain of ``n`` tokens;
    all other tokens have the bias as potential."""
    if not len(at):
        return np.zeros(0)
    tr, eb = np.exp(model.trans), np.exp(model.bias)
    plain = tr * np.array([1.0, eb])  # one step into a token without features
    val, vec = np.linalg.eig(plain)
    inv = np.linalg.inv(vec)
    val = val / np.abs(val).max()

    def power(k: int) -> np.ndarray:
        return np.real((vec * val ** k) @ inv)

    e = np.exp(np.clip(emit, -30, 30))
    alphas = np.empty((len(at), 2))
    a, prev = None, -1
    for i, p in enumerate(at):
        gap = p - prev - 1
        if a is None:
            a = np.array([1.0, e[i]]) if p == 0 else (np.array([1.0, eb]) @ power(gap - 1)) @ tr * [1.0, e[i]]
        else:
            a = (a @ power(gap)) @ tr * [1.0, e[i]]
        a = a / a.sum()
        alphas[i], prev = a, p
    out = np.empty(len(at))
    b = power(n - 1 - at[-1]) @ np.ones(2)
    for i in range(len(at) - 1, -1, -1):
        p = alphas[i] * b
        out[i] = p[1] / p.sum()
        if i:
            b = power(at[i] - at[i - 1] - 1) @ (tr @ (b * [1.0, e[i]]))
            b = b / b.sum()
    return out


def _summary(p: np.ndarray, n: int) -> np.ndarray:
    s = p.sum()
    return np.array([1.0, np.log1p(s), p.max() if len(p) else 0.0, 100 * s / (n + 20)])


def emissions(model: ToxicityModel) -> Callable[[str], float]:
    """The potential of a token; nan if it carries no feature."""
    cache: dict[str, float] = {}

    def of(word: str) -> float:
        e = cache.get(word)
        if e is None:
            if len(cache) >= _CACHE:
                cache.clear()
            fs = model.lexicon.carried(word.lower())
            e = cache[word] = float(model.weights[fs].sum() + model.bias) if fs else np.nan
        return e

    return of


def score_text(text: str, model: ToxicityModel, of: Callable[[str], float]) -> tuple[float, list[dict]]:
    """Score and offending spans (code points, end exclusive) of one text;
    ``of`` gives the potentials of its tokens."""
    if model.link is None:
        return model.base, []
    words = WORD.findall(text)
    at, emit = [], []
    for i, w in enumerate(words):
        e = of(w)
        if e == e:
            at.append(i)
            emit.append(e)
    p = _marginals(np.array(at, np.int64), np.array(emit), len(words), model)
    score = float(1 / (1 + np.exp(-np.clip(_summary(p, len(words)) @ model.link, -30, 30))))
    hot = {a: x for a, x in zip(at, p) if x >= 0.5}
    spans: list[dict] = []
    if hot:
        last = -2
        for i, m in enumerate(WORD.finditer(text)):
            if i in hot:
                if i == last + 1:
                    spans[-1]["end"], spans[-1]["p"] = m.end(), max(spans[-1]["p"], float(hot[i]))
                else:
                    spans.append({"start": m.start(), "end": m.end(), "p": float(hot[i])})
                last = i
    return score, spans


def word_weights(vocabulary: DataFrame, chains: DataFrame) -> DataFrame:
    """(word, e): of the distinct lower-cased words ``w``, those that carry
    features of ``chains`` (first, last, weight), with their summed weights."""
    w, last = F.col("w"), F.col("last")
    low = F.length("first") - 1
    common = F.filter(F.sequence(low, F.least(F.lit(STARTS[-1]), F.length(w), F.length(last) - 1)),
                      lambda k: F.substring(w, F.lit(1), k) == F.substring(last, F.lit(2), k))
    times = F.when(F.col("first").startswith("="), F.lit(1)).otherwise(
        F.size(common) + (last == F.concat(F.lit("="), w)).cast("int"))
    keys = vocabulary.select("w", F.explode_outer(feature_names(w)).alias("first"))
    return keys.join(chains, "first").groupBy(w.alias("word")).agg(F.sum(F.col("weight") * times).alias("e"))


def _with_hits(docs: DataFrame, model: ToxicityModel, text_col: str) -> DataFrame:
    """``docs`` and the weights of the words that carry features, by join: the
    words of each distinct text meet the weights, hot words in many tasks; the
    hits go back to the rows by two hashes of the text."""
    keys, text = [f"{TMP}k1", f"{TMP}k2"], F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    salt = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{TMP}row"), F.xxhash64(*salt).alias(f"{TMP}s"),
                       F.xxhash64(text).alias(keys[0]), F.xxhash64(F.lit(1), text).alias(keys[1]))
    pairs = _words(docs.select(F.xxhash64(text).alias(keys[0]), F.xxhash64(F.lit(1), text).alias(keys[1]), text.alias(f"{TMP}text")),
                   keys, f"{TMP}text").dropDuplicates(keys).select(*keys, F.explode_outer("words").alias("w")).filter("w IS NOT NULL")
    pairs = cut(pairs)
    hits = skew_join(pairs, cut(word_weights(pairs.select("w").distinct(), model.table)), [("w", "word")])
    hits = hits.groupBy(*[F.col(k).alias(f"{k}h") for k in keys]).agg(F.map_from_entries(F.collect_list(F.struct("w", "e"))).alias(f"{TMP}hits"))
    got = skew_join(rows, hits, [(k, f"{k}h") for k in keys], "left", salt_by=[f"{TMP}s"])
    return got.select(f"{TMP}row.*", f"{TMP}hits")


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__ll_score`` (0 to 1) and ``__ll_spans`` (start, end in
    code points, p). Null texts count as empty; empty texts get the score of a
    document without toxic tokens. Repeated rows stay repeated, other columns
    pass through, an empty table stays empty."""
    at, k = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *SCORED.fields])
    joined = model.table is not None
    if joined:
        docs = _with_hits(docs, model, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, table=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        of = emissions(model)
        for b in batches:
            if joined:
                hits = (dict(x.as_py() or ()) for x in b.column(k))
                got = [score_text(x.as_py() or "", model, lambda w, h=h: h.get(w.lower(), np.nan) + model.bias)
                       for x, h in zip(b.column(at), hits)]
            else:
                got = [score_text(x.as_py() or "", model, of) for x in b.column(at)]
            spans = pa.array([s for _, s in got], pa.list_(pa.struct(
                [("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array([s for s, _ in got], pa.float64()), spans],
                                             names=[*b.schema.names[:k], f"{TMP}score", f"{TMP}spans"])

    return docs.mapInArrow(run, schema)
