"""The pipeline's stages and the registered queries on the given tables."""

from __future__ import annotations

import math
import os
import re

import duckdb
import numpy as np
import pytest
from helpers import docs, empty
from pyspark.sql import functions as F
from test_decontamination import brute as leaks_of
from test_mixing import brute as mixture_of
from test_pii import brute as spans_of
from test_simhash import brute_components

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from lakeloom.llm import queries as q
from lakeloom.llm import toxicity
from tools.check_oracle import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_every_operator_is_registered():
    names = set(queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(cols) == sorted(df.columns) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(cols, want)


def plain_score(text: str | None, model) -> float:
    """A document's toxicity by forward and backward over all its tokens."""
    words = re.findall(r"\w+", text or "")
    emit, at = [], []
    for i, w in enumerate(words):
        w = w.lower()
        fs = [model.lexicon[f] for f in ["=" + w, *("^" + w[:k] for k in range(3, 9) if len(w) >= k)] if f in model.lexicon]
        emit.append(model.bias + sum(model.weights[f] for f in fs))
        at += [i] * bool(fs)
    n, tr = len(words), model.trans
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    for i in range(n):
        for y in (0, 1):
            before = 0.0 if i == 0 else np.logaddexp(alpha[i - 1, 0] + tr[0, y], alpha[i - 1, 1] + tr[1, y])
            alpha[i, y] = before + y * emit[i]
    for i in range(n - 2, -1, -1):
        for y in (0, 1):
            beta[i, y] = np.logaddexp(beta[i + 1, 0] + tr[y, 0], beta[i + 1, 1] + tr[y, 1] + emit[i + 1])
    p = [1 / (1 + math.exp(min(500, alpha[i, 0] + beta[i, 0] - alpha[i, 1] - beta[i, 1]))) for i in at]
    s = sum(p)
    x = model.link @ np.array([1.0, math.log1p(s), max(p, default=0.0), 100 * s / (n + 20)])
    return 1 / (1 + math.exp(-x))


def test_stages(spark, work):
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    names, cols = [n for n, _ in corpus_pipeline.STAGES], whole.columns
    assert names == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "source mixing"]
    out = [whole]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{work}/{k}")
        out.append(spark.read.parquet(f"{work}/{k}"))
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in out]
    assert all(df.columns == cols for df in out[:-1]) and set(cols) < set(out[-1].columns)
    # 1: the documents that a plain scorer of the fitted chain rejects go, all others stay.
    model = toxicity.fit(whole, spark.read.parquet(f"{SF}/labels.parquet"), mod=3, out=1)
    scores = {d: plain_score(t, model) for d, t in rows[0]}
    assert all(abs(x - 0.7) > 1e-6 for x in scores.values()) and any(x >= 0.7 for x in scores.values())
    assert sorted(d for d, _ in rows[1]) == sorted(d for d, x in scores.items() if x < 0.7)
    # 2: one document of each component of what is left.
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, _, c in brute_components(rows[1])})
    # 3: documents with a leaked item go.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks_of(rows[2], items)}
    assert bad and sorted(d for d, _ in rows[3]) == sorted(d for d, _ in rows[2] if d not in bad)
    # 4: all stay, no base span is left, the rest of the text is as it was.
    assert sorted(d for d, _ in rows[4]) == sorted(d for d, _ in rows[3])
    before, changed = dict(rows[3]), 0
    for d, t in rows[4]:
        assert spans_of(t) == []
        pieces = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", t)
        assert len(pieces) > 1 or t == before[d]
        at = 0
        for p in pieces:
            at = before[d].index(p, at) + len(p)
        changed += len(pieces) > 1
    assert changed
    assert out[4].filter(F.col("n_chars") != F.length("text")).count() == whole.filter(F.col("n_chars") != F.length("text")).count() == 0
    # 5: each kept document, with its text, as often as the budgets of its source say.
    final = dict(rows[4])
    assert rows[5] and all(final[d] == t for d, t in rows[5])
    kept = [(r.doc_id, r.text, None, r.source) for r in out[4].collect()]
    assert sorted(str((r.doc_id, r.source, r.block)) for r in out[5].collect()) == mixture_of(kept, max_repeats=1.25)


def test_stages_on_awkward_rows(spark, work):
    rows = [(1, None), (1, None), (2, ""), (None, "words without an id " * 9), (3, "a@b.cd " * 4000), (4, "same text here now"), (4, "same text here now"),
            (5, "\x00 \n"), (6, None, None, "s"), (7, "good words of a text " * 30, "en", "s")]
    df = docs(spark, rows, clash=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, SF).write.parquet(f"{work}/{k}")
        df = spark.read.parquet(f"{work}/{k}")
    got = df.collect()
    assert {"mix_block", "n_tokens", "position", "block", "fp"} <= set(df.columns)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) and all("@" not in (r.text or "") for r in got)
    none = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_run_equals_the_stages_one_by_one(spark, work):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, SF).write.parquet(f"{work}/{k}")
        df = spark.read.parquet(f"{work}/{k}")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == df.columns
    a, b = (sorted((tuple(r) for r in x.collect()), key=str) for x in (got, df))
    assert a == b and len(a) > 100
