"""From raw documents to a training mixture, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes every stage's result as Parquet in the shared folder and
reads it again for the next, so a lost executor costs one stage at most. The
stages before the last return the columns of ``documents``; the last adds
``n_tokens``, ``block`` and ``position`` and repeats rows as the mixture asks.

Models and iterative linking cannot be written in SQL, so there is no
``ORACLE_SQL``; the tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import decontamination, mixing, pii, simhash, toxicity
from lakeloom.llm.common import TMP, fresh, prepare, table
from lakeloom.llm.queries import THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), mod=3, out=1)
    kept = toxicity.with_toxicity(docs, model).filter(F.col(f"{TMP}score") < THRESHOLD)
    return kept.drop(f"{TMP}score", f"{TMP}spans")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id."""
    return simhash.keep_one(docs, n=4, bits=4)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=5, threshold=0.8)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``;
    ``n_chars`` follows the new text."""
    got = pii.with_pii(docs, pii.fit(docs))
    got = got.withColumn("text", F.col(f"{TMP}redacted"))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col(f"{TMP}spans") == "", F.col("n_chars")).otherwise(F.length("text"))
                             .cast(docs.schema["n_chars"].dataType))
    return got.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in which no source repeats over 1.25 times, in as many
    tokens as are left. An added column whose name is taken is called ``mix_``
    and the name."""
    got = mixing.mix(docs, max_repeats=1.25)
    taken = {c.lower() for c in docs.columns}
    added = {"n_tokens": "tokens", "block": "block", "position": "position"}
    return got.select(*[F.col(f"`{c}`") for c in docs.columns],
                      *[F.col(f"{TMP}{c}").alias(f"mix_{name}" if name in taken else name) for name, c in added.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("pii", redact_pii),
    ("source mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    prepare(spark)
    docs, folder = table(spark, sf_dir, "documents"), fresh(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
