"""The operators bound to the given tables: one query ``opN_<name>`` each.

Every query reads its whole table and takes (spark, sf_dir). ``ORACLE`` holds
DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.lookups import skew_join

from . import (
    centroids,
    decontamination,
    fingerprints,
    language_id,
    mixing,
    oracle,
    pii,
    quality,
    rules,
    secrets,
    simhash,
    substrings,
    toxicity,
    vector_codes,
)
from .common import TMP, fold, prepare, table

THRESHOLD = 0.7
RISK = {"risk": 0.05, "level": 0.05}


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null where the id is), lang_pred, score."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"), mod=3, out=1)
    return language_id.with_language(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col(f"{TMP}lang").alias("lang_pred"),
        F.col(f"{TMP}score").alias("score"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, end, score, is_secret: every candidate."""
    prepare(spark)
    return secrets.scan(table(spark, sf_dir, "documents")).drop("cand")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, block, position: the mixture of all sources
    with no source over 1.25 times, in as many tokens as the table has."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, max_repeats=1.25).select(
        "doc_id", "source", F.col(f"{TMP}tokens").alias("n_tokens"), F.col(f"{TMP}block").alias("block"),
        F.col(f"{TMP}position").alias("position"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null where the id is), score, predicted."""
    prepare(spark)
    got = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=4, out=2)
    return got.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), F.col(f"{TMP}score").alias("score"),
                      (F.col(f"{TMP}score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null where the id is), score, predicted, spans
    (``start:end``, comma-joined)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), mod=3, out=1)
    got = toxicity.with_toxicity(docs, model)
    return got.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col(f"{TMP}score").alias("score"),
        (F.col(f"{TMP}score") >= THRESHOLD).cast("int").alias("predicted"),
        F.array_join(F.transform(f"{TMP}spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.with_pii(docs, pii.fit(docs), with_text=False)
    names = [f.name for f in pii.ADDED.fields if f.name != f"{TMP}redacted"]
    return got.select("doc_id", *[F.col(n).alias(n.removeprefix(TMP)) for n in names])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item, n_common, containment: every leaked item."""
    prepare(spark)
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                 n=5, threshold=0.8).drop("row_key", "row_key2")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes (of the input), n_removed, n_spans, kept_sha256, spans
    (``start:end``, comma-joined), text: what is left, a cut character replaced,
    and repeated: 1 if any byte was removed, else 0."""
    prepare(spark)
    got = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_bytes=True)
    return got.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept") \
        .withColumn("repeated", (F.col("n_removed") > 0).cast("int"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next."""
    prepare(spark)
    got = fingerprints.against_next(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", "edited_sha256", fingerprints.encode(F.col("fp")).alias("fingerprint"),
                      fingerprints.encode(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    prepare(spark)
    g = simhash.simhash_groups(table(spark, sf_dir, "documents"), n=4, bits=4)
    return g.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    prepare(spark)
    got, books = centroids.cluster(table(spark, sf_dir, "embeddings"), dims=64, scale=64, k=16, rounds=3)
    return centroids.with_inertia(got, books).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept: at most 5 % of any language's good texts lost, at level 0.05."""
    prepare(spark)
    got, _ = rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), **RISK)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    prepare(spark)
    got, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), [F.col("vec_id"), F.col("label")],
                                       dims=64, parts=8, scale=4096, k=16, rounds=6)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # null is a label of its own
    got = got.withColumn(f"{TMP}key", key)
    sums = got.groupBy(F.col(f"{TMP}key").alias(f"{TMP}of")).agg(F.sum(f"{TMP}error").alias("label_error"))
    whole = centroids.digest([x for part in books for e in part for x in e])
    return skew_join(got, sums, [(f"{TMP}key", f"{TMP}of")], salt_by=["vec_id", f"{TMP}code"]).select(
        "vec_id", F.col(f"{TMP}code").alias("code"), F.col(f"{TMP}error").alias("error"), "label_error", F.lit(whole).alias("codebooks_sha256"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mixing": op3_source_mixing,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_pii": op6_pii,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_quality_rules": op12_quality_rules,
    "op13_vector_codes": op13_vector_codes,
}

_SHINGLES = """
 words AS (SELECT id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
           FROM rows),
 grams AS (SELECT id, unnest(CASE WHEN len(w) >= 5
               THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
"""

_UNIT = "CAST('0x' || substr(md5('0:' || {block} || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0"

ORACLE: dict[str, str] = {
    "op3_source_mixing": f"""
WITH docs AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS k FROM documents),
 src AS (SELECT source, sum(k) AS n FROM docs GROUP BY source HAVING sum(k) > 0),
 tot AS (SELECT sum(n) AS total FROM src),
 grid AS (SELECT g.step, source, n, total, pow(n / total, g.step / 1024.0) AS raw
          FROM src, tot, range(0, 1025) AS g(step)),
 fit AS (SELECT step, max(raw / n) / sum(raw) * any_value(total) AS rep FROM grid GROUP BY step),
 best AS (SELECT coalesce(min(step) FILTER (rep <= 1.25 + 1e-9), 1024) AS step FROM fit),
 w AS (SELECT source, n, CAST(floor(raw / sum(raw) OVER () * total + 1e-6) AS BIGINT) AS t
       FROM grid JOIN best USING (step)),
 s AS (SELECT source, n, t, CAST(t // n AS BIGINT) AS full_blocks, t % n AS rest FROM w),
 d AS (SELECT docs.doc_id, docs.source, k, n, t, full_blocks, rest, {_UNIT.format(block="full_blocks")} AS u
       FROM docs JOIN s ON docs.source IS NOT DISTINCT FROM s.source),
 c AS (SELECT *, rest > 0 AND sum(k) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING) <= rest AS more FROM d),
 b AS (SELECT *, unnest(range(0, full_blocks + CAST(more AS BIGINT))) AS block FROM c)
SELECT doc_id, source, k AS n_tokens, block, (block + {_UNIT.format(block="block")}) * n / t AS position FROM b
""",
    "op7_benchmark_decontamination": f"""
WITH b AS (WITH rows AS (SELECT item_id AS id, text FROM benchmark), {_SHINGLES} SELECT * FROM grams),
     short AS (SELECT DISTINCT len(string_split(s, ' ')) AS k FROM b WHERE len(string_split(s, ' ')) < 5),
     d AS (WITH rows AS (SELECT doc_id AS id, text FROM documents), {_SHINGLES} SELECT * FROM grams
           UNION SELECT id, array_to_string(w[i:i + k - 1], ' ') FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, short)),
     n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_common,
       count(*) / any_value(n_item) AS containment
FROM d JOIN b USING (s) JOIN n ON n.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n_item)
""",
    "op11_centroid_clustering": oracle.centroid_clustering(dims=64, scale=64, k=16, rounds=3),
    "op12_quality_rules": oracle.quality_rules(**RISK),
    "op13_vector_codes": oracle.vector_codes(dims=64, parts=8, scale=4096, k=16, rounds=6),
}
