"""Quality rules with risk-controlled cutoffs.

**Statistics.** One pass over the texts gives each document's counts (words,
symbols, repeated lines, words in repeated windows and so on). A rule is a ratio
of two counts with a list of possible cutoffs; it fires above its cutoff.

**Base.** Texts with few words, or with many words in repeated windows, fail
whatever the labels say.

**Order of severity.** Labelled texts are split by a digest of the text. On the
first half, every pair of rule and cutoff is scored by how many bad texts it
rejects per good one. Best first, the pairs form nested rule sets: step t rejects
what any of the first t pairs rejects. A document's step is the first that rejects
it. Steps after the one with the most bad texts rejected less good texts rejected
on this half are left out: what they would add is mostly good.

**Risk control.** The second half, the labelled holdout, decides how far down the
steps each stratum may go. Rejecting x of a stratum's n good texts is evidence
against the hypothesis "more than ``risk`` of good texts are rejected" with the
exact p-value P(Bin(n, risk) <= x). Steps are tested in their fixed order and
testing stops at the first that fails, which needs no correction; over the m
strata the level is divided by m (Bonferroni). So with probability 1 - ``level``
or more no stratum loses more than ``risk`` of the good texts that pass the base.
A stratum with too few labelled texts keeps everything that passes the base.

Equal texts of a stratum count once, since copies would be no evidence of their
own, and as good if any label says so.

Only DataFrame functions are used. The statistics are written once; labels,
counts and cutoffs are joined to those small rows, never to the texts. The driver
sees one row per rule and cutoff, and the number of strata.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.operators.lookups import fits_broadcast, skew_join

from .common import TMP, fresh, prepare

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Rules: (counts above and below the line, cutoffs from strict to lenient).
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "word_chars", [0.005, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3]),
    "letterless words": ("n_letterless", "n_words", [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5]),
    "repeated lines": ("n_dup_lines", "n_lines", [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7]),
    "repeated windows": ("n_repeat_words", "n_words", [0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.14, 0.18]),
    "short lines": ("n_lines", "n_words", [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8]),
    "long words": ("word_chars", "n_words", [6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 10.0, 12.0, 15.0]),
    "short words": ("n_words", "word_chars", [0.15, 0.17, 0.19, 0.2, 0.22, 0.24, 0.26, 0.3, 0.4, 0.5]),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letterless"]


def _repeated_words(df: DataFrame, w: str) -> DataFrame:
    """Adds ``n_repeat_words``: words of the array ``w`` inside windows that
    occur twice or more. Window hashes tell texts without any repeat in linear
    time; in the others, windows of equal hash are compared as text."""
    a, b, c = f"{TMP}h", f"{TMP}order", f"{TMP}same"
    word = F.col(w)
    hashes = F.when(F.size(word) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(word) - WINDOW), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)])))
    df = df.withColumn(a, hashes)
    some = F.size(F.array_distinct(a)) < F.size(a)
    df = df.withColumn(b, F.when(some, F.array_sort(F.transform(a, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))

    def twins(name: str, field: str) -> Column:
        return F.filter(name, lambda x, i: (x[field] == F.get(F.col(name), i - 1)[field]) | (x[field] == F.get(F.col(name), i + 1)[field]))

    text = lambda p: F.concat_ws(" ", *[F.get(word, p + k) for k in range(WINDOW)])
    df = df.withColumn(c, F.array_sort(F.transform(twins(b, "h"), lambda x: F.struct(text(x["p"]).alias("s"), x["p"].alias("p")))))
    starts = F.array_sort(F.transform(twins(c, "s"), lambda x: x["p"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda s, p: F.struct(
        (p + WINDOW).alias("end"), (s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n")))["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop(a, b, c)


def text_counts(df: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The ``keep`` columns, ``COUNTS`` (long) and ``base_failed``. Null texts
    count as empty, which fail the base."""
    text, raw, w, lines = F.coalesce(F.col(text_col), F.lit("")), F.col(f"{TMP}text"), f"{TMP}w", f"{TMP}lines"
    df = df.select(*keep, text.alias(f"{TMP}text"))
    bare = F.translate(raw, " \t\n\x0b\f\r", "")
    some = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    df = df.withColumn(w, F.filter(F.split(raw, SPACE), lambda x: x != "")) \
        .withColumn(lines, F.filter(F.split(raw, "\n"), some)) \
        .withColumn("word_chars", F.length(bare)) \
        .withColumn("n_symbols", F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).drop(f"{TMP}text")
    df = _repeated_words(df, w).withColumn("n_words", F.size(w)) \
        .withColumn("n_letterless", F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}")))) \
        .withColumn("n_lines", F.size(lines)).withColumn("n_dup_lines", F.size(lines) - F.size(F.array_distinct(lines)))
    kept = [c for c in df.columns if c not in (w, lines, *COUNTS)]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words").cast("long") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.select(*[f"`{c}`" for c in kept], *[F.col(c).cast("long").alias(c) for c in COUNTS], failed.alias("base_failed"))


def _level(rule: str) -> Column:
    """How many of the rule's cutoffs the document is above."""
    up, low, cuts = RULES[rule]
    value = F.col(up) / F.greatest(F.col(low), F.lit(1))
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda c: c < value))


def design(labelled: DataFrame) -> list[tuple[str, int]]:
    """The pairs (rule, cutoff number) that reject any bad text, best first, by
    bad texts rejected per good text rejected and one, up to the step with the
    most bad less good texts rejected."""
    levels = F.array(*[F.struct(F.lit(i).alias("rule"), _level(r).alias("at")) for i, r in enumerate(RULES)])
    rows = labelled.select("good", F.explode(levels).alias("x")).groupBy("x.rule", "x.at").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect()
    names, pairs = list(RULES), []
    for i, r in enumerate(names):
        for c in range(len(RULES[r][2])):  # cutoff c rejects the texts above more than c cutoffs
            bad = sum(x["bad"] for x in rows if x["rule"] == i and x["at"] > c)
            good = sum(x["good"] for x in rows if x["rule"] == i and x["at"] > c)
            if bad:
                pairs.append((-bad / (good + 1), i, c))
    pairs = [(names[i], c) for _, i, c in sorted(pairs)]
    gains = labelled.groupBy(step(pairs).alias("step")).agg(F.sum(F.when(F.col("good"), -1).otherwise(1)).alias("gain")).collect()
    best, most, total = 0, 0, 0
    for t, gain in sorted((r.step, r.gain) for r in gains if r.step <= len(pairs)):
        total += gain
        if total > most:
            best, most = t, total
    return pairs[:best]


def step(pairs: list[tuple[str, int]]) -> Column:
    """The number (from 1) of the first pair that rejects a document; one more
    than there are pairs if none does."""
    none, firsts = len(pairs) + 1, []
    for r in RULES:
        at = [next((t for t, p in enumerate(pairs, 1) if p == (r, c)), none) for c in range(len(RULES[r][2]))]
        least = [none, *(min(at[:c + 1]) for c in range(len(at)))]
        firsts.append(F.get(F.array(*[F.lit(x) for x in least]), _level(r)))
    return F.least(*firsts)


def _log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z >= 1: Stirling's series for z + 8, brought back."""
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    low = z
    for k in range(1, 8):
        low = low * (z + k)
    return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(low)


def binomial_tail(n: Column, x: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= x); 1 where x is at least n * rate. From the term at x
    downwards, each is the one before times a ratio below 1; the terms left out
    together come to less than 1e-25 of the first."""
    n, x = n.cast("double"), x.cast("double")
    first = F.exp(_log_gamma(n + 1) - _log_gamma(x + 1) - _log_gamma(n - x + 1)
                  + x * F.lit(math.log(rate)) + (n - x) * F.lit(math.log1p(-rate)))
    n_terms = F.least(x, 12 * F.ceil(F.sqrt(x)) + 60).cast("int")
    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * (x - i) * F.lit(1 - rate) / ((n - x + i + 1) * F.lit(rate))
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.when(n_terms > 0, F.aggregate(F.sequence(F.lit(0), n_terms - 1), one, add)["sum"]).otherwise(F.lit(1.0))
    return F.when(x >= n * rate, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))


def cutoffs(holdout: DataFrame, n_steps: int, risk: float, level: float) -> DataFrame:
    """(stratum, n_good, n_rejected, p_value, last_step) from the good texts'
    (stratum, step): the last step whose hypothesis is rejected, 0 if none is."""
    per = holdout.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("k"))
    sizes = per.groupBy("stratum").agg(F.sum("k").alias("n_good"))
    m = max(1, sizes.count())
    # Step 0 rejects nothing; it carries the test that n is large enough.
    per = per.filter(F.col("step") <= n_steps).unionByName(sizes.select("stratum", F.lit(0).alias("step"), F.lit(0).cast("long").alias("k")))
    so_far = W.partitionBy("stratum").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    per = per.withColumn("x", F.sum("k").over(so_far)).join(sizes, "stratum")
    per = per.withColumn("p", binomial_tail(F.col("n_good"), F.col("x"), risk)).withColumn("ok", F.col("p") <= F.lit(level / m))
    return per.groupBy("stratum").agg(
        F.first("n_good").alias("n_good"), F.max(F.when(F.col("ok"), F.col("x"))).alias("n_rejected"),
        F.max(F.when(F.col("ok"), F.col("p"))).alias("p_value"),
        F.greatest(F.lit(0), F.coalesce(F.min(F.when(~F.col("ok"), F.col("step"))) - 1, F.lit(n_steps))).alias("last_step"))


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
             label_col: str = "quality", risk: float = 0.05, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """One row per input row: the id, ``stratum`` (the column as text, empty for
    null), ``COUNTS``, ``base_failed``, ``rule`` (the first that rejects it in
    its stratum, ``base``, or null) and ``kept``; and the ``cutoffs`` table.

    Labels are matched by id, 1 is good, 0 bad, other values and null ids are
    left out. An id labelled or listed several times counts with each text. Null
    and empty texts fail the base. Only the named columns are read. An empty
    table gives an empty result; without labels only the base rejects.
    """
    prepare(docs.sparkSession)
    spark, folder = docs.sparkSession, fresh(docs.sparkSession, "op12-counts")
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))
    stats = text_counts(docs, text_col, [F.col(id_col).alias(f"{TMP}id"), stratum.alias("stratum"), F.md5(F.coalesce(
        F.col(text_col), F.lit("")).cast("binary")).alias(f"{TMP}md5")])
    stats.write.parquet(folder)
    stats = spark.read.schema(stats.schema).parquet(folder)
    marks = labels.select(F.col(id_col).alias(f"{TMP}of"), F.col(label_col).alias(f"{TMP}good")) \
        .filter(F.col(f"{TMP}of").isNotNull() & F.col(f"{TMP}good").isin(0, 1)) \
        .groupBy(f"{TMP}of").agg((F.max(f"{TMP}good") == 1).alias(f"{TMP}good"))
    known = stats.filter(~F.col("base_failed")).join(marks, F.col(f"{TMP}id") == F.col(f"{TMP}of")) \
        .groupBy("stratum", f"{TMP}md5").agg(F.max(f"{TMP}good").alias("good"), *[F.first(c).alias(c) for c in COUNTS])
    known = known.checkpoint()
    first_half = F.substring(f"{TMP}md5", 1, 1) < "8"
    pairs = design(known.filter(first_half))
    limits = cutoffs(known.filter(~first_half & F.col("good")).select("stratum", step(pairs).alias("step")),
                     len(pairs), risk, level).checkpoint()
    ends = limits.select(F.col("stratum").alias(f"{TMP}s"), F.col("last_step").alias(f"{TMP}last"))
    got = skew_join(stats.withColumn(f"{TMP}step", step(pairs)), ends, [("stratum", f"{TMP}s")], "left", salt_by=[f"{TMP}md5", f"{TMP}id"])
    hit = F.col(f"{TMP}step") <= F.coalesce(F.col(f"{TMP}last"), F.lit(0))
    names = F.array(*[F.lit(r) for r, _ in pairs]) if pairs else F.array().cast("array<string>")
    rule = F.when(F.col("base_failed"), F.lit("base")).when(hit, F.get(names, F.col(f"{TMP}step") - 1))
    return got.select(F.col(f"{TMP}id").alias(id_col), "stratum", *COUNTS, "base_failed", rule.alias("rule"),
                      (~F.col("base_failed") & ~hit).alias("kept")), limits
