"""Secret scan: candidate strings, and a random forest that removes false ones.

**Candidates** are maximal runs of letters (A-Z), digits and the signs ``+/_-``
with the ``=`` that pad their end; an ``=`` before a value ends the run. Runs of
16 signs or more are candidates unless they repeat one sign that is no digit;
runs of 8 to 15 if they mix letters and digits or come right after ``=`` or
``:``. Shorter runs, and plain words and numbers of 8 to 15 signs elsewhere in a
text, are none. The places come from one split of the text at the candidates:
lengths of pieces and candidates are summed per document.

**Features** (``FEATURES``): length and shares of sign classes; transitions
between classes of neighbouring characters; dictionary coverage, the share of
the candidate's letter 4-grams that occur in words of the corpus; slashes and
the share of real secrets among labelled findings of the same path, of other
folds than the candidate's own, so no label tells of itself; signs and words
next to the candidate.

**Training** takes labelled findings. ``silver_findings`` makes them where
there are none: a candidate given to a name such as ``token`` or ``password``
by ``=`` or ``:`` is real, any other is false. The features that this rule reads
(``RULE_READS``) are then withheld from the forest, so that it judges by what a
candidate looks like: a bare key may score high and a named plain word low, and
the rule's own errors are not learnt back. What stands after a candidate often
goes with the name before it, so half of these training rows have it replaced by
chance values. About ``sample`` findings of each label
train the forest; the dictionary is counted over all documents.

Only DataFrame functions and Spark's own forest are used.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lakeloom.operators.lookups import fits_broadcast

from .common import cut, prepare, sample_by_count

_SIGN = "A-Za-z0-9+/_-"
# All parts are possessive, so linear.
_LONG = rf"(?!([A-Za-z+/_-])\1*+(?![{_SIGN}]))[{_SIGN}]{{16,}}+"
_MIXED = r"(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])"
_SHORT = rf"(?:(?<=[:=][ \t]{{0,4}}[\"'`]?)|{_MIXED})[{_SIGN}]{{8,15}}+(?![{_SIGN}])"
CANDIDATE = rf"(?<![{_SIGN}])(?:{_LONG}|{_SHORT})(?:={{1,2}}+(?![={_SIGN}]))?+"
NAME = r"(?i)(token|secret|passw|api.?key|credential)\w*[^\w]{0,6}$"
GRAM = 4
FEATURES = ("length", "digits", "uppers", "lowers", "signs", "to_digit", "to_letter", "case_change", "vowel_change",
            "letter_pairs", "digit_pairs", "variety", "coverage", "slashes", "path_rate", "named", "assigned", "quoted_before",
            "quoted_after", "word_before", "word_after")
RULE_READS = ("named", "assigned", "quoted_before", "word_before")
FOLDS = 5


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df) else df


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(row, id, path, start, end, cand, before, after): one row per candidate,
    places in code points, end exclusive. ``row`` numbers the input rows. Null
    texts have no candidates; null ids and paths stay null."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), path.alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .filter(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    d = d.select("row", "id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c"),
                 F.split("text", CANDIDATE, -1).alias("s"))
    each = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: F.struct(
        F.get("c", i).alias("cand"), F.right(F.concat(
            F.coalesce(F.get("c", i - 1), F.lit("")), F.get("s", i)), F.lit(40)).alias("before"),
        F.left(F.get("s", i + 1), F.lit(20)).alias("after"), F.length(F.get("s", i)).alias("gap"), F.length(F.get("c", i)).alias("len")))
    d = d.select("row", "id", "path", F.posexplode_outer(each).alias("i", "x")).filter(F.col("x").isNotNull())
    upto = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(upto)
    return d.select("row", "id", "path", (end - F.col("x.len")).alias("start"), end.alias("end"), "x.cand", "x.before", "x.after")


def dictionary(docs: DataFrame, text_col: str = "text", min_count: int = 5) -> DataFrame:
    """(g): the letter 4-grams of words that occur ``min_count`` times or more
    in all texts."""
    w = docs.select(F.explode_outer(F.split(F.lower(text_col), "[^a-z]+")).alias("w")) \
        .filter(F.length("w") >= GRAM).groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_count)
    return w.select(F.explode_outer(_grams("w")).alias("g")).distinct()


def _grams(name: str) -> Column:
    w = F.col(name)
    return F.when(F.length(w) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda i: F.substring(w, i, F.lit(GRAM)))) \
        .otherwise(F.array().cast("array<string>"))


def silver_findings(cands: DataFrame) -> DataFrame:
    """``cands`` with ``label``: 1 if the text before names and assigns a secret."""
    return cands.withColumn("label", F.col("before").rlike(NAME).cast("int"))


def _share(cand: Column, pattern: str) -> Column:
    return F.regexp_count(cand, F.lit(pattern)) / F.length(cand)


def _fold() -> Column:
    """The candidate's fold; equal strings are of one fold."""
    return F.pmod(F.xxhash64("cand"), F.lit(FOLDS)).cast("int")


def path_rates(known: DataFrame, base_rate: float) -> DataFrame:
    """(rpath, rfold, path_rate): per path and fold, the share of label 1 among
    the path's strings of all other folds, drawn to the base rate. Each string
    counts once and the share is rounded to tenths: else the small difference
    between folds, which is made by the fold's own labels, would give these away."""
    known = known.groupBy("path", "cand").agg(F.max("label").alias("label"))
    per = known.groupBy(F.col("path").alias("rpath"), _fold().alias("f")).agg(
        F.sum("label").alias("y"), F.count("label").alias("n"))
    every = per.groupBy("rpath").agg(F.sum("y").alias("ys"), F.sum("n").alias("ns"))
    own = per.select(F.col("rpath").alias("p"), "f", "y", "n")
    all_folds = every.withColumn("rfold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))))
    got = all_folds.join(own, F.col("rpath").eqNullSafe(F.col("p")) & (F.col("rfold") == F.col("f")), "left")
    y, n = F.col("ys") - F.coalesce("y", F.lit(0)), F.col("ns") - F.coalesce("n", F.lit(0))
    return got.select("rpath", "rfold", F.round((y + 10 * base_rate) / (n + 10), 1).alias("path_rate"))


def with_features(cands: DataFrame, grams: DataFrame, rates: DataFrame, base_rate: float) -> DataFrame:
    """``cands`` with the columns ``FEATURES``."""
    c, pairs = F.col("cand"), F.length("cand") - 1
    d = cands.withColumn("letters", F.regexp_replace(F.lower("cand"), "[^a-z]+", " "))
    g = d.select("row", "start", F.explode_outer(F.filter(_grams("letters"), lambda x: ~F.contains(x, F.lit(" ")))).alias("g")) \
        .filter(F.col("g").isNotNull()).join(_small(grams.withColumn("hit", F.lit(1))), "g", "left") \
        .groupBy("row", "start").agg((F.count("hit") / F.count(F.lit(1))).alias("coverage"))
    d = d.join(g, ["row", "start"], "left").join(
        _small(rates), F.col("path").eqNullSafe(F.col("rpath")) & (_fold() == F.col("rfold")), "left").drop("rpath", "rfold", "letters")

    def change(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / pairs

    before = F.col("before")
    cols = {
        "length": F.length(c).cast("double"), "digits": _share(c, "[0-9]"), "uppers": _share(c, "[A-Z]"), "lowers": _share(c, "[a-z]"),
        "signs": _share(c, "[+/_=-]"), "to_digit": change("[A-Za-z](?=[0-9])"), "to_letter": change("[0-9](?=[A-Za-z])"),
        "case_change": change("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_change": change("(?i)[aeiou](?=[a-z&&[^aeiou]])|[a-z&&[^aeiou]](?=[aeiou])"),
        "letter_pairs": change("[A-Za-z](?=[A-Za-z])"), "digit_pairs": change("[0-9](?=[0-9])"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c), "coverage": F.coalesce("coverage", F.lit(0.0)),
        "slashes": F.regexp_count(c, F.lit("/")).cast("double"), "path_rate": F.coalesce("path_rate", F.lit(base_rate)),
        "named": before.rlike("(?i)(key|token|secret|passw|auth|cred)").cast("double"), "assigned": before.rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted_before": before.rlike("[\"'`]$").cast("double"), "quoted_after": F.col("after").rlike("^[\"'`]").cast("double"),
        "word_before": F.length(F.regexp_extract(before, r"(\w*)\W*$", 1)).cast("double"),
        "word_after": F.length(F.regexp_extract("after", r"^\W*(\w*)", 1)).cast("double"),
    }
    return d.withColumns(cols)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
         path_col: str | None = "source", sample: int = 5000, trees: int = 30, depth: int = 6, seed: int = 1) -> DataFrame:
    """(id_col, start, end, cand, score, is_secret): every candidate with the
    forest's probability that it is a real secret, and whether that is 0.5 or more.

    ``findings`` has (start, label) and the ``id_col`` of labelled findings;
    without it, silver labels are used. One that matches no candidate is a row
    without ``end`` and ``cand`` whose score is its label. With labels of one kind only, the score
    is that label; without any, 0. Repeated rows give repeated candidates; null
    texts none; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    cands = cut(candidates(docs, id_col, text_col, path_col))
    if findings is None:
        known = silver_findings(cands)
    else:
        labelled = findings.select(F.col(id_col).alias("id"), "start", "label").dropDuplicates(["id", "start"])
        known = cands.join(labelled, ["id", "start"])
    n = {r.label: r[1] for r in known.groupBy("label").count().collect() if r.label is not None}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    out = [F.col("id").alias(id_col), "start", "end", "cand"]

    def result(d: DataFrame, score: Column) -> DataFrame:
        d = d.select(*out, score.alias("score"), (score >= 0.5).alias("is_secret"))
        if findings is None:
            return d
        label = F.col("label").cast("double")
        return d.unionByName(labelled.filter("label is not null").join(cands, ["id", "start"], "left_anti").select(
            F.col("id").alias(id_col), "start", label.alias("score"), (label >= 0.5).alias("is_secret")), allowMissingColumns=True)

    if not (n0 and n1):
        return result(cands, F.lit(float(n1 > 0)))
    base = n1 / (n0 + n1)
    rates = cut(path_rates(known, base))
    names = [f for f in FEATURES if findings is not None or f not in RULE_READS]
    grams = cut(dictionary(docs, text_col))
    few = sample_by_count(known.filter("label = 1"), n1, sample, "row", "start").unionByName(
        sample_by_count(known.filter("label = 0"), n0, sample, "row", "start"))
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    train = with_features(few, grams, rates, base)
    if findings is None:
        half = F.pmod(F.xxhash64(F.lit(1), F.col("cand")), F.lit(2)) == 0
        for k, (name, many) in enumerate({"quoted_after": 2, "word_after": 13}.items(), 2):
            chance = F.pmod(F.xxhash64(F.lit(k), F.col("cand")), F.lit(many)).cast("double")
            train = train.withColumn(name, F.when(half, chance).otherwise(F.col(name)))
    train = cut(train.select("label", *names))
    # A silver label may be wrong: a leaf for a few rows of their own would learn just that.
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8,
                                    minInstancesPerNode=1 if findings is not None else 10) \
        .fit(assemble.transform(train))
    got = forest.transform(assemble.transform(with_features(cands, grams, rates, base)))
    return result(got, vector_to_array("probability")[1])
