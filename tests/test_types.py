"""Column profiles and registered types."""

from __future__ import annotations

import random

import pytest
from conftest import write_file
from pyspark.sql import functions as F

from lakeloom.operators import profiles as p
from lakeloom.plans.ingest import SimulatedCrash, ingest, ingest_and_register
from lakeloom.sinks.tables import infer_types, register_table
from lakeloom.sources import manifest as mf

CLASS_OF = {
    "0": p.SHORT_WHOLE, "-7": p.SHORT_WHOLE, "123456789012345": p.SHORT_WHOLE, "1234567890123456": p.LONG_WHOLE, "-9223372036854775808": p.LONG_WHOLE,
    "9223372036854775808": p.WIDE_WHOLE, "1" * 38: p.WIDE_WHOLE, "1" * 39: p.TEXT, "007": p.TEXT, "-0": p.TEXT, "+5": p.TEXT, "--5": p.TEXT, " 5": p.TEXT, "5 ": p.TEXT,
    "0.5": p.REAL, "-12.25": p.REAL, "1.50": p.FIXED, "0.30000000000000004": p.REAL, "0.300000000000000040": p.FIXED, "-0.0": p.REAL, "-0.00": p.TEXT, "00.5": p.TEXT, ".5": p.TEXT, "5.": p.TEXT,
    "1.0E10": p.FLOATING, "1e5": p.TEXT, "NaN": p.FLOATING, "Infinity": p.FLOATING, "-Infinity": p.FLOATING, "1.5f": p.TEXT, "1_000": p.TEXT, "1,5": p.TEXT,
    "true": p.BOOL, "True": p.TEXT, "2024-02-29": p.DAY, "2023-02-29": p.TEXT, "2024-2-9": p.TEXT, "2024-01-01 10:00:00": p.TIME, "2024-01-01 10:00:00.5": p.TIME,
    "2024-01-01 10:00:00.50": p.TEXT, "2024-01-01T10:00:00": p.TEXT, "2024-01-01 25:00:00": p.TEXT, "hello": p.TEXT, "١٢": p.TEXT, "12é": p.TEXT, "-": p.TEXT, "": p.TEXT,
}


def test_lexical_classes(spark):
    rows = spark.createDataFrame([(v,) for v in CLASS_OF] + [(None,)], "v string")
    got = {r.v: r.k and p.CLASSES[r.k - 1] for r in rows.select("v", p.lexical_class(F.col("v")).alias("k")).collect()}
    assert got == CLASS_OF | {None: None}


@pytest.mark.parametrize("values, kind", [
    (["00123", "04567"], "STRING"), (["9" * 20, "1"], "DECIMAL(38,0)"), (["+34600111222"], "STRING"), (["1", "2.5"], "DOUBLE"),
    (["1234567890123456", "2.5"], "STRING"), (["1.50", "2.25"], "DECIMAL(38,2)"), (["1.50", "2.5"], "STRING"), (["1.50", "1"], "STRING"), (["1.5", "1.0E10"], "DOUBLE"),
    (["true", "false"], "BOOLEAN"), (["true", "1"], "STRING"), (["2024-01-01"], "DATE"), (["2024-01-01", "2024-01-01 10:00:00"], "STRING"),
    (["2024-01-01 10:00:00"], "TIMESTAMP_NTZ"), ([None], None), (["1", None], "BIGINT"), (["1" * 37 + ".50"], "STRING"), (["x", "1"], "STRING")])
def test_types_of_columns(spark, values, kind):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer_types(rows, ["v"]) == {"v": kind}


def test_every_value_reads_back_as_written(spark, work):
    """Columns of random spellings: whatever the type, the text is the same."""
    rng, pool = random.Random(4), [v for v in CLASS_OF if v.strip() == v and v not in ("", "Infinity", "-Infinity")]
    cols = [f"c{i}" for i in range(24)]
    picks = [rng.sample([v for v in pool if CLASS_OF[v] in kinds], 2) for kinds in
             [[k] for k in (p.SHORT_WHOLE, p.LONG_WHOLE, p.WIDE_WHOLE, p.REAL, p.FIXED, p.TEXT)] * 3 + [[p.TEXT, p.REAL, p.DAY, p.TIME, p.BOOL]] * 6]
    lines = [",".join(cols)] + [",".join('"' + rng.choice(x) + '"' for x in picks) for _ in range(40)]
    write_file(work, "src/a.csv", "\n".join(lines) + "\n")
    db = "types_" + work.rsplit("-", 1)[1]
    ingest_and_register(spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state", db, "t", run_ts="2024-01-01", db_location=f"{work}/wh")
    got = spark.table(f"{db}.t").select([F.col(c).cast("string") for c in cols]).collect()
    assert sorted(",".join(f'"{v}"' for v in r) for r in got) == sorted(lines[1:])
    assert any(f.dataType.simpleString() != "string" for f in spark.table(f"{db}.t").schema if f.name in cols)


def test_profiles_of_batches_add_up(spark, work):
    """Two files in two runs give the same types as both in one run; a crashed
    batch counts once it is retried."""
    parts = ["id,amount,code\n1,5,7\n2,6,8\n", "id,amount,code\n3,2.5,009\n"]
    write_file(work, "src/a.csv", parts[0])
    db = "widen_" + work.rsplit("-", 1)[1]
    args = (spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state")
    ingest_and_register(*args, db, "t", run_ts="2024-01-01", db_location=f"{work}/wh")
    assert mf.column_types(spark, f"{work}/state", "t") == {"id": "BIGINT", "amount": "BIGINT", "code": "BIGINT"}
    write_file(work, "src/b.csv", parts[1])
    with pytest.raises(SimulatedCrash):
        ingest(*args, run_ts="2024-01-02", stop_after="write")
    assert mf.column_types(spark, f"{work}/state", "t")["code"] == "BIGINT"  # not committed
    ingest_and_register(*args, db, "t", run_ts="2024-01-03", db_location=f"{work}/wh")
    want = {"id": "BIGINT", "amount": "DOUBLE", "code": "STRING"}
    assert mf.column_types(spark, f"{work}/state", "t") == want
    assert {f.name: f.dataType.simpleString().upper() for f in spark.table(f"{db}.t").schema if f.name in want} == want
    assert {r.code for r in spark.table(f"{db}.t").collect()} == {"7", "8", "009"}
    assert [t.name for t in spark.catalog.listTables(db)] == ["t"]  # no second entry stays
    # A batch ingested before profiles were kept: the rows themselves are asked.
    mf.append(mf.manifest_rows(mf.file_frame(spark, [("x", 1, 1)]), "t", 7, "2024-01-01 00:00:00", mf.COMMITTED), f"{work}/state")
    assert mf.column_types(spark, f"{work}/state", "t") is None


def test_register_without_profiles_joins_types(spark, work):
    write_file(work, "src/a.csv", "id,v\n1,2024-01-01\n")
    args = (spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state")
    db = "plain_" + work.rsplit("-", 1)[1]
    one = ingest(*args, run_ts="2024-01-01")
    register_table(spark, db, "t", f"{work}/lake", one.columns, db_location=f"{work}/wh", batches=one.batches)
    assert spark.table(f"{db}.t").first().v.isoformat() == "2024-01-01"
    write_file(work, "src/b.csv", "id,v\n99999999999999999999,soon\n")
    two = ingest(*args, run_ts="2024-01-02")
    register_table(spark, db, "t", f"{work}/lake", two.columns, batches=two.batches)
    assert sorted((str(r.id), r.v) for r in spark.table(f"{db}.t").collect()) == [("1", "2024-01-01"), ("99999999999999999999", "soon")]


def test_classes_cost_no_exceptions_and_stay_the_same(spark):
    """Values that look like numbers or times but are none: their class, and no
    parser is asked for one it would refuse with an exception (the plan guards
    every cast by a pattern or a length)."""
    from pyspark.sql import functions as F

    from lakeloom.operators.profiles import CLASSES, lexical_class, profiled

    want = {"5-LOW": "text", "1998-02-06T00:00:00.000000": "text", "007": "text", "-0": "text", "-7": CLASSES[0], "9" * 16: CLASSES[1],
            "9223372036854775808": CLASSES[2], "9" * 39: "text", "1.5": CLASSES[3], "1.50": CLASSES[4], "-0.00": "text", "1.0E10": CLASSES[5],
            "-Infinity": CLASSES[5], "2024-02-29": "date", "2024-02-30": "text", "2024-01-01 00:00:00.5": "timestamp", "2024-01-01 00:00:00.50": "text",
            "true": "true or false", "1\n": "text", "": "text"}
    df = spark.createDataFrame([(v,) for v in want], "v string")
    got = {r.v: CLASSES[r.k - 1] for r in df.select("v", lexical_class(F.col("v")).alias("k")).collect()}
    assert got == want
    rows, metrics = profiled(df.where("v in ('-7', '1.50', '007.5', '1.5')"), ["v"])
    r = rows.agg(*metrics).first()
    assert (r["0_digits"], r["0_low"], r["0_high"], r["0_length"]) == (3, 1, 2, 4)
    seen = lexical_class(F.col("v"))._jc.toString() if hasattr(lexical_class(F.col("v")), "_jc") else ""
    assert "regexp_replace" not in seen.lower()
