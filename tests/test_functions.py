"""Scalar rules: names (P13–P18), nested forms (P10–P12), stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import names as nm
from lakeloom.functions.nested import asset_summary, column_metadata, pick_form
from lakeloom.functions.stamps import run_clock


def one(spark, expr, value, ddl="s string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("x")).first()["x"]


def test_snake_and_squash_handle_unicode_spaces(spark):
    assert one(spark, nm.snake_name("s"), "Time  Away Data") == "time_away_data"
    assert one(spark, nm.squash_name("s"), "Human Resources\tUnit") == "humanresourcesunit"
    assert one(spark, nm.database_name("s"), "Time Away") == "timeaway_pub_db"


def test_target_name_removes_first_source_only(spark):
    assert one(spark, nm.target_name("s"), "source-a-source-b") == "target-a-source-b"
    assert one(spark, nm.target_name("s"), "Raw-Source-X") == "target-raw-source-x"  # case kept until lower
    assert one(spark, nm.target_name("s"), "line1\nsource-b") == "target-line1\nb"


def test_entity_path_and_composite_id(spark):
    df = spark.createDataFrame([("Central Unit", "Time Off", "timeoff")], "a string, b string, c string")
    assert df.select(nm.entity_path("a", "b", "c")).first()[0] == "centralunit/timeoff/timeoff"
    assert one(spark, nm.composite_id_part("s", 2), "dom|unit|x") == "unit"
    assert one(spark, nm.composite_id_part("s", 5), "dom|unit") == ""


def test_object_path(spark):
    assert one(spark, nm.object_bucket("s"), "s3://bucket/a/b/c.csv") == "bucket"
    assert one(spark, nm.object_key("s"), "s3://bucket/a/b/c.csv") == "a/b/c.csv"
    assert one(spark, nm.object_key("s"), "s3://bucket") == ""


FORMS = "forms array<struct<formName string, content string>>"


def test_pick_form_first_match_and_missing_is_null(spark):
    forms = [("A", '{"summary": "one"}'), ("AssetCommonDetailsForm", '{"summary": "first"}'),
             ("AssetCommonDetailsForm", '{"summary": "second"}')]
    df = spark.createDataFrame([(forms,), ([],), (None,)], FORMS)
    got = [r[0] for r in df.select(asset_summary("forms")).collect()]
    assert got == ["first", None, None]
    assert df.select(pick_form("forms", "Nope")).first()[0] is None


def test_column_metadata_unnests_doubly_encoded_json(spark):
    content = '{"columnsBusinessMetadata": [{"columnIdentifier": "a", "description": "x"}, {"columnIdentifier": "b"}]}'
    df = spark.createDataFrame([([("ColumnBusinessMetadataForm", content)],),
                                ([("ColumnBusinessMetadataForm", '{"columnsBusinessMetadata": []}')],)], FORMS)
    got = df.select(F.explode(column_metadata("forms")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == [("a", "x"), ("b", None)]  # the empty array gives no rows


def test_run_clock_truncates_and_is_utc():
    assert run_clock("2024-03-05T07:08:09.987654") == ("2024-03-05 07:08:09", 1709622489)
    assert run_clock("2024-03-05T08:08:09+01:00") == ("2024-03-05 07:08:09", 1709622489)
