"""Config records, SQL assets, discovery, exports, retention."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from conftest import write_file
from lakeloom.sinks.assets import run_sql_asset
from lakeloom.sinks.exports import export_dictionary, export_latest, notification_rows
from lakeloom.sinks.tables import expire_partitions
from lakeloom.sources.configs import mapper_pairs, sql_asset
from lakeloom.sources.files import discover_assets


def test_sql_asset_record_with_quotes_commas_newlines(spark, work):
    text = ('database_name,table_name,sql_query\n'
            'fleet_db,trips,"SELECT max(km) AS longest, count(*) AS n\nFROM trips\n'
            'WHERE driver <> ""Ada, B."" OR km > 7;"\n')
    write_file(work, "asset/q.csv", text)
    db, table, query = sql_asset(spark, f"{work}/asset")
    assert (db, table) == ("fleet_db", "trips")
    assert query.startswith("SELECT max(km)") and '"Ada, B."' in query and query.endswith(";")
    spark.createDataFrame([("Ada, B.", 3), ("Ada, B.", 8), ("Cem", 5)], "driver string, km int").createOrReplaceTempView("trips")
    name, view = run_sql_asset(spark, db, table, query, location=f"{work}/wh")
    assert name == "trips_asset"  # the query reads its own name
    assert [tuple(r) for r in view.collect()] == [(8, 2)]
    assert spark.catalog.currentDatabase() == "default"


def test_mapper_file_with_comment(spark, work):
    write_file(work, "m/x_mapper_config.csv", "# delivered columns\nfrom,to\na,alpha\n b , b\n")
    assert mapper_pairs(spark, f"{work}/m") == [("a", "alpha"), ("b", "b")]


def test_discovery_skips_readmes_and_nested_mappers(spark, work):
    write_file(work, "sql/README.md", "x")
    write_file(work, "sql/proj_a/orders_sql.csv", "x")
    write_file(work, "sql/proj_a/readme.MD", "x")
    write_file(work, "sql/proj_b/deep/items_sql.csv", "x")
    write_file(work, "mappers/proj_a_mapper_config.csv", "x")
    write_file(work, "mappers/Readme.md", "x")
    write_file(work, "mappers/old/proj_z_mapper_config.csv", "x")
    got = sorted(tuple(r) for r in discover_assets(spark, f"{work}/sql", f"{work}/mappers")
                 .select("kind", "project", "entity").collect())
    assert got == [("mapper", "proj_a", None), ("sql_asset", "deep", "items"), ("sql_asset", "proj_a", "orders")]


KEYS_DDL = ("domain_name string, domain_unit_name string, project_name string, asset_name string, "
            "event_time timestamp, event_id string, columns array<struct<columnIdentifier string, description string>>")


def test_export_dictionary_last_event_wins_and_other_keys_kept(spark, work):
    ts = F.col("event_time")
    rows1 = spark.createDataFrame([
        ("D", "U", "P", "A", None, "1", [("c1", "old")]),
        ("D", "U", "P", "B", None, "2", [("b1", "keep")]),
    ], KEYS_DDL).withColumn("event_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    export_dictionary(rows1, f"{work}/exp")
    rows2 = spark.createDataFrame([
        ("D", "U", "P", "A", None, "3", [("c1", "new"), ("c2", "two")]),
        ("D", "U", "P", "A", None, "4", [("c9", "older")]),
    ], KEYS_DDL).withColumn("event_time", F.when(F.col("event_id") == "3", F.lit("2024-01-03"))
                            .otherwise(F.lit("2024-01-02")).cast("timestamp"))
    export_dictionary(rows2, f"{work}/exp")
    back = spark.read.option("header", "true").csv(f"{work}/exp")
    got = sorted((r.asset_name, r.column_name, r.description) for r in back.collect())
    assert got == [("A", "c1", "new"), ("A", "c2", "two"), ("B", "b1", "keep")]
    assert ts is not None


def test_announced_keys_are_the_folders_written(spark, work):
    rows = spark.createDataFrame([("D#1", "U/2", "P=3 x", "A%é:[b]", None, "1", [("c", "d")]), ("D#1", "U/2", "P=3 x", "gone", None, "2", [("c", "d")])],
                                 KEYS_DDL).withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    export_dictionary(rows, f"{work}/dictionary")
    later = rows.where("asset_name = 'gone'").withColumn("columns", F.expr("filter(columns, x -> false)"))
    export_dictionary(later, f"{work}/dictionary")  # the list became empty
    keys = [r.key for r in notification_rows(rows.withColumn("created", F.col("event_time")), "b").collect()]
    assert all(os.path.isdir(f"{work}/{k}".replace("file:", "")) for k in keys)
    back = spark.read.option("header", "true").csv(f"{work}/dictionary").where("column_name is not null")
    assert [r.asset_name for r in back.collect()] == ["A%é:[b]"]


def test_notification_rows_expiry(spark):
    df = spark.createDataFrame([("D", "U", "P", "A")], "domain_name string, domain_unit_name string, "
                               "project_name string, asset_name string") \
        .withColumn("created", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    r = notification_rows(df, "b").first()
    assert r.key == "dictionary/domain_name=D/domain_unit_name=U/project_name=P/asset_name=A/"
    assert str(r.expires_at) == "2024-01-02 10:00:00"


def test_expire_partitions_managed_table_removes_files(spark, work):
    db = "ret_" + work.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work}/wh/{db}.db'")
    df = spark.createDataFrame([(1, 2024, 1, 1), (2, 2024, 3, 30), (3, 2024, 4, 1)],
                               "id int, year int, month int, day int")
    df.write.partitionBy("year", "month", "day").saveAsTable(f"{db}.t")
    dropped = expire_partitions(spark, f"{db}.t", keep_days=2, now="2024-04-01")
    assert dropped == [{"year": "2024", "month": "1", "day": "1"}]
    assert sorted(r.id for r in spark.table(f"{db}.t").collect()) == [2, 3]
    assert not os.path.exists(f"{work}/wh/{db}.db/t/year=2024/month=1/day=1".replace("file:", ""))


def test_sql_asset_view_is_seen_by_another_session(spark, work):
    dbs = [f"{d}_" + work.rsplit("-", 1)[1] for d in ("one", "two")]
    for i, db in enumerate(dbs):
        spark.sql(f"CREATE DATABASE {db} LOCATION '{work}/wh/{db}.db'")
        spark.createDataFrame([("a", i), ("a", 2)], "k string, n int").write.saveAsTable(f"{db}.src_rows")
        name, _ = run_sql_asset(spark, db, "totals", "SELECT k, sum(n) AS total FROM src_rows GROUP BY k;", location=f"{work}/wh")
        assert name == f"{db}.totals"
    other = spark.newSession()
    assert [other.table(f"{db}.totals").first().total for db in dbs] == [2, 3]


def test_export_latest_keeps_untouched_keys_in_few_folders(spark, work):
    rows = spark.createDataFrame([(i, 1, f"v{i}") for i in range(300)] + [(None, 1, "none")], "k long, t int, v string")
    export_latest(rows, f"{work}/latest", ["k"], ["t"], buckets=4)
    export_latest(spark.createDataFrame([(5, 2, "new"), (5, 3, "newer"), (999, 1, "added")], "k long, t int, v string"),
                  f"{work}/latest", ["k"], ["t"], buckets=4)
    back = {r.k: r.v for r in spark.read.schema("k long, t int, v string").option("header", "true").csv(f"{work}/latest").collect()}
    assert len(back) == 302 and back[5] == "newer" and back[999] == "added" and back[6] == "v6" and back[None] == "none"
    assert len([d for d in os.listdir(f"{work}/latest".replace("file:", "")) if d.startswith("key_bucket=")]) <= 4


def test_sql_asset_published_as_table(spark, work):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n int").createOrReplaceTempView("src_rows")
    db = "pub_" + work.rsplit("-", 1)[1]
    name, df = run_sql_asset(spark, db, "totals", "SELECT k, sum(n) AS total FROM src_rows GROUP BY k;",
                             publish="table", location=f"{work}/wh")
    assert name == f"{db}.totals"
    assert sorted(tuple(r) for r in spark.table(f"{db}.totals").collect()) == [("a", 3), ("b", 5)]


def test_expire_partitions_external_lake_table_deletes_folders(spark, work):
    from lakeloom.plans.ingest import ingest_and_register

    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    db = "ext_" + work.rsplit("-", 1)[1]
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_lake", run_ts="2024-01-01", db_location=f"{work}/wh")
    write_file(work, "src/b.csv", "id,v\n2,y\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_lake", run_ts="2024-06-01", db_location=f"{work}/wh")
    dropped = expire_partitions(spark, f"{db}.t_lake", keep_days=90, now="2024-06-02")
    assert dropped == [{"year": "2024", "month": "1", "day": "1"}]
    assert [r.id for r in spark.table(f"{db}.t_lake").collect()] == [2]  # a typed column
    assert not os.path.exists(f"{lake}/year=2024/month=1/day=1".replace("file:", ""))
    assert os.path.exists(f"{lake}/year=2024/month=6/day=1".replace("file:", ""))


def test_self_named_asset_keeps_one_stable_name(spark, work):
    from lakeloom.sinks.assets import _reads_name

    db = "self_" + work.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work}/wh/{db}.db'")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int").write.saveAsTable(f"{db}.rows")
    for q, want in (("SELECT k FROM rows", 2), ("SELECT k FROM rows WHERE n > 1;", 1), ("SELECT 'x' AS k FROM rows LIMIT 1", 1)):
        name, df = run_sql_asset(spark, db, "rows", q, location=f"{work}/wh")
        assert name == f"{db}.rows_asset" and df.count() == want
    assert sorted(t.name for t in spark.catalog.listTables(db) if not t.isTemporary) == ["rows", "rows_asset"]
    assert _reads_name("select 1 from `rows`", "rows") and _reads_name("select 1 from a join ROWS on 1=1", "rows")
    for q in ("select 'from rows' from t", 'select "rows" from t', "select 1 from t -- rows", "select /* rows */ 1 from t", "select 1 from other_rows", "select 'it''s rows'"):
        assert not _reads_name(q, "rows"), q


def test_rows_of_an_unpartitioned_table_expire(spark, work):
    import pytest

    from lakeloom.sinks.tables import expire_rows

    db = "rows_" + work.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work}/wh/{db}.db'")
    rows = [(1, "2024-01-01 00:00:00", "x"), (2, "2024-03-31 12:00:00", "x"), (3, None, "y"), (4, "no time", "y"), (5, "2024-01-02", "z"), (6, "2023-01-01", "o'k"), (7, "2023-01-01", None)]
    spark.createDataFrame(rows, "id int, at string, kind string").write.partitionBy("kind").saveAsTable(f"{db}.t")
    assert expire_rows(spark, f"{db}.t", "at", keep_days=90, now="2024-04-01") == (f"{db}.t", True)
    assert sorted(r.id for r in spark.table(f"{db}.t").collect()) == [2, 3, 4, 5]  # 90 days before is 2024-01-02
    assert sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {db}.t").collect()) == ["kind=x", "kind=y", "kind=z"]
    spark.createDataFrame(rows, "id int, at string, kind string").drop("kind").write.saveAsTable(f"{db}.u")
    assert expire_rows(spark, f"{db}.u", "at", keep_days=90, now="2024-04-01")[1]
    assert sorted(r.id for r in spark.table(f"{db}.u").collect()) == [2, 3, 4, 5]
    assert expire_rows(spark, f"{db}.t", "at", keep_days=90, now="2024-04-01")[1] is False
    assert [t.name for t in spark.catalog.listTables(db) if not t.isTemporary] == ["t", "u"]
    spark.createDataFrame([(1, "2000-01-01")], "id int, at string").write.option("path", f"{work}/ext").saveAsTable(f"{db}.e")
    with pytest.raises(ValueError, match="no managed table"):
        expire_rows(spark, f"{db}.e", "at")


def test_text_files_are_written_by_the_tasks(spark, work, monkeypatch):
    """No file is renamed by the driver; names and folders may be missing, and
    rows of one name are one file."""
    from lakeloom import standins as si
    from lakeloom.sources import fs

    monkeypatch.setattr(fs, "rename", lambda *a: pytest.fail("renamed by the driver"))
    rows = [("a", "x_sql.csv", "one"), ("a", "x_sql.csv", "two"), (None, "top #1%.csv", "three"), ("b", "y_sql.csv", None), ("b", None, "four")]
    si.stage_text_files(spark, spark.createDataFrame(rows, "d string, f string, v string"), f"{work}/t", "d", "f", "v")
    root = work.replace("file:", "") + "/t"
    got = {os.path.relpath(os.path.join(p, n), root): open(os.path.join(p, n)).read() for p, _, names in os.walk(root) for n in names}
    assert sorted(got.pop("a/x_sql.csv").split()) == ["one", "two"]
    assert got == {"top #1%.csv": "three\n", "b/y_sql.csv": "\n", "b/part-00000.txt": "four\n"}
