"""Incremental ingest: manifest, modified files, empty runs, crash and retry,
header drift, malformed lines (S1–S3, J1, A1, A5, P1–P3, K1, K2)."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from conftest import write_file
from lakeloom.plans.ingest import SimulatedCrash, ingest, ingest_and_register
from lakeloom.sinks.tables import read_lake_table
from lakeloom.sources import manifest as mf


def rows(spark, lake, cols, layout="ymd", order=("id",)):
    df = read_lake_table(spark, lake, cols, layout=layout)
    return [tuple(r) for r in df.select(*cols, "day").orderBy(*order, "day").collect()]


def test_stamp_and_partitions(spark, work):
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y\n")
    res = ingest(spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state", run_ts="2024-03-05 07:08:09")
    assert res.files == 1 and res.batch_id == 1709622489
    df = read_lake_table(spark, f"{work}/lake", ["id", "v"])
    got = df.select("id", "v", F.date_format("upload_time", "yyyy-MM-dd HH:mm:ss").alias("t"),
                    "year", "month", "day").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "x", "2024-03-05 07:08:09", 2024, 3, 5),
                                       ("2", "y", "2024-03-05 07:08:09", 2024, 3, 5)]
    # unpadded partition folders
    assert os.path.isdir(os.path.join(work.replace("file:", ""), "lake/year=2024/month=3/day=5"))


def test_incremental_modified_and_empty(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    write_file(work, "src/sub/b.csv", "id,v\n2,y\n")  # nested folder is read
    assert ingest(spark, "t", src, lake, state, run_ts="2024-03-05").files == 2
    assert ingest(spark, "t", src, lake, state, run_ts="2024-03-06").files == 0  # empty run
    time.sleep(1.1)
    write_file(work, "src/a.csv", "id,v\n1,x2\n")  # modified in place
    write_file(work, "src/c.csv", "id,v\n3,z\n")
    assert ingest(spark, "t", src, lake, state, run_ts="2024-03-07").files == 2
    assert rows(spark, lake, ["id", "v"]) == [("1", "x", 5), ("1", "x2", 7), ("2", "y", 5), ("3", "z", 7)]
    m = mf.read_manifest(spark, state)
    # every run, the empty one included, closes its batch with one marker row
    assert m.where("path IS NULL AND state = 'committed'").count() == 3
    assert m.where("path IS NOT NULL AND state = 'committed'").count() == 4


def test_header_only_file_gives_no_rows(spark, work):
    write_file(work, "src/a.csv", "id,v\n")
    write_file(work, "src/b.csv", "")  # a zero-byte file is not even listed
    write_file(work, "src/c.csv", "id,v\n1,x\n")
    res = ingest(spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state", run_ts="2024-03-05")
    assert res.files == 2
    assert [r.id for r in read_lake_table(spark, f"{work}/lake", ["id", "v"]).collect()] == ["1"]


def test_header_drift_combines_by_name(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    write_file(work, "src/b.csv", "v,id,w\ny,2,extra\n")  # reordered + extra column
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    assert res.columns == ["id", "v", "w"]
    got = read_lake_table(spark, lake, res.columns).select("id", "v", "w").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "x", None), ("2", "y", "extra")]
    # a later run keeps the known order and appends new names
    write_file(work, "src/c.csv", "z,w,id\nq,w3,3\n")
    res2 = ingest(spark, "t", src, lake, state, run_ts="2024-03-06")
    assert res2.columns == ["id", "v", "w", "z"]


def test_crash_between_write_and_commit_retries_same_batch(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", layout="ymd_batch", stop_after="write")
    # a new file arriving meanwhile is taken after the retry, in a batch of its own
    write_file(work, "src/b.csv", "id,v\n3,z\n")
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch")
    assert res.retried and res.batches[0] == 1709596800 and res.files == 2 and len(res.batches) == 2
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch")
    assert res.files == 0 and not res.retried
    got = read_lake_table(spark, lake, ["id", "v"], layout="ymd_batch").select("id", "day").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", 5), ("2", 5), ("3", 6)]


def test_crash_with_append_layout_is_at_least_once(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", stop_after="write")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06")
    assert read_lake_table(spark, lake, ["id", "v"]).count() == 2  # as the bookmark would


def test_malformed_lines_go_to_rejects(spark, work):
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y,too,many\n3,z\n")
    ingest(spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state", run_ts="2024-03-05",
           rejects_dir=f"{work}/rejects")
    assert sorted(r["id"] for r in read_lake_table(spark, f"{work}/lake", ["id", "v"]).collect()) == ["1", "2", "3"]
    rej = spark.read.parquet(f"{work}/rejects").collect()
    assert [r["line"] for r in rej] == ["2,y,too,many"]


def test_one_drop_equals_many_drops(spark, work):
    """Metamorphic: the same rows ingested in one run or in three runs."""
    lines = [f"{i},{chr(97 + i % 26)}" for i in range(30)]
    for k in range(3):
        write_file(work, f"one/f{k}.csv", "id,v\n" + "\n".join(lines[k::3]) + "\n")
    ingest(spark, "t", f"{work}/one", f"{work}/lake1", f"{work}/s1", run_ts="2024-03-05")
    for k in range(3):
        write_file(work, f"many/f{k}.csv", "id,v\n" + "\n".join(lines[k::3]) + "\n")
        ingest(spark, "t", f"{work}/many", f"{work}/lake2", f"{work}/s2", run_ts=f"2024-03-0{5 + k}")
    a = read_lake_table(spark, f"{work}/lake1", ["id", "v"]).select("id", "v")
    b = read_lake_table(spark, f"{work}/lake2", ["id", "v"]).select("id", "v")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and a.count() == 30


def test_register_table_sees_new_partitions_and_columns(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    db = "test_" + work.rsplit("-", 1)[1]
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_table", run_ts="2024-03-05",
                        db_location=f"{work}/wh")
    write_file(work, "src/b.csv", "id,v,w\n2,y,q\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_table", run_ts="2024-03-06",
                        db_location=f"{work}/wh")
    got = spark.sql(f"SELECT id, w, day FROM {db}.t_table ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, None, 5), (2, "q", 6)]  # id is typed
    # A value that is no number widens the column to text; nothing is lost.
    write_file(work, "src/c.csv", "id,v,w\n2.5,1,q\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_table", run_ts="2024-03-07", db_location=f"{work}/wh")
    assert dict(spark.table(f"{db}.t_table").dtypes)["id"] == "double"
    write_file(work, "src/d.csv", "id,v,w\n007x,1,q\n")
    ingest_and_register(spark, "t", src, lake, state, db, "t_table", run_ts="2024-03-08", db_location=f"{work}/wh")
    assert sorted(r.id for r in spark.table(f"{db}.t_table").collect()) == ["007x", "1", "2", "2.5"]


def test_file_rewritten_after_listing_is_left_for_next_run(spark, work):
    """Rows come only from the listed version of a file; a file changed after
    listing is neither read now nor committed, and the next run takes it whole."""
    from lakeloom.sources import files as src_files

    write_file(work, "src/a.csv", "id,v\n1,x\n")
    write_file(work, "src/b.csv", "id,v\n2,y\n")
    listing = spark.createDataFrame(src_files.list_files(spark, f"{work}/src").collect(),
                                    src_files.LISTING_SCHEMA)
    groups = src_files.header_groups(listing)
    time.sleep(1.1)
    write_file(work, "src/b.csv", "id,v\n2,y2\n3,z\n")  # rewritten after listing
    rows = src_files.listed_versions_only(src_files.csv_scan(spark, groups), listing)
    assert [(r.id, r.v) for r in rows.collect()] == [("1", "x")]


def test_ingest_closes_batch_and_retakes_changed_file(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    m = mf.read_manifest(spark, state)
    # a marker closes the batch; no intent stays open
    assert mf.open_intent(m, "t") is None
    assert m.where("state = 'committed' AND path IS NULL").count() == 1


def test_runs_in_the_same_second_get_distinct_batches(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    r1 = ingest(spark, "t", src, lake, state, run_ts="2024-03-05 07:08:09", layout="ymd_batch")
    write_file(work, "src/b.csv", "id,v\n2,y\n")
    r2 = ingest(spark, "t", src, lake, state, run_ts="2024-03-05 07:08:09", layout="ymd_batch")
    assert r2.batch_id == r1.batch_id + 1 and r2.run_ts == "2024-03-05 07:08:10"
    got = read_lake_table(spark, lake, ["id", "v"], layout="ymd_batch").select("id").collect()
    assert sorted(r.id for r in got) == ["1", "2"]  # the second batch did not replace the first


def test_compressed_csv_files(spark, work):
    import gzip

    path = os.path.join(work.replace("file:", ""), "src", "a.csv.gz")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write("v,id\nx,1\ny,2\n")
    write_file(work, "src/b.csv", "id,v\n3,z\n")
    res = ingest(spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state", run_ts="2024-03-05",
                 glob="*.csv*")
    assert res.files == 2
    got = read_lake_table(spark, f"{work}/lake", res.columns).select("id", "v").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "x"), ("2", "y"), ("3", "z")]


def test_compact_manifest_keeps_state(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    for k in range(3):
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x\n")
        ingest(spark, "t", src, lake, state, run_ts=f"2024-03-0{5 + k}")
    before = mf.read_manifest(spark, state)
    n_before, n_distinct = before.count(), before.distinct().count()
    replaced = mf.compact_manifest(spark, state)
    assert replaced >= 6
    after = mf.read_manifest(spark, state)
    assert after.count() == after.distinct().count() == n_distinct <= n_before
    assert len([f for f in os.listdir(f"{state}/manifest".replace("file:", "")) if f.endswith(".parquet")]) == 1
    # nothing is new after compaction, and the next batch id still moves forward
    assert ingest(spark, "t", src, lake, state, run_ts="2024-03-01").files == 0
    assert read_lake_table(spark, lake, ["id", "v"]).count() == 3


def test_spark_header_fallback_matches_python_probe(spark, work):
    import gzip

    from lakeloom.sources import files as src_files

    write_file(work, "src/a.csv", "id,v\n1,x\n")
    write_file(work, "src/b.csv", '﻿"v","id, with comma",w\r\ny,2,q\r\n')
    path = os.path.join(work.replace("file:", ""), "src", "c.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("w,id\nq,3\n")
    listing = src_files.list_files(spark, f"{work}/src", "*.csv*")
    paths = [r.path for r in listing.collect()]
    py = {r.path: list(r.columns) for r in src_files.probe_headers(listing).collect()}
    sp = {r.path: list(r.columns) for r in src_files.spark_headers(spark, paths).collect()}
    assert py == sp
    assert sorted(map(tuple, sp.values())) == [("id", "v"), ("v", "id, with comma", "w"), ("w", "id")]


def test_one_call_takes_every_file_in_bounded_batches(spark, work):
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    for k in range(5):
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x{k}\n")
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-05", max_files=2)
    assert res.files == 5
    assert len(set(res.batches)) == 3  # distinct batches although the clock was fixed
    got = read_lake_table(spark, lake, ["id", "v"]).select("id").collect()
    assert sorted(r.id for r in got) == ["0", "1", "2", "3", "4"]
