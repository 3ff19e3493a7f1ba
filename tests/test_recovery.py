"""Ingest and delivery on awkward input: no row lost, doubled or misplaced, and
no state that a later run cannot leave."""

from __future__ import annotations

import os
import shutil
import time
from pathlib import Path

import pytest
from conftest import write_file

from lakeloom.plans.delivery import deliver_entity
from lakeloom.plans.ingest import SimulatedCrash, ingest, read_increment
from lakeloom.sinks.tables import read_lake_table


def _dirs(work):
    return f"{work}/src", f"{work}/lake", f"{work}/state"


def _rows(spark, lake, cols, layout="ymd"):
    return sorted(tuple(r) for r in read_lake_table(spark, lake, cols, layout=layout).select(*cols).collect())


def test_header_with_spaces_reserved_names_and_case(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id, v ,year,upload_time\n1,x,1999,then\n")
    write_file(work, "src/b.csv", "V,ID\ny,2\n")
    write_file(work, "src/c.csv", "id,ID,\n3,4,5\n")
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    assert res.columns == ["id", "v", "ID_2", "_c2"]
    assert sorted(map(str, _rows(spark, lake, res.columns))) == sorted(map(str, [("1", "x", None, None), ("2", "y", None, None), ("3", None, "4", "5")]))
    assert {r.year for r in read_lake_table(spark, lake, res.columns).collect()} == {2024}
    assert ingest(spark, "t", src, lake, state, run_ts="2024-03-06").files == 0


def test_csv_options_reach_the_header(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id;'v;w'\n1;'p;q'\n")
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-05", csv_options={"sep": ";", "quote": "'"})
    assert res.columns == ["id", "v;w"]
    assert _rows(spark, lake, ["id", "v;w"]) == [("1", "p;q")]


def test_long_header_is_read_whole(spark, work):
    src, lake, state = _dirs(work)
    names = [f"column_{i:06d}_{'x' * 60}" for i in range(20_000)]  # over 1 MiB
    from lakeloom.sources import files as src_files

    write_file(work, "src/a.csv", ",".join(names) + "\n")
    listing = src_files.list_files(spark, src)
    assert [len(h) for h, _ in src_files.header_groups(listing)] == [20_000]


def test_input_that_fails_leaves_no_intent(spark, work, monkeypatch):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    from lakeloom.plans import ingest as plan

    with monkeypatch.context() as m:
        m.setattr(plan.src_files, "csv_scan", lambda *a, **k: (_ for _ in ()).throw(ValueError("bad plan")))
        with pytest.raises(ValueError):
            ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-06")
    assert res.files == 1 and not res.retried and _rows(spark, lake, ["id", "v"]) == [("1", "x")]


def test_source_deleted_after_the_intent(spark, work):
    src, lake, state = _dirs(work)
    path = write_file(work, "src/a.csv", "id,v\n1,x\n")
    write_file(work, "src/b.csv", "id,v\n2,y\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", layout="ymd_batch", stop_after="write")
    os.remove(path)
    res = ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch")
    assert res.retried and _rows(spark, lake, ["id", "v"], "ymd_batch") == [("2", "y")]


def test_rewritten_between_crash_and_retry(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,old\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", layout="ymd_batch", stop_after="write")
    time.sleep(1.1)
    write_file(work, "src/a.csv", "id,v\n1,new and longer\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch")
    assert _rows(spark, lake, ["id", "v"], "ymd_batch") == [("1", "new and longer")]


def test_rejects_are_written_once(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y,too,many\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", layout="ymd_batch", stop_after="write", rejects_dir=f"{work}/rej")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch", rejects_dir=f"{work}/rej")
    assert [r.line for r in spark.read.parquet(f"{work}/rej").collect()] == ["2,y,too,many"]


def test_retry_keeps_its_day_in_any_driver_zone(spark, work, monkeypatch):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05 02:00:00", layout="ymd_batch", stop_after="write")
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        res = ingest(spark, "t", src, lake, state, run_ts="2024-03-07", layout="ymd_batch")
    finally:
        monkeypatch.undo()
        time.tzset()
    assert res.retried and res.run_ts == "2024-03-05 02:00:00"
    got = read_lake_table(spark, lake, ["id", "v"], layout="ymd_batch").select("id", "day").collect()
    assert [tuple(r) for r in got] == [("1", 5)]


def test_read_increment_reads_every_new_file(spark, work):
    src, lake, state = _dirs(work)
    for k in range(3):
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x\n")
    assert read_increment(spark, "t", src, state).count() == 3


PAIRS = [("id", "key"), ("v", "value")]


def test_delivery_takes_older_days_and_every_batch(spark, work):
    src, lake, state = _dirs(work)
    for k, day in enumerate(("2024-10-01", "2024-09-01", "2024-10-02")):  # change times against day order
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x\n")
        ingest(spark, "t", src, lake, f"{state}{k}" if k else state, run_ts=day) if not k else \
            ingest(spark, f"t{k}", f"{work}/src", lake, f"{state}{k}", run_ts=day, glob=f"f{k}.csv")
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", f"{work}/out", PAIRS, run_ts="2024-11-01", max_files=1) == 3
    assert sorted(r.key for r in spark.read.json(f"{work}/out").collect()) == ["0", "1", "2"]
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", f"{work}/out", PAIRS, run_ts="2024-11-02") == 0


def test_delivery_takes_files_of_any_name(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    part = next(Path(lake.replace("file:", "")).rglob("part-*"))
    shutil.copy(part, part.with_name("restored.csv"))
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", f"{work}/out", PAIRS, run_ts="2024-03-07") == 2
    assert [r.key for r in spark.read.json(f"{work}/out").collect()] == ["1", "1"]


def test_delivery_takes_committed_batches_only(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    with pytest.raises(SimulatedCrash):
        ingest(spark, "t", src, lake, state, run_ts="2024-03-05", layout="ymd_batch", stop_after="write")
    kw = {"layout": "ymd_batch", "ingest_ctx": "t", "ingest_state": state}
    out = f"{work}/out"
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", out, PAIRS, run_ts="2024-03-05 12:00:00", **kw) == 0
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06", layout="ymd_batch")
    assert deliver_entity(spark, "d", lake, None, f"{work}/ds", out, PAIRS, run_ts="2024-03-06 12:00:00", **kw) == 1
    assert [r.key for r in spark.read.json(out).collect()] == ["1"]


def test_delivery_of_a_parquet_lake_and_of_new_columns(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05", fmt="parquet")
    write_file(work, "src/b.csv", "id,v,w\n2,y,z\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06", fmt="parquet")
    pairs = [*PAIRS, ("w", "more")]
    n = deliver_entity(spark, "d", lake, None, f"{work}/ds", f"{work}/out", pairs, run_ts="2024-03-07", lake_fmt="parquet",
                       ingest_ctx="t", ingest_state=state)
    assert n == 2
    assert sorted((r.key, r.more) for r in spark.read.json(f"{work}/out").collect() if r.more) == [("2", "z")]


def test_delivery_rejects_names_it_writes_itself(spark, work):
    src, lake, state = _dirs(work)
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    with pytest.raises(ValueError):
        deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", f"{work}/out", [("id", "run_date")], run_ts="2024-03-06")
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/ds", f"{work}/out", PAIRS, run_ts="2024-03-07") == 1
