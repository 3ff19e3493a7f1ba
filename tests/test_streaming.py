"""Batch–stream agreement for T1 (ingest on arrival) and T3 (asset events)."""

from __future__ import annotations

import pytest
from conftest import write_file
from lakeloom.plans.ingest import ingest
from lakeloom.sinks.tables import read_lake_table
from lakeloom.streaming.jobs import ingest_on_arrival, ingest_stream_append


def lake_rows(spark, path, layout="ymd"):
    return sorted(tuple(r) for r in read_lake_table(spark, path, ["id", "v"], layout=layout)
                  .select("id", "v").collect())


def test_ingest_on_arrival_equals_batch(spark, work):
    for k in range(3):
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x{k}\n")
    q = ingest_on_arrival(spark, "t", f"{work}/src", f"{work}/lake_s", f"{work}/state_s",
                          f"{work}/ckpt", max_files_per_trigger=1, clock=lambda b: f"2024-03-0{5 + b}")
    q.awaitTermination()
    ingest(spark, "t", f"{work}/src", f"{work}/lake_b", f"{work}/state_b", run_ts="2024-03-05")
    assert lake_rows(spark, f"{work}/lake_s") == lake_rows(spark, f"{work}/lake_b") == \
        [("0", "x0"), ("1", "x1"), ("2", "x2")]
    # a second availableNow run with nothing new adds nothing
    ingest_on_arrival(spark, "t", f"{work}/src", f"{work}/lake_s", f"{work}/state_s",
                      f"{work}/ckpt").awaitTermination()
    assert len(lake_rows(spark, f"{work}/lake_s")) == 3


def test_append_stream_one_file_per_batch(spark, work):
    for k in range(3):
        write_file(work, f"src/f{k}.csv", f"id,v\n{k},x{k}\n")
    q = ingest_stream_append(spark, f"{work}/src", f"{work}/lake", ["id", "v"], f"{work}/ckpt",
                             max_files_per_trigger=1, clock=lambda b: "2024-03-05")
    q.awaitTermination()
    df = read_lake_table(spark, f"{work}/lake", ["id", "v"], layout="ymd_batch")
    assert sorted(r.batch_id for r in df.select("batch_id").distinct().collect()) == [0, 1, 2]
    assert lake_rows(spark, f"{work}/lake", "ymd_batch") == [("0", "x0"), ("1", "x1"), ("2", "x2")]


def test_deliver_daily_stream_takes_only_new_rows(spark, work):
    from lakeloom.plans.ingest import ingest
    from lakeloom.streaming.jobs import deliver_daily

    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    pairs = [("id", "order_id"), ("v", "value")]
    query = "SELECT CAST(id AS BIGINT) AS id, upper(v) AS v FROM increment"
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05")
    deliver_daily(spark, lake, ["id", "v"], f"{work}/out", pairs, f"{work}/ckpt", query=query,
                  clock=lambda b: "2024-03-05").awaitTermination()
    write_file(work, "src/b.csv", "id,v\n3,z\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-06")
    deliver_daily(spark, lake, ["id", "v"], f"{work}/out", pairs, f"{work}/ckpt", query=query,
                  clock=lambda b: "2024-03-06").awaitTermination()
    out = spark.read.schema("order_id BIGINT, value STRING, run_date STRING, batch_id BIGINT").json(f"{work}/out")
    got = sorted((r.order_id, r.value, r.run_date) for r in out.collect())
    assert got == [(1, "X", "2024-03-05"), (2, "Y", "2024-03-05"), (3, "Z", "2024-03-06")]


def test_asset_event_stream_equals_batch(spark, work):
    """T3 over staged JSON events equals the batch plan on the same envelopes."""
    from pyspark.sql import functions as F

    from lakeloom import standins as si
    from lakeloom.plans.dictionary import asset_events
    from lakeloom.sinks.exports import EXPORT_KEYS
    from lakeloom.streaming.jobs import asset_event_stream

    sf = "/root/testdata/sf0.001"
    region, nation, customer = (si.table(spark, sf, t) for t in ("region", "nation", "customer"))
    lookups = (si.projects(customer), si.units(nation), si.domains(spark), si.assets(region, nation))
    path = si.stage_events_json(spark, sf, f"{work}/events")
    asset_event_stream(spark, path, *lookups, si.HOME_DOMAIN, f"{work}/export", f"{work}/notify",
                       f"{work}/rejects", f"{work}/ckpt", max_files_per_trigger=1).awaitTermination()
    batch = asset_events(si.envelopes(si.table(spark, sf, "events")), *lookups, si.HOME_DOMAIN)
    good = batch.where(F.col("reject_reason").isNull())
    exported = spark.read.option("header", "true").csv(f"{work}/export")
    want_keys = {tuple(r) for r in good.select(*EXPORT_KEYS).distinct().collect()}
    got_keys = {tuple(r) for r in exported.select(*EXPORT_KEYS).distinct().collect()}
    assert got_keys == want_keys and len(want_keys) > 0
    notes = spark.read.parquet(f"{work}/notify")
    assert notes.count() == good.count()
    rejects = spark.read.parquet(f"{work}/rejects")
    assert rejects.count() == batch.where(F.col("reject_reason").isNotNull()).count()


def test_delivery_lists_only_recent_days_and_misses_nothing(spark, work):
    from lakeloom.plans.delivery import deliver_entity
    from lakeloom.plans.ingest import ingest

    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    pairs = [("id", "id"), ("v", "v")]
    out = f"{work}/out"
    write_file(work, "src/a.csv", "id,v\n1,x\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05 10:00:00")
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/dstate", out, pairs, run_ts="2024-03-05 11:00:00") == 1
    write_file(work, "src/b.csv", "id,v\n2,y\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-05 12:00:00")  # same day as the last delivery
    write_file(work, "src/c.csv", "id,v\n3,z\n")
    ingest(spark, "t", src, lake, state, run_ts="2024-03-07 12:00:00")
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/dstate", out, pairs, run_ts="2024-03-07 13:00:00") == 2
    assert deliver_entity(spark, "d", lake, ["id", "v"], f"{work}/dstate", out, pairs, run_ts="2024-03-08") == 0
    got = spark.read.schema("id STRING, v STRING, run_date STRING, batch_id BIGINT").json(out)
    assert sorted((r.id, r.run_date) for r in got.collect()) == [
        ("1", "2024-03-05"), ("2", "2024-03-07"), ("3", "2024-03-07")]


def test_replayed_asset_batch_gives_the_same_output(spark, work):
    """A micro-batch replayed after a failure (same batch id) writes the same
    exports, notifications and rejects, not a second copy."""
    from lakeloom import standins as si
    from lakeloom.plans.dictionary import asset_events
    from lakeloom.streaming.jobs import process_asset_batch

    sf = "/root/testdata/sf0.001"
    region, nation, customer = (si.table(spark, sf, t) for t in ("region", "nation", "customer"))
    batch = asset_events(si.envelopes(si.table(spark, sf, "events")), si.projects(customer), si.units(nation),
                         si.domains(spark), si.assets(region, nation), si.HOME_DOMAIN)
    roots = (f"{work}/export", f"{work}/notify", f"{work}/rejects")

    def snapshot():
        return (spark.read.option("header", "true").csv(roots[0]).count(),
                spark.read.parquet(roots[1]).count(), spark.read.parquet(roots[2]).count())

    process_asset_batch(batch, 7, *roots)
    once = snapshot()
    process_asset_batch(batch, 7, *roots)
    assert snapshot() == once and min(once) > 0


def test_replayed_daily_delivery_on_a_later_day_replaces_its_batch(spark, work):
    from lakeloom.sinks.exports import write_delivery

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    write_delivery(rows, f"{work}/out", "2024-03-05", 3)
    write_delivery(rows, f"{work}/out", "2024-03-06", 3)  # the same batch replayed a day later
    back = spark.read.schema("id LONG, v STRING, run_date STRING, batch_id LONG").json(f"{work}/out")
    assert sorted((r.id, r.run_date, r.batch_id) for r in back.collect()) == [
        (1, "2024-03-06", 3), (2, "2024-03-06", 3)]


def _events(spark, rows):
    """(domain, asset, event id, time or None, columns or None) as good events."""
    return spark.createDataFrame(
        [(d, "u", "p", a, t, i, None if c is None else [(x, f"about {x}") for x in c]) for d, a, i, t, c in rows],
        "domain_name string, domain_unit_name string, project_name string, asset_name string, event_time string, event_id string, "
        "columns array<struct<columnIdentifier: string, description: string>>").selectExpr(
        "domain_name", "domain_unit_name", "project_name", "asset_name", "cast(event_time as timestamp) as event_time", "event_id", "columns")


def _dictionary(spark, root):
    from lakeloom.sinks.snapshots import read_dictionary

    return sorted(((r.domain_name, r.asset_name, r.column_name) for r in read_dictionary(spark, root).collect()), key=str)


def test_late_event_does_not_replace_a_newer_list(spark, work):
    from lakeloom.sinks.snapshots import current_objects, latest_snapshot, publish_batch

    root = f"{work}/x"
    assert _dictionary(spark, root) == [] and latest_snapshot(spark, root)["version"] == 0
    publish_batch(_events(spark, [("d", "feb#1", "e2", "2024-02-01", ["b"]), ("d", "other", "e3", "2024-02-01", ["o"]),
                                  (None, "no domain", "e4", None, ["n"]), ("d", "empty", "e5", "2024-02-01", ["x"])]), 0, root)
    publish_batch(_events(spark, [("d", "feb#1", "e1", "2024-01-01", ["a"]), (None, "no domain", "e9", "1999-01-01", ["later"]),
                                  ("d", "empty", "e6", "2024-02-02", [])]), 1, root)
    assert _dictionary(spark, root) == sorted([("d", "feb#1", "b"), ("d", "other", "o"), (None, "no domain", "later")], key=str)
    publish_batch(_events(spark, []), 2, root)  # an empty batch publishes nothing
    assert latest_snapshot(spark, root)["version"] == 2
    publish_batch(_events(spark, [("d", "feb#1", "e0", "2024-03-01", ["c1", "c2"])]), 3, root)
    live = {r.asset_name: (r.batch_id, r.n_columns) for r in current_objects(spark, root).collect()}
    assert live == {"feb#1": (3, 2), "other": (0, 1), "no domain": (1, 1), "empty": (1, 0)}


def test_crash_replay_and_second_writer(spark, work):
    import pytest

    from lakeloom.sinks import snapshots as sn

    root = f"{work}/x"
    first = _events(spark, [("d", "a", "e1", "2024-01-01", ["one"]), ("d", "b", "e2", "2024-01-01", ["two"])])
    sn.publish_batch(first, 0, root)
    before = _dictionary(spark, root)
    second = _events(spark, [("d", "a", "e3", "2024-02-01", ["three"])])
    with pytest.raises(sn.StoppedBeforePublish):
        sn.publish_batch(second, 1, root, stop_before_publish=True)
    assert _dictionary(spark, root) == before  # nothing of it is visible
    sn.publish_batch(second, 1, root)
    after = _dictionary(spark, root)
    assert after == [("d", "a", "three"), ("d", "b", "two")]
    sn.publish_batch(_events(spark, [("d", "a", "zzz", "2030-01-01", ["never"])]), 1, root)  # a replay changes nothing
    assert _dictionary(spark, root) == after and sn.latest_snapshot(spark, root)["version"] == 2
    # Another writer publishes version 3 between this batch's read and its publication.
    real = sn.fs.write_once
    try:
        def beaten(s, path, text):
            assert real(s, path, text)
            return real(s, path, text)
        sn.fs.write_once = beaten
        with pytest.raises(sn.ConcurrentPublish):
            sn.publish_batch(_events(spark, [("d", "b", "e9", "2024-05-01", ["x"])]), 2, root)
    finally:
        sn.fs.write_once = real


def test_superseded_objects_are_collected(spark, work):
    from lakeloom.sinks import snapshots as sn
    from lakeloom.sources import fs

    root = f"{work}/x"
    for k in range(5):
        rows = [("d", "a", f"e{k}", f"2024-01-0{k + 1}", [f"v{k}"])] + ([("d", "still", "s", "2024-01-01", ["s"])] if k == 1 else [])
        sn.publish_batch(_events(spark, rows), k, root)
    fs.write_once(spark, f"{root}/batch_id=9/domain_name=d/domain_unit_name=u/project_name=p/asset_name=a/part-0.csv", "column_name,description\nunpublished,x\n")
    assert sn.collect_superseded(spark, root, keep=2) == [0, 2]
    assert _dictionary(spark, root) == [("d", "a", "v4"), ("d", "still", "s")]
    assert [n for n in fs.list_names(spark, root) if n.startswith("batch")] == ["batch_id=1", "batch_id=3", "batch_id=4", "batch_id=9"]
    assert len(fs.list_names(spark, f"{root}/_snapshots")) == 2


def test_notification_key_finds_its_object(spark, work):
    from lakeloom import standins as si
    from lakeloom.plans.dictionary import asset_events
    from lakeloom.sources import fs
    from lakeloom.streaming.jobs import process_asset_batch

    sf = "/root/testdata/sf0.001"
    region, nation, customer = (si.table(spark, sf, t) for t in ("region", "nation", "customer"))
    batch = asset_events(si.envelopes(si.table(spark, sf, "events").limit(200)), si.projects(customer), si.units(nation),
                         si.domains(spark), si.assets(region, nation), si.HOME_DOMAIN)
    process_asset_batch(batch, 4, f"{work}/dictionary", f"{work}/notify", f"{work}/rejects")
    keys = {r.key for r in spark.read.parquet(f"{work}/notify").collect()}
    assert keys and all(k.startswith("dictionary/batch_id=4/") and fs.list_data_files(spark, f"{work}/{k}") for k in keys)


def test_objects_are_written_and_read_without_listing(spark, work, monkeypatch):
    """The tasks write and open the objects by name: the same rows as by Spark's
    CSV writer and reader, which serve where Python has no client, and each
    reads what the other wrote."""
    from lakeloom.sinks import snapshots as sn

    odd = ['q"uote', "com,ma", " pad ", "back\\slash", "é", "#hash", ""]
    rows = [("d #1/x", "a%b", "e1", "2024-01-01", odd), (None, "n\x01", "e2", None, odd[:2]), ("d", None, "e3", None, ["only"]),
            ("d", "none", "e4", None, None), ("d", "empty", "e5", None, [])]
    tasks, spark_io = f"{work}/tasks", f"{work}/spark"
    with monkeypatch.context() as m:
        m.setattr(sn.fs, "python_reaches", lambda *a: False)
        sn.publish_batch(_events(spark, rows), 0, spark_io)
        want = _dictionary(spark, spark_io)
    sn.publish_batch(_events(spark, rows), 0, tasks)
    with monkeypatch.context() as m:
        m.setattr(sn.fs, "python_reaches", lambda *a: False)
        assert _dictionary(spark, tasks) == want and len(want) == 9
    assert _dictionary(spark, spark_io) == want
    real = sn.fs.list_names
    monkeypatch.setattr(sn.fs, "list_names", lambda s, folder: real(s, folder) if folder.endswith("_snapshots") else pytest.fail("folders are listed"))
    assert _dictionary(spark, tasks) == want
