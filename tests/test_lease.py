"""One run at a time per context, fencing, and the bounded increment."""

from __future__ import annotations

import threading
import time

import pytest
from conftest import write_file

from lakeloom.plans.delivery import deliver_entity
from lakeloom.plans.ingest import ingest, read_increment
from lakeloom.sinks.tables import read_lake_table
from lakeloom.sources import fs
from lakeloom.sources import manifest as mf
from lakeloom.sources.lease import Fenced, Lease, LeaseBusy


def test_write_once_has_one_winner(spark, work):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append((k, fs.write_once(spark, f"{work}/one", str(k))))) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winner = [k for k, ok in won if ok]
    assert len(winner) == 1 and fs.read_text(spark, f"{work}/one") == str(winner[0])
    assert fs.list_names(spark, work) == ["one"]  # no leftovers of the others


def test_lease_waits_expires_and_fences(spark, work):
    with Lease(spark, work, "a/b c") as one:
        with pytest.raises(LeaseBusy):
            Lease(spark, work, "a/b c", wait=0.1, poll=0.05).__enter__()
        with Lease(spark, work, "other") as free:  # another context
            assert free.token == 1
        one.check()
    stale = Lease(spark, work, "a/b c", seconds=0).__enter__()  # released before, so free
    assert stale.token == 2
    with Lease(spark, work, "a/b c") as three:  # expired at once
        assert three.token == 3
        with pytest.raises(Fenced):
            stale.check()
        stale.__exit__()  # releases nothing of the new holder's
        three.check()


def test_a_renewed_lease_outlives_its_seconds(spark, work):
    with Lease(spark, work, "t", seconds=1.5) as one:
        time.sleep(2.5)
        with pytest.raises(LeaseBusy):
            Lease(spark, work, "t", wait=0.1).__enter__()
        one.check()


def test_two_runs_queue_and_take_each_file_once(spark, work):
    """Two sessions start together on one context in the appending layout."""
    write_file(work, "src/a.csv", "id,v\n" + "".join(f"{i},x\n" for i in range(50)))
    write_file(work, "src/b.csv", "id,v\n" + "".join(f"{i},y\n" for i in range(50, 80)))
    got, sessions = [], [spark, spark.newSession()]

    def run(s):
        got.append(ingest(s, "t", f"{work}/src", f"{work}/lake", f"{work}/state").files)

    threads = [threading.Thread(target=run, args=(s,)) for s in sessions]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [0, 2]
    rows = read_lake_table(spark, f"{work}/lake", ["id", "v"]).collect()
    assert sorted(int(r.id) for r in rows) == list(range(80))
    pairs = [("id", "id")]
    n = []
    threads = [threading.Thread(target=lambda s=s: n.append(deliver_entity(s, "d", f"{work}/lake", ["id", "v"], f"{work}/dstate", f"{work}/out", pairs))) for s in sessions]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert spark.read.json(f"{work}/out").count() == 80 and sorted(n)[0] == 0


def test_stalled_writer_cannot_commit(spark, work):
    write_file(work, "src/a.csv", "id,v\n1,x\n2,y\n")
    args = (spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state")
    with pytest.raises(Fenced):
        ingest(*args, run_ts="2024-01-01", layout="ymd_batch", lease_seconds=0,
               on_written=lambda: ingest(*args, run_ts="2024-01-02", layout="ymd_batch"))
    assert sorted(r.id for r in read_lake_table(spark, f"{work}/lake", ["id", "v"], layout="ymd_batch").collect()) == ["1", "2"]
    rows = mf.read_manifest(spark, f"{work}/state").collect()
    assert {(r.state, r.token) for r in rows} == {("intent", 1), ("committed", 2)}
    assert ingest(*args, run_ts="2024-01-03", layout="ymd_batch").files == 0


def test_increment_is_bounded(spark, work):
    for i in range(4):
        write_file(work, f"src/{i}.csv", f"id\n{i}\n")
    assert read_increment(spark, "t", f"{work}/src", f"{work}/state", max_files=4).count() == 4
    with pytest.raises(ValueError, match="over 3 new files"):
        read_increment(spark, "t", f"{work}/src", f"{work}/state", max_files=3)
