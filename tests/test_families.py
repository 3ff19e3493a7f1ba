"""Header families: clustering against brute force, and tables of their own."""

from __future__ import annotations

import random

import pytest
from conftest import write_file

from lakeloom.plans.ingest import SimulatedCrash, ingest, ingest_and_register
from lakeloom.sources.files import header_families


def brute(headers, known, bound):
    sets = [frozenset(c.lower() for c in h) for h in headers]
    alike = lambda a, b: len(a & b) / len(a | b)
    out = []
    for s in sets:
        best = max(known, key=lambda k: (alike(s, {c.lower() for c in k[1]}), -known.index(k)), default=None)
        out.append(best[0] if best and alike(s, {c.lower() for c in best[1]}) >= bound else None)
    group = {i: i for i, f in enumerate(out) if f is None}
    changed = True
    while changed:
        changed = False
        for i in group:
            for j in group:
                if group[i] > group[j] and alike(sets[i], sets[j]) >= bound:
                    group[i], changed = group[j], True
    n = len(known)
    names = {g: f"f{n + k}" for k, g in enumerate(dict.fromkeys(group[i] for i in sorted(group)))}
    return [f or names[group[i]] for i, f in enumerate(out)]


@pytest.mark.parametrize("seed", range(40))
def test_families_equal_brute_force(seed):
    rng = random.Random(seed)
    pools = [[f"{p}{i}" for i in range(8)] + ["id", "Name"] for p in "abc"]
    headers = list(dict.fromkeys(tuple(rng.sample(rng.choice(pools), rng.randint(1, 7))) for _ in range(25)))
    known = [(f"f{k}", list(rng.sample(pools[k], 6))) for k in range(rng.randint(0, 2))]
    bound = rng.choice([0.3, 0.5, 0.75, 1.0])
    assert header_families(headers, known, bound) == brute(headers, known, bound)


def test_case_and_empty():
    assert header_families([("ID", "name"), ("id", "NAME"), ("x",)]) == ["f0", "f0", "f1"]
    assert header_families([]) == []


def test_two_kinds_make_two_tables_also_after_a_crash(spark, work):
    args = (spark, "t", f"{work}/src", f"{work}/lake", f"{work}/state")
    db = "mixed_" + work.rsplit("-", 1)[1]
    write_file(work, "src/a.csv", "id,name,city\n1,a,x\n")
    write_file(work, "src/b.csv", "code,price\n007,1.50\n")
    with pytest.raises(SimulatedCrash):
        ingest(*args, run_ts="2024-01-01", layout="ymd_batch", families=0.5, stop_after="write")
    ingest_and_register(*args, db, "t", run_ts="2024-01-02", layout="ymd_batch", families=0.5, db_location=f"{work}/wh")
    write_file(work, "src/c.csv", "price,code\n2.25,008\n")
    write_file(work, "src/d.csv", "zip,street,house\n1,2,3\n")
    ingest_and_register(*args, db, "t", run_ts="2024-01-03", layout="ymd_batch", families=0.5, db_location=f"{work}/wh")
    by = {t.name: spark.table(f"{db}.{t.name}") for t in spark.catalog.listTables(db)}
    rows = {n: sorted(tuple(map(str, r)) for r in d.drop("upload_time", "year", "month", "day", "batch_id").collect()) for n, d in by.items()}
    assert sorted(rows.values()) == sorted([[("1", "a", "x")], [("007", "1.50"), ("008", "2.25")], [("1", "2", "3")]])
