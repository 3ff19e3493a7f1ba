"""Events (P7–P9), lookups (J2, J3, J8), hierarchy (J4–J7), aggregates (A3, A4),
mapping (P4–P6)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakeloom import standins as si
from lakeloom.operators.aggregates import grant_state, latest_per_key, rejected_requests
from lakeloom.operators.events import (ASSET_ADDED, CATALOG_SOURCE, METADATA_ACCEPTED, OBJECT_CREATED, OBJECT_SOURCE, RULE_SCHEMA,
                                       extract_by_type, match_events, route_events)
from lakeloom.operators.hierarchy import (child_flag, effective_grants, effective_policies, fan_out_entities, fan_out_grants,
                                          hierarchy_closure)
from lakeloom.operators.lookups import enrich_asset, lookup_or_self, resolve_members
from lakeloom.operators.mapping import apply_mapper, check_mapper
from lakeloom.plans.dictionary import asset_events
from lakeloom.sources.events import EVENT_SCHEMA


def env(spark, rows):
    """rows: (id, source, type, domain, md_user, md_id, data) with data = (assetId, userId) or None."""
    out = []
    for i, src, typ, dom, user, mid, data, bucket in rows:
        out.append((i, src, typ, "2024-01-01T00:00:00.000001",
                    ((user, mid, dom, "prj-1"), data, (bucket,) if bucket else None)))
    return spark.createDataFrame(out, EVENT_SCHEMA)


def test_extract_by_type_and_unknown_type(spark):
    e = env(spark, [("1", CATALOG_SOURCE, ASSET_ADDED, "d", "u-md", "a-md", ("a-data", "u-data"), None),
                    ("2", CATALOG_SOURCE, METADATA_ACCEPTED, "d", "u-md", "a-md", ("a-data", "u-data"), None),
                    ("3", CATALOG_SOURCE, "Something Else", "d", "u-md", "a-md", None, None)])
    got = extract_by_type(e).select("id", "user_id", "asset_id", "known").orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "u-md", "a-data", True), ("2", "u-data", "a-md", True),
                                       ("3", None, None, False)]


def test_match_events_domain_and_no_domain_rule(spark):
    e = env(spark, [("1", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "a", None, None),
                    ("2", CATALOG_SOURCE, ASSET_ADDED, "far", "u", "a", None, None),
                    ("3", "other", ASSET_ADDED, "home", "u", "a", None, None)])
    assert [r.id for r in match_events(e, [CATALOG_SOURCE], [ASSET_ADDED], ["home"]).collect()] == ["1"]
    assert sorted(r.id for r in match_events(e, [CATALOG_SOURCE]).collect()) == ["1", "2"]


def test_route_events_disabled_rule_unsupported_target_and_bucket_map(spark):
    e = env(spark, [("1", "aws.s3", "Object Created", "d", "u", "a", None, "real-bucket"),
                    ("2", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "a", None, None)])
    rules = spark.createDataFrame([
        ("land", True, ["aws.s3"], ["Object Created"], None, ["logical"],
         [("Glue", "startWorkflowRun", {"Name": "wf"}), ("SNS", "publish", {})]),
        ("off", False, [CATALOG_SOURCE], [ASSET_ADDED], None, None, [("Lambda", "invokeLambdaFunction", {})]),
    ], RULE_SCHEMA)
    bmap = spark.createDataFrame([("logical", "real-bucket")], "logical string, real string")
    got = route_events(e, rules, bmap).select("id", "rule_name", "service", "supported").orderBy("service").collect()
    assert [tuple(r) for r in got] == [("1", "land", "Glue", True), ("1", "land", "SNS", False)]


def test_lookup_or_self(spark):
    df = spark.createDataFrame([("a",), ("b",)], "name string")
    m = spark.createDataFrame([("a", "A1")], "logical string, real string")
    assert sorted(r.name for r in lookup_or_self(df, "name", m).collect()) == ["A1", "b"]


def test_resolve_members_key_wins_even_when_unknown(spark):
    members = spark.createDataFrame([
        ("m1", "k1", "lit1", None),   # known key → looked-up id
        ("m2", "k9", "lit2", None),   # unknown key → null, literal NOT used
        ("m3", None, "lit3", None),   # no key → literal
        ("m4", None, None, "g4"),     # group only → kept
        ("m5", None, None, None),     # nothing → dropped
    ], "member string, predefinedUserKey string, userIdentifier string, groupIdentifier string")
    users = spark.createDataFrame([("k1", "uid-1")], "user_key string, user_id string")
    got = resolve_members(members, users).select("member", "resolved_user", "unknown_key", "keep") \
        .orderBy("member").collect()
    assert [tuple(r) for r in got] == [("m1", "uid-1", False, True), ("m2", None, True, False),
                                       ("m3", "lit3", False, True), ("m4", None, False, True),
                                       ("m5", None, False, False)]


def test_enrich_asset_lists_misses(spark):
    ev = spark.createDataFrame([("e1", "d", "p1", "a1"), ("e2", "d", "p2", "a1"), ("e3", "x", "p1", "a1")],
                               "id string, domain_id string, project_id string, asset_id string")
    projects = spark.createDataFrame([("d", "p1", "P one", "u1")], "domain_id string, id string, name string, domainUnitId string")
    units = spark.createDataFrame([("d", "u1", "U one")], "domain_id string, id string, name string")
    domains = spark.createDataFrame([("d", "D")], "id string, name string")
    assets = spark.createDataFrame([("d", "a1", "A", "3", [])],
                                   "domain_id string, id string, name string, revision string, forms array<struct<formName string, content string>>")
    got = enrich_asset(ev, projects, units, domains, assets).select("id", "project_name", "missing").orderBy("id").collect()
    assert [(r.id, r.project_name, list(r.missing)) for r in got] == [
        ("e1", "P one", []), ("e2", None, ["project", "domain_unit"]),
        ("e3", None, ["project", "domain_unit", "domain", "asset"])]


def test_asset_events_rejects_unknown_type_and_missing_form(spark):
    e = env(spark, [("1", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "x", ("a1", "u2"), None),
                    ("2", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "x", ("a2", "u2"), None),
                    ("3", CATALOG_SOURCE, "Asset Removed", "home", "u", "a1", None, None),
                    ("4", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "x", ("a3", "u2"), None)])
    projects = spark.createDataFrame([("home", "prj-1", "P", "u1")], "domain_id string, id string, name string, domainUnitId string")
    units = spark.createDataFrame([("home", "u1", "U")], "domain_id string, id string, name string")
    domains = spark.createDataFrame([("home", "H")], "id string, name string")
    content = '{"columnsBusinessMetadata": [{"columnIdentifier": "c", "description": "d"}]}'
    assets = spark.createDataFrame([("home", "a1", "A1", "1", [("AssetCommonDetailsForm", '{"summary": "s"}'),
                                                               ("ColumnBusinessMetadataForm", content)]),
                                    ("home", "a2", "A2", "1", [("AssetCommonDetailsForm", '{"summary": "s"}')]),
                                    ("home", "a3", "A3", "1", [("ColumnBusinessMetadataForm", content)])],
                                   "domain_id string, id string, name string, revision string, forms array<struct<formName string, content string>>")
    got = asset_events(e, projects, units, domains, assets, "home").select("event_id", "reject_reason") \
        .orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [("1", None), ("2", "missing form"), ("3", "unknown type: Asset Removed"),
                                       ("4", "missing form")]


def test_fan_out_entities_skips_empty(spark):
    units = spark.createDataFrame([
        ("Root Unit", "Time Off", [("Leave Feed", "d", [("timeoff", "source-raw-source-x", "cron")])]),
        ("Root Unit", "Empty", [("Nothing", "d", [])]),
        ("Root Unit", "No Projects", []),
    ], "parent_unit string, unit string, projects array<struct<name string, description string, "
       "entities array<struct<entity_type string, source_bucket string, schedule_trigger_timing string>>>>")
    got = fan_out_entities(units).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.entity_path, r.target_bucket, r.database, r.table_prefix, r.project_key) == (
        "rootunit/timeoff/timeoff", "target-raw-source-x", "leavefeed_pub_db", "timeoff_", "leave_feed")


def test_hierarchy_closure_depths_and_cycle(spark):
    edges = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("c", "b")], "node string, parent string")
    got = {(r.node, r.ancestor, r.depth) for r in hierarchy_closure(spark, edges).collect()}
    assert ("c", "root", 3) in got and ("a", "a", 0) in got and len(got) == 4 + 3 + 2 + 1
    cyc = spark.createDataFrame([("x", "y"), ("y", "x")], "node string, parent string")
    with pytest.raises(ValueError):
        hierarchy_closure(spark, cyc)
    deep = spark.createDataFrame([("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 9)], "node string, parent string")
    assert hierarchy_closure(spark, deep).count() == 9 * 10 // 2


def test_effective_grants_child_flag(spark):
    edges = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a")], "node string, parent string")
    closure = hierarchy_closure(spark, edges)
    grants = spark.createDataFrame([("root", "false"), ("a", "true")], "entity string, flag string") \
        .select("entity", child_flag("flag").alias("include_child"))
    got = sorted((r.entity, r.node) for r in effective_grants(grants, closure).collect())
    assert got == [("a", "a"), ("a", "b"), ("root", "root")]


def test_effective_policies_count_what_effective_grants_lists(spark):
    edges = spark.createDataFrame([("root", None)] + [(f"m{i}", "root") for i in range(3)] + [(f"l{i}", f"m{i % 3}") for i in range(20)],
                                  "node string, parent string")
    closure = hierarchy_closure(spark, edges)
    grants = spark.createDataFrame([("root", "P", True), ("root", "P", False), ("m1", "P", True), ("m1", "Q", False), ("l4", "Q", True), ("l4", "Q", True)],
                                   "entity string, kind string, include_child boolean")
    want = effective_grants(grants, closure).groupBy("node", "kind").agg(
        F.count(F.lit(1)).alias("n_grants"), F.count(F.when(F.col("depth") == 0, 1)).alias("n_direct"))
    for bound in (200_000, 0):
        got = effective_policies(grants, closure, ["kind"], max_broadcast_rows=bound)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_null_policy_is_rejected_and_environment_policies_never_spread(spark):
    rows = [("r1", 1, "Create", "d", "e", "DOMAIN_UNIT", None, "IAM_ROLE", "a", "true"),
            ("r2", 2, None, "d", "e", "DOMAIN_UNIT", "CREATE_PROJECT", "IAM_ROLE", "a", "true"),
            ("r3", 3, "Create", "d", "e", "DOMAIN_UNIT", "CREATE_ENVIRONMENT", "x", "a", "true"),
            ("r4", 4, "Create", "d", "e", "DOMAIN_UNIT", "CREATE_PROJECT", "IAM_ROLE", "a", "true")]
    df = spark.createDataFrame(rows, "request_id string, ts long, RequestType string, DomainIdentifier string, EntityIdentifier string, "
                               "EntityType string, PolicyType string, PrincipalType string, PrincipalArn string, IncludeChildDomainUnits string")
    assert sorted(r.request_id for r in rejected_requests(df).collect()) == ["r1", "r2"]
    assert {r.PolicyType: r.include_child for r in grant_state(df).collect()} == {"CREATE_ENVIRONMENT": False, "CREATE_PROJECT": True}


def test_rules_default_to_enabled_and_route_once(spark):
    e = env(spark, [("1", OBJECT_SOURCE, OBJECT_CREATED, None, None, None, None, "real-b")])
    target = [("Lambda", "invokeLambdaFunction", {})]
    rules = spark.createDataFrame([("two-names", None, [OBJECT_SOURCE, OBJECT_SOURCE], [OBJECT_CREATED], None, ["one", "other", "real-b"], target)],
                                  RULE_SCHEMA)
    bmap = spark.createDataFrame([("one", "real-b"), ("one", "real-b"), ("other", "real-b")], "logical string, real string")
    assert [r.rule_name for r in route_events(e, rules, bmap).collect()] == ["two-names"]


def test_a_repeated_lookup_key_matches_once_also_when_salted(spark):
    members = spark.createDataFrame([("k", None, None)] * 3, "predefinedUserKey string, userIdentifier string, groupIdentifier string")
    users = spark.createDataFrame([("k", "b"), ("k", "a"), (None, "z")], "user_key string, user_id string")
    for bound in (200_000, 0):
        got = resolve_members(members, users, max_rows=bound).collect()
        assert [r.resolved_user for r in got] == ["a"] * 3


def test_child_flag_text(spark):
    df = spark.createDataFrame([("true",), ("false",), ("TRUE",), ("yes",), ("junk",), (None,)], "f string")
    assert [r[0] for r in df.select(child_flag("f")).collect()] == [True, False, True, True, False, False]


def test_fan_out_grants(spark):
    units = spark.createDataFrame([("u1",)], "id string")
    got = {tuple(r) for r in fan_out_grants(units, "id", "admin", ["x", "admin"]).collect()}
    assert got == {("u1", "admin", "CREATE_PROJECT", True), ("u1", "admin", "ADD_TO_PROJECT_MEMBER_POOL", False),
                   ("u1", "x", "ADD_TO_PROJECT_MEMBER_POOL", False)}


def test_latest_per_key_ties_broken(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 1, "b"), ("k", 2, 3, "c"), ("j", 0, 0, "z")],
                               "key string, ts int, id int, v string")
    got = sorted(tuple(r) for r in latest_per_key(df, ["key"], ["ts", "id"]).collect())
    assert got == [("j", 0, 0, "z"), ("k", 2, 3, "c")]


def test_grant_state_delete_removes(spark):
    cols = ("request_id long, ts int, RequestType string, DomainIdentifier string, EntityIdentifier string, "
            "EntityType string, PolicyType string, PrincipalType string, PrincipalArn string, "
            "IncludeChildDomainUnits string")
    P, R = "CREATE_PROJECT", "IAM_ROLE"
    df = spark.createDataFrame([
        (1, 1, "Create", "d", "e1", "U", P, R, "r1", "true"),
        (2, 2, "Delete", "d", "e1", "U", P, R, "r1", "true"),
        (3, 1, "Create", "d", "e2", "U", P, R, "r1", "false"),
        (4, 2, "Update", "d", "e2", "U", P, R, "r1", "true"),
        (5, 3, "Delete", "d", "e2", "U", "NOT_A_POLICY", R, "r1", "true"),  # fails: no effect
        (6, 3, "Delete", "d", "e2", "U", P, "ROBOT", "r1", "true"),         # fails: no effect
        (7, 1, "Create", "d", "e3", "U", P, "IAM_GROUP", "g1", "false"),
    ], cols)
    got = sorted((r.EntityIdentifier, r.RequestType, r.principal_kind, r.include_child)
                 for r in grant_state(df).collect())
    assert got == [("e2", "Update", "user", True), ("e3", "Create", "group", False)]
    from lakeloom.operators.aggregates import rejected_requests
    assert sorted(r.request_id for r in rejected_requests(df).collect()) == [5, 6]


def test_mapper_rules(spark):
    df = spark.createDataFrame([(1, "a", "x")], "id int, name string, extra string")
    out = apply_mapper(df, [("name", "full_name"), ("id", "id")])
    assert out.columns == ["full_name", "id"] and tuple(out.first()) == ("a", 1)
    with pytest.raises(ValueError):
        check_mapper([("missing", "m")], df.columns)
    with pytest.raises(ValueError):
        check_mapper([("id", "x"), ("name", "x")], df.columns)


def test_standin_envelopes_are_schema_exact(spark):
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00", 3, "error", 1.0, '{"k": 95}')],
                               "event_id long, ts string, user_id long, event_type string, value double, props string") \
        .withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e = si.envelopes(ev).first()
    assert e["detail"]["data"] is None and e["detail"]["metadata"]["domain"] == si.FAR_DOMAIN


def test_salted_fallback_equals_broadcast_path(spark):
    """With a zero broadcast bound the joins take the salted path; same rows."""
    edges = spark.createDataFrame(
        [("root", None)] + [(f"m{i}", "root") for i in range(3)]
        + [(f"l{i}", f"m{i % 3}") for i in range(40)] + [("hot", None)] + [(f"h{i}", "hot") for i in range(60)],
        "node string, parent string")
    a = {tuple(r) for r in hierarchy_closure(spark, edges).collect()}
    b = {tuple(r) for r in hierarchy_closure(spark, edges, max_broadcast_rows=0).collect()}
    assert a == b and ("l5", "root", 2) in a and len(a) == 105 + 3 + 80 + 60
    grants = spark.createDataFrame([("root", True), ("hot", False), ("m1", True)], "entity string, include_child boolean")
    closure = hierarchy_closure(spark, edges)
    g1 = sorted(tuple(r) for r in effective_grants(grants, closure).collect())
    g2 = sorted(tuple(r) for r in effective_grants(grants, closure, max_broadcast_rows=0).collect())
    assert g1 == g2 and len(g1) == (1 + 3 + 40) + 1 + (1 + 13)


def test_fits_broadcast_checks_bytes(spark):
    from lakeloom.operators.lookups import fits_broadcast
    df = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert fits_broadcast(df, 100, 1 << 20)
    assert not fits_broadcast(df, 100, 5000)
    assert not fits_broadcast(df, 5, 1 << 20)


def test_catalog_rule_without_domain_is_skipped(spark):
    e = env(spark, [("1", CATALOG_SOURCE, ASSET_ADDED, "home", "u", "a", None, None)])
    rules = spark.createDataFrame([
        ("no-domain", True, [CATALOG_SOURCE], [ASSET_ADDED], None, None, [("Lambda", "invokeLambdaFunction", {})]),
        ("empty-domain", True, [CATALOG_SOURCE], [ASSET_ADDED], [], None, [("Lambda", "invokeLambdaFunction", {})]),
        ("home", True, [CATALOG_SOURCE], [ASSET_ADDED], ["home"], ["ignored-bucket"],
         [("Lambda", "invokeLambdaFunction", {})]),
    ], RULE_SCHEMA)
    assert [r.rule_name for r in route_events(e, rules).collect()] == ["home"]


def test_malformed_event_lines_are_listed(spark, work):
    from conftest import write_file
    from lakeloom.sources.events import event_scan, malformed_events

    write_file(work, "ev/a.json", '{"id": "1", "source": "s"}\n{not json\n')
    assert [tuple(r) for r in malformed_events(spark, f"{work}/ev").collect()] == [("{not json", None)]
    assert event_scan(spark, f"{work}/ev").where("id is not null").count() == 1


def test_malformed_event_time_does_not_fail(spark):
    rows = [("1", CATALOG_SOURCE, ASSET_ADDED, "not a time",
             (("u", "x", "home", "prj-1"), ("a1", "u2"), None))]
    e = spark.createDataFrame(rows, EVENT_SCHEMA)
    projects = spark.createDataFrame([("home", "prj-1", "P", "u1")], "domain_id string, id string, name string, domainUnitId string")
    units = spark.createDataFrame([("home", "u1", "U")], "domain_id string, id string, name string")
    domains = spark.createDataFrame([("home", "H")], "id string, name string")
    assets = spark.createDataFrame([("home", "a1", "A1", "1", [])],
                                   "domain_id string, id string, name string, revision string, forms array<struct<formName string, content string>>")
    r = asset_events(e, projects, units, domains, assets, "home").first()
    assert r.event_time is None and r.reject_reason == "missing form"


def test_only_hot_keys_are_salted(spark, monkeypatch):
    """With the broadcast bound at 0, the small side's copies are hot keys times
    salts, the rest once; results equal the broadcast join's."""
    from pyspark.sql import functions as F

    from lakeloom.operators import lookups as lk

    big = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
        "id", (F.col("id") % 2).cast("int").alias("j"))
    small = spark.createDataFrame([("hot", 0, "h0"), ("hot", 1, "h1")] + [(f"k{i}", i % 2, f"v{i}") for i in range(600)], "sk string, sj long, v string")
    assert set(lk.hot_keys(big, ["k"], 1 / 16)) == {r[0] for r in spark.range(1).select(F.xxhash64(F.lit("hot"))).collect()}
    for keys in ([("k", "sk")], [("k", "sk"), ("j", "sj")]):
        for how in ("inner", "left"):
            seen, real = [], F.explode
            monkeypatch.setattr(lk.F, "explode", lambda c: seen.append(c) or real(c))
            got = lk.skew_join(big, small, keys, how, salts=8, max_rows=0)
            monkeypatch.setattr(lk.F, "explode", real)
            copies = small.select(F.size(seen[0]).alias("n"), "sk").collect()
            assert {r.n for r in copies if r.sk == "hot"} == {8} and {r.n for r in copies if r.sk != "hot"} == {1}
            want = lk.skew_join(big, small, keys, how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rule_index_matches_like_the_plain_rules(spark):
    """Random rules and events against the rule semantics in plain Python."""
    import random

    from lakeloom.operators.events import RULE_SCHEMA, route_events
    from lakeloom.sources.events import EVENT_SCHEMA

    rng = random.Random(8)
    pick = lambda names: None if rng.random() < 0.3 else rng.sample(names, rng.randint(0, 2)) + ([None] if rng.random() < 0.1 else [])
    sources = ["aws.datazone", "aws.s3", "x"]
    rules = [(f"r{i}", rng.choice([True, True, True, False, None]), rng.sample(sources, rng.randint(1, 2)), pick(["t1", "t2", "*"]), pick(["d1", "d2"]),
              pick(["b1", "b2"]), [("Glue", "startWorkflowRun", {"n": str(i)}), ("SNS", "publish", {})][:rng.randint(1, 2)]) for i in range(60)]
    events = [{"id": str(i), "source": rng.choice([*sources, None]), "detail-type": rng.choice(["t1", "t2", "*", None]),
               "detail": {"metadata": {"domain": rng.choice(["d1", "d2", "d3", None])}, "bucket": rng.choice([None, {"name": rng.choice(["b1", "b2", "real"])}])}} for i in range(80)]
    df = spark.read.schema(EVENT_SCHEMA).json(spark.sparkContext.parallelize([__import__("json").dumps(e) for e in events]))
    table = spark.createDataFrame(rules, RULE_SCHEMA)
    names = spark.createDataFrame([("b1", "real")], "logical string, real string")
    want = []
    for e in events:
        domain, bucket = e["detail"]["metadata"]["domain"], (e["detail"]["bucket"] or {}).get("name")
        for name, on, src, types, domains, buckets, targets in rules:
            catalog = src[0] == "aws.datazone"
            if on is False or (catalog and not domains) or e["source"] not in src:
                continue
            if types is not None and (e["detail-type"] is None or e["detail-type"] not in types):
                continue
            if domains is not None and (domain is None or domain not in domains):
                continue
            real = None if catalog or buckets is None else {"real" if b == "b1" else b for b in buckets}
            if real and None in real:  # an unnamed bucket restricts nothing, as an empty list does
                hits = 1 + (bucket is not None and bucket in real)
            else:
                hits = 1 if not real or (bucket in real) else 0
            want += [(e["id"], name, t[0]) for t in targets] * hits
    for bound in (200_000, 0):
        got = [(r.id, r.rule_name, r.service) for r in route_events(df, table, names, max_rule_rows=bound).collect()]
        assert sorted(got) == sorted(want)
