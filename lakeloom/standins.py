"""Domain tables derived from the shared test tables.

The reference's inputs (catalog events, project / unit / domain lookups, asset
documents, the unit tree, memberships, grant requests) are built here from the
TPC-H-like tables with DataFrame expressions, so every registered query reads
the given tables and grows with them. ``lakeloom.oracle`` holds the same
derivations in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.operators.events import (ASSET_ADDED, CATALOG_SOURCE, METADATA_ACCEPTED,
                                       OBJECT_CREATED, OBJECT_SOURCE, RULE_SCHEMA)
from lakeloom.sources.events import EVENT_SCHEMA

# Fixed values of the stand-in world.
HOME_DOMAIN = "dzd-home"
FAR_DOMAIN = "dzd-far"
HOME_DOMAIN_NAME = "Home Domain"
SCHEDULE = "cron(30 3 * * ? *)"
CSV_TS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def envelopes(events: DataFrame) -> DataFrame:
    """Catalog / object event envelopes (EVENT_SCHEMA) from ``events``.

    view, click → Asset Added; signup → Metadata Accepted; purchase → object
    created in a bucket; error → an unknown catalog type without ``detail.data``.
    ``k`` of the props JSON picks the asset and the domain (k ≥ 90: foreign).
    """
    k = F.from_json("props", "k INT")["k"]
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    asset_md = F.concat(F.lit("asset-"), _s(F.expr("k div 20")))
    asset_data = F.concat(F.lit("asset-"), _s(F.expr("4 - k div 20")))
    detail_type = (F.when(F.col("event_type").isin("view", "click"), F.lit(ASSET_ADDED))
                   .when(F.col("event_type") == "signup", F.lit(METADATA_ACCEPTED))
                   .when(F.col("event_type") == "purchase", F.lit(OBJECT_CREATED))
                   .otherwise(F.lit("Asset Removed")))
    detail = F.struct(
        F.struct(F.concat(F.lit("user-"), _s("user_id")).alias("user"),
                 asset_md.alias("id"),
                 F.when(F.col("k") < 90, F.lit(HOME_DOMAIN)).otherwise(F.lit(FAR_DOMAIN)).alias("domain"),
                 F.concat(F.lit("prj-"), _s("user_id")).alias("owningProjectId")).alias("metadata"),
        F.when(F.col("event_type") != "error",
               F.struct(asset_data.alias("assetId"),
                        F.concat(F.lit("user-"), _s(F.col("user_id") + 1000)).alias("userId")))
        .alias("data"),
        F.when(F.col("event_type") == "purchase",
               F.struct(F.when(F.col("value") > 50, F.lit("landing-raw"))
                        .otherwise(F.lit("landing-other")).alias("name")))
        .alias("bucket"))
    out = e.select(
        _s("event_id").alias("id"),
        F.when(F.col("event_type") == "purchase", F.lit(OBJECT_SOURCE))
        .otherwise(F.lit(CATALOG_SOURCE)).alias("source"),
        detail_type.alias("detail-type"),
        F.date_format("ts", CSV_TS_NTZ).alias("time"),
        detail.alias("detail"))
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields])


def stage_events_json(spark: SparkSession, sf_dir: str, path: str) -> str:
    envelopes(table(spark, sf_dir, "events")).write.mode("overwrite").json(path)
    return path


def projects(customer: DataFrame) -> DataFrame:
    return customer.select(F.lit(HOME_DOMAIN).alias("domain_id"),
                           F.concat(F.lit("prj-"), _s("c_custkey")).alias("id"),
                           F.col("c_name").alias("name"),
                           F.concat(F.lit("unit-"), _s("c_nationkey")).alias("domainUnitId"))


def units(nation: DataFrame) -> DataFrame:
    return nation.select(F.lit(HOME_DOMAIN).alias("domain_id"),
                         F.concat(F.lit("unit-"), _s("n_nationkey")).alias("id"),
                         F.col("n_name").alias("name"))


def domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(HOME_DOMAIN, HOME_DOMAIN_NAME)], "id string, name string")


def assets(region: DataFrame, nation: DataFrame) -> DataFrame:
    """One asset document per region; its columns are the region's nations.

    Each form's ``content`` is a JSON string (the document is JSON in JSON).
    """
    cols = (nation.groupBy("n_regionkey")
            .agg(F.sort_array(F.collect_list(F.struct(
                F.col("n_name").alias("columnIdentifier"),
                F.concat(F.lit("Nation "), _s("n_nationkey")).alias("description")))).alias("cols")))
    r = region.join(cols, region.r_regionkey == cols.n_regionkey)
    forms = F.array(
        F.struct(F.lit("AssetCommonDetailsForm").alias("formName"),
                 F.to_json(F.struct(F.concat(F.lit("Nations of "), F.col("r_name")).alias("summary")))
                 .alias("content")),
        F.struct(F.lit("ColumnBusinessMetadataForm").alias("formName"),
                 F.to_json(F.struct(F.col("cols").alias("columnsBusinessMetadata"))).alias("content")))
    return r.select(F.lit(HOME_DOMAIN).alias("domain_id"),
                    F.concat(F.lit("asset-"), _s("r_regionkey")).alias("id"),
                    F.col("r_name").alias("name"), F.lit("1").alias("revision"),
                    forms.alias("forms"))


def part_assets(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One asset document per part; its columns are the years it was shipped
    in, so both grow with the tables."""
    years = lineitem.select("l_partkey", F.year("l_shipdate").alias("y")).distinct()
    cols = years.groupBy("l_partkey").agg(F.sort_array(F.collect_list(F.struct(
        F.concat(F.lit("shipped_"), _s("y")).alias("columnIdentifier"), F.concat(F.lit("Shipped in "), _s("y")).alias("description")))).alias("cols"))
    p = part.join(cols, part.p_partkey == cols.l_partkey)
    forms = F.array(
        F.struct(F.lit("AssetCommonDetailsForm").alias("formName"),
                 F.to_json(F.struct(F.concat(F.lit("Years of "), F.col("p_name")).alias("summary"))).alias("content")),
        F.struct(F.lit("ColumnBusinessMetadataForm").alias("formName"),
                 F.to_json(F.struct(F.col("cols").alias("columnsBusinessMetadata"))).alias("content")))
    return p.select(F.lit(HOME_DOMAIN).alias("domain_id"), F.concat(F.lit("asset-"), _s("p_partkey")).alias("id"),
                    F.concat(F.lit("Part "), _s("p_partkey")).alias("name"), F.lit("1").alias("revision"), forms.alias("forms"))


def members(customer: DataFrame) -> DataFrame:
    """Project memberships: some by lookup key, some by literal id, some groups."""
    return customer.select(
        F.concat(F.lit("prj-"), _s("c_nationkey")).alias("project"),
        F.col("c_custkey").alias("member"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("PROJECT_OWNER"))
        .otherwise(F.lit("PROJECT_CONTRIBUTOR")).alias("designation"),
        F.when(F.col("c_acctbal") >= 5000, F.concat(F.lit("key-"), _s("c_nationkey"))).alias("predefinedUserKey"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("user-"), _s("c_custkey"))).alias("userIdentifier"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit("group-"), _s("c_nationkey")))
        .alias("groupIdentifier"))


def users(nation: DataFrame) -> DataFrame:
    """The user map; nations of region 0 have no entry (unknown keys)."""
    return nation.where(F.col("n_regionkey") != 0).select(
        F.concat(F.lit("key-"), _s("n_nationkey")).alias("user_key"),
        F.concat(F.lit("uid-"), F.col("n_name")).alias("user_id"))


def hierarchy_units(nation: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    """Units (customers) under parent units (nations), one project each, whose
    entities are the priorities of the customer's orders.

    The entity list of a project is bounded by the number of priorities; a
    customer without orders gets a project with no entity.
    """
    kinds = orders.select("o_custkey", F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "")).alias("kind")).distinct()
    ents = kinds.groupBy("o_custkey").agg(F.sort_array(F.collect_list("kind")).alias("kinds"))
    n = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    j = n.join(ents, n.c_custkey == ents.o_custkey, "left")
    entities = F.transform(
        F.coalesce("kinds", F.array().cast("array<string>")),
        lambda kind: F.struct(
            kind.alias("entity_type"),
            F.concat(F.lit("source-"), F.lower("c_name"), F.lit("-"), kind).alias("source_bucket"),
            F.lit(SCHEDULE).alias("schedule_trigger_timing")))
    project = F.struct(F.concat(F.col("c_name"), F.lit(" data feed")).alias("name"),
                       F.concat(F.lit("Data of "), F.col("c_name")).alias("description"),
                       entities.alias("entities"))
    return j.select(F.col("n_name").alias("parent_unit"), F.col("c_name").alias("unit"),
                    F.array(project).alias("projects"))


def tree_edges(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """(node, parent): regions are roots, nations under regions, customers under nations."""
    r = region.select(F.concat(F.lit("r"), _s("r_regionkey")).alias("node"),
                      F.lit(None).cast("string").alias("parent"))
    n = nation.select(F.concat(F.lit("n"), _s("n_nationkey")).alias("node"),
                      F.concat(F.lit("r"), _s("n_regionkey")).alias("parent"))
    c = customer.select(F.concat(F.lit("c"), _s("c_custkey")).alias("node"),
                        F.concat(F.lit("n"), _s("c_nationkey")).alias("parent"))
    return r.unionByName(n).unionByName(c)


def chain_edges(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A deep tree: each customer under the one five keys before, every order
    under its customer."""
    k = F.col("c_custkey")
    c = customer.select(F.concat(F.lit("c"), _s("c_custkey")).alias("node"),
                        F.when(k > 5, F.concat(F.lit("c"), _s(k - 5))).alias("parent"))
    o = orders.select(F.concat(F.lit("o"), _s("o_orderkey")).alias("node"),
                      F.concat(F.lit("c"), _s("o_custkey")).alias("parent"))
    return c.unionByName(o)


def asked_nodes(region: DataFrame, nation: DataFrame, customer: DataFrame) -> DataFrame:
    """The nodes asked about: every region and nation, and each nation's
    customer of least key."""
    r = region.select(F.concat(F.lit("r"), _s("r_regionkey")).alias("node"))
    n = nation.select(F.concat(F.lit("n"), _s("n_nationkey")).alias("node"))
    c = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("c"), _s("k")).alias("node"))
    return r.unionByName(n).unionByName(c)


def grant_requests(events: DataFrame, customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Grant change log: one request per event, on the user's nation or region.

    Sign-ups grant to a group, other events to a role; events with k ≥ 95
    carry a policy type that does not exist (such requests fail).
    """
    k = F.from_json("props", "k INT")["k"]
    e = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    j = (e.join(customer.select("c_custkey", "c_nationkey"), F.col("user_id") == F.col("c_custkey"))
         .join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey")))
    return j.select(
        F.col("event_id").alias("request_id"), "ts",
        F.when(F.col("event_type") == "error", F.lit("Delete"))
        .when(F.col("event_type") == "view", F.lit("Update")).otherwise(F.lit("Create")).alias("RequestType"),
        F.lit(HOME_DOMAIN).alias("DomainIdentifier"),
        F.when(F.col("k") >= 70, F.concat(F.lit("r"), _s("n_regionkey")))
        .otherwise(F.concat(F.lit("n"), _s("c_nationkey"))).alias("EntityIdentifier"),
        F.lit("DOMAIN_UNIT").alias("EntityType"),
        F.when(F.col("k") >= 95, F.lit("MANAGE_EVERYTHING"))
        .when(F.col("k") < 35, F.lit("CREATE_PROJECT")).otherwise(F.lit("ADD_TO_PROJECT_MEMBER_POOL"))
        .alias("PolicyType"),
        F.when(F.col("event_type") == "signup", F.lit("IAM_GROUP")).otherwise(F.lit("IAM_ROLE"))
        .alias("PrincipalType"),
        F.concat(F.lit("role-"), _s(F.expr("user_id div 10"))).alias("PrincipalArn"),
        F.when(F.col("value") >= 50, F.lit("true")).otherwise(F.lit("false")).alias("IncludeChildDomainUnits"))


# Routing configuration: a handful of rules (their size is known when built).
RULES = [
    ("asset-metadata", True, [CATALOG_SOURCE], [ASSET_ADDED, METADATA_ACCEPTED], [HOME_DOMAIN], None,
     [("Lambda", "invokeLambdaFunction", {"Name": "metadata_listener"})]),
    ("sql-asset-landing", True, [OBJECT_SOURCE], [OBJECT_CREATED], None, ["sql-assets"],
     [("Glue", "startWorkflowRun", {"Name": "deliver_workflow"}),
      ("SNS", "publish", {"Name": "landing_topic"})]),
    ("other-landing", True, [OBJECT_SOURCE], [OBJECT_CREATED], None, ["landing-other"],
     [("Glue", "startWorkflowRun", {"Name": "ingest_workflow"})]),
    ("switched-off", False, [CATALOG_SOURCE], [ASSET_ADDED], None, None,
     [("Lambda", "invokeLambdaFunction", {"Name": "unused"})]),
]
BUCKET_MAP = [("sql-assets", "landing-raw")]


def route_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, en, s, d, dom, b, [tuple(t) for t in ts])
                                  for n, en, s, d, dom, b, ts in RULES], RULE_SCHEMA)


def many_rules(customer: DataFrame) -> DataFrame:
    """Routing rules by the thousand, of the customers: one in each customer's
    own domain for one or both catalog types, one in five on all object events
    of its own bucket, and three on every object event."""
    k, key = F.col("c_custkey"), _s("c_custkey")
    text, target = "array<string>", "array<struct<service: string, action: string, parameters: map<string, string>>>"
    call = F.array(F.struct(F.lit("Lambda").alias("service"), F.lit("invokeLambdaFunction").alias("action"),
                            F.create_map(F.lit("Name"), F.concat(F.lit("fn-"), _s("c_nationkey"))).alias("parameters"))).cast(target)
    none = F.lit(None).cast(text)

    def rules(prefix: str, source: str, types: F.Column, domains: F.Column, buckets: F.Column, enabled: F.Column) -> DataFrame:
        return customer.select(F.concat(F.lit(prefix), key).alias("rule_name"), enabled.alias("enabled"), F.array(F.lit(source)).alias("source"),
                               types.cast(text).alias("detail_type"), domains.cast(text).alias("domains"), buckets.cast(text).alias("bucket_names"),
                               call.alias("targets"), k.alias("k"))

    own = rules("domain-", CATALOG_SOURCE, F.when(k % 2 == 0, F.array(F.lit(ASSET_ADDED))).otherwise(F.array(F.lit(ASSET_ADDED), F.lit(METADATA_ACCEPTED))),
                F.array(F.concat(F.lit("dzd-"), key)), none, k % 7 != 0)
    bucket = rules("bucket-", OBJECT_SOURCE, none, none, F.array(F.concat(F.lit("landing-"), key)), F.lit(True)).where("k % 5 = 0")
    every = rules("every-", OBJECT_SOURCE, F.array(F.lit(OBJECT_CREATED)), none, none, F.lit(True)).where("k IN (100, 200, 300)")
    return own.unionByName(bucket).unionByName(every).drop("k")


def spread_envelopes(events: DataFrame) -> DataFrame:
    """``envelopes`` in a world of many domains and buckets: each user's own."""
    user = F.replace(F.col("detail.metadata.owningProjectId"), F.lit("prj-"), F.lit(""))
    return envelopes(events).withColumn("detail", F.col("detail").withField("metadata.domain", F.concat(F.lit("dzd-"), user)).withField(
        "bucket.name", F.when(F.col("detail.bucket.name").isNotNull(), F.concat(F.lit("landing-"), user))))


def bucket_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUCKET_MAP, "logical string, real string")


# ---------------------------------------------------------------------------
# Staging: the given tables written as source drops (CSV files with fixed names)
# ---------------------------------------------------------------------------

def stage_csv(spark: SparkSession, df: DataFrame, folder: str, n_files: int | None = None,
              key: str | None = None) -> list[str]:
    """Write ``df`` as header CSV files named ``part-00000.csv``… under ``folder``.

    The rows are written by the executors into a hidden sibling folder, then
    the files are renamed into place (metadata only). With ``n_files`` and
    ``key`` the rows are hash-partitioned on ``key``, so writing the same rows
    again gives the same files; renaming over existing names rewrites those
    files in place (same path, new change time).
    """
    from lakeloom.sinks.tables import CSV_WRITE_OPTIONS
    from lakeloom.sources import fs

    tmp = f"{folder.rstrip('/')}/_incoming-{uuid.uuid4().hex[:8]}"
    out = df
    if n_files is not None:
        out = df.repartition(n_files, key) if key else df.repartition(n_files)
    out.write.options(**CSV_WRITE_OPTIONS).csv(tmp)
    names = []
    for i, path in enumerate(fs.list_data_files(spark, tmp, ".csv")):
        target = f"{folder.rstrip('/')}/part-{i:05d}.csv"
        fs.delete(spark, target, recursive=False)
        fs.rename(spark, path, target)
        names.append(target)
    fs.delete(spark, tmp)
    return names


def stage_lines(spark: SparkSession, lines: DataFrame, header: str, folder: str) -> None:
    """Write raw text lines (column ``value``) as files that each start with
    ``header``: exact bytes, no CSV quoting, e.g. for malformed lines."""
    import pandas as pd

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        for b in batches:
            yield b[["value"]]

    from lakeloom.session import ship_package

    ship_package(spark)
    lines.select("value").mapInPandas(with_header, "value string").write.text(folder)


def stage_text_files(spark: SparkSession, df: DataFrame, root: str, dir_col: str, name_col: str,
                     text_col: str) -> None:
    """Write one text file per row at ``<root>/<dir>/<name>`` (small config files).

    The tasks write the files in place. On a file system without a Python
    client they are written by a partitioned text write and renamed by the
    driver. ``dir_col`` may be null for files at the top level; a file without a
    name gets one.
    """
    from lakeloom.sources import fs

    d, n = F.coalesce(F.col(dir_col), F.lit("")), F.coalesce(F.col(name_col), F.lit(""))
    if fs.python_reaches(spark, root):
        path = F.concat(F.when(d != "", F.concat(d, F.lit("/"))).otherwise(F.lit("")), F.when(n != "", n).otherwise(F.lit("part-00000.txt")))
        files = df.select(path.alias("path"), F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")).alias("text"))
        fs.put_files(files.repartition("path").sortWithinPartitions("path"), root)
        return
    tmp = f"{root.rstrip('/')}/_incoming-{uuid.uuid4().hex[:8]}"
    (df.select(F.coalesce(F.col(dir_col), F.lit("")).alias("_d"), F.col(name_col).alias("_n"),
               F.col(text_col).alias("value"))
     .repartition("_d", "_n")
     .write.partitionBy("_d", "_n").text(tmp))
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .load(tmp).select("path"))
    # One small file per config row; the list of names is bounded by the rows.
    for r in listing.collect():
        parts = r["path"].split("/")
        d = _unescape(parts[-3].split("=", 1)[1])
        n = _unescape(parts[-2].split("=", 1)[1])
        target = "/".join(x for x in [root.rstrip("/"), d, n] if x)
        _mkparent(spark, target)
        fs.rename(spark, r["path"], target)
    fs.delete(spark, tmp)


def _unescape(v: str) -> str:
    from urllib.parse import unquote
    return "" if v == "__HIVE_DEFAULT_PARTITION__" else unquote(v)


def _mkparent(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p.getParent())
    return True
