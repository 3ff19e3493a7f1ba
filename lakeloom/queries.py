"""The registered queries: one Spark job per operator group of the survey.

Each query takes ``(spark, sf_dir)``, reads the given tables under ``sf_dir``
(whole tables, no sampling), stages whatever the operator needs (CSV drops,
JSON events, config files) in a fresh folder under the shared folder, runs the
library's operators and returns a DataFrame. ``lakeloom.oracle`` holds the same
results as DuckDB SQL over the parquet tables.

Staged CSV reads back as strings; every query casts to the oracle's types and
renders timestamps as text so that both sides compare exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom import standins as si
from lakeloom.functions import names as nm
from lakeloom.functions.stamps import date_parts
from lakeloom.operators.aggregates import grant_state as fold_grants
from lakeloom.operators.aggregates import rejected_requests
from lakeloom.operators.events import (ASSET_ADDED, CATALOG_SOURCE, METADATA_ACCEPTED,
                                       extract_by_type, match_events, route_events)
from lakeloom.operators.hierarchy import (effective_policies, fan_out_entities, fan_out_grants,
                                          hierarchy_closure, hierarchy_depths)
from lakeloom.operators.intervals import grant_intervals, grants_on, tree_intervals
from lakeloom.operators.lookups import enrich_asset, resolve_members
from lakeloom.operators.mapping import apply_mapper
from lakeloom.plans.delivery import deliver_entity as deliver
from lakeloom.plans.dictionary import asset_events, dictionary_rows as dict_rows
from lakeloom.plans.ingest import SimulatedCrash, ingest, ingest_and_register
from lakeloom.session import apply_runtime_defaults, scratch
from lakeloom.sinks.assets import run_sql_asset
from lakeloom.sinks.exports import EXPORT_KEYS, export_latest, notification_rows as notify
from lakeloom.sinks.snapshots import current_objects, read_dictionary
from lakeloom.sinks.tables import expire_partitions, expire_rows, read_lake_table
from lakeloom.sources import fs
from lakeloom.sources.configs import mapper_pairs, sql_asset
from lakeloom.sources.events import event_scan
from lakeloom.sources.files import discover_assets
from lakeloom.sources.lease import Fenced
from lakeloom.sources.manifest import read_manifest
from lakeloom.streaming.jobs import asset_event_stream, deliver_daily, ingest_on_arrival, ingest_stream_append

# Fixed run clocks of the staged runs (UTC) and the batch id of the first.
RUN1, RUN2, RUN3 = "2024-03-05 07:08:09", "2024-03-06 07:08:09", "2024-03-07 07:08:09"
RUN1_BATCH = 1709622489
# Orders before this date form the first drop, the rest the second.
DROP_SPLIT = "1998-01-01"
# Suppliers of nations below this key form file set a, the rest file set b.
NATION_SPLIT = 12
# Suppliers of nations from this key on are staged as malformed lines.
REJECT_NATION = 20

ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
              "o_orderpriority"]
SUPPLIER_COLS = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
TS_TEXT = "yyyy-MM-dd HH:mm:ss"
TS_MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return si.table(spark, sf_dir, name)


def _start(spark: SparkSession, name: str) -> str:
    apply_runtime_defaults(spark)
    return scratch(spark, name)


def _day(c: str) -> F.Column:
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd")


def _stage_orders_in_drops(spark: SparkSession, sf_dir: str, src: str) -> tuple[str, str]:
    orders = _t(spark, sf_dir, "orders")
    first = F.col("o_orderdate") < F.lit(DROP_SPLIT).cast("timestamp_ntz")
    si.stage_csv(spark, orders.where(first), f"{src}/drop1")
    return f"{src}/drop1", orders.where(~first)


# ---------------------------------------------------------------------------
# Ingest (S1–S3, P1–P3, J1, A1, A5, K1, K2)
# ---------------------------------------------------------------------------

def ingest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders land as CSV, are stamped and written by date."""
    work = _start(spark, "ingest_stamp")
    si.stage_csv(spark, _t(spark, sf_dir, "orders"), f"{work}/src")
    ingest(spark, "orders", f"{work}/src", f"{work}/lake", f"{work}/state", run_ts=RUN1)
    lake = read_lake_table(spark, f"{work}/lake", ORDER_COLS)
    return lake.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus",
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        _day("o_orderdate").alias("o_orderdate"),
        F.date_format("upload_time", TS_TEXT).alias("upload_time"), "year", "month", "day")


def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops in two runs, then a run with nothing new."""
    work = _start(spark, "ingest_incremental")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    _, rest = _stage_orders_in_drops(spark, sf_dir, src)
    ingest(spark, "orders", src, lake, state, run_ts=RUN1)
    si.stage_csv(spark, rest, f"{src}/drop2")
    ingest(spark, "orders", src, lake, state, run_ts=RUN2)
    ingest(spark, "orders", src, lake, state, run_ts=RUN3)  # empty: commits a marker only
    return read_lake_table(spark, lake, ORDER_COLS).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "day")


def ingest_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file rewritten in place (same path) is ingested again."""
    work = _start(spark, "ingest_modified")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS)
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    si.stage_csv(spark, sup.where(~in_b), f"{src}/a", n_files=2, key="s_suppkey")
    si.stage_csv(spark, sup.where(in_b), f"{src}/b", n_files=2, key="s_suppkey")
    ingest(spark, "supplier", src, lake, state, run_ts=RUN1)
    v2 = sup.where(in_b).withColumn("s_name", F.concat("s_name", F.lit("-v2")))
    si.stage_csv(spark, v2, f"{src}/b", n_files=2, key="s_suppkey")
    ingest(spark, "supplier", src, lake, state, run_ts=RUN2)
    return read_lake_table(spark, lake, SUPPLIER_COLS).select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "day")


def ingest_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash between write and commit; the retry rewrites the same
    batch (layout ``ymd_batch``), so every row is there once."""
    work = _start(spark, "ingest_retry")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    si.stage_csv(spark, _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS), src)
    try:
        ingest(spark, "supplier", src, lake, state, run_ts=RUN1, layout="ymd_batch",
               stop_after="write")
    except SimulatedCrash:
        pass
    ingest(spark, "supplier", src, lake, state, run_ts=RUN2, layout="ymd_batch")
    return read_lake_table(spark, lake, SUPPLIER_COLS, layout="ymd_batch").select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "batch_id", "day")


def ingest_header_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with reordered and extra columns combine by name."""
    work = _start(spark, "ingest_header_drift")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier")
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    si.stage_csv(spark, sup.where(~in_b).select("s_suppkey", "s_name", "s_nationkey"), f"{src}/a")
    si.stage_csv(spark, sup.where(in_b).select("s_acctbal", "s_nationkey", "s_suppkey", "s_name"),
                 f"{src}/b")
    res = ingest(spark, "supplier", src, lake, state, run_ts=RUN1)
    return read_lake_table(spark, lake, res.columns).select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name",
        F.col("s_nationkey").cast("int").alias("s_nationkey"),
        F.col("s_acctbal").cast("double").alias("s_acctbal"))


def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One call takes every file, two at a time, each batch its own id."""
    work = _start(spark, "ingest_chunks")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    si.stage_csv(spark, _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS), src, n_files=5, key="s_suppkey")
    ingest(spark, "supplier", src, lake, state, run_ts=RUN1, layout="ymd_batch", max_files=2)
    return read_lake_table(spark, lake, SUPPLIER_COLS, layout="ymd_batch").select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", (F.col("batch_id") - RUN1_BATCH < 3).alias("in_call"))


def _crash_then(spark: SparkSession, sf_dir: str, work: str, change) -> DataFrame:
    """Suppliers in two folders, a crash before the commit, ``change`` of the
    second folder, and a run that retries."""
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS)
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    si.stage_csv(spark, sup.where(~in_b), f"{src}/a", n_files=1, key="s_suppkey")
    si.stage_csv(spark, sup.where(in_b), f"{src}/b", n_files=1, key="s_suppkey")
    try:
        ingest(spark, "supplier", src, lake, state, run_ts=RUN1, layout="ymd_batch", stop_after="write")
    except SimulatedCrash:
        pass
    change(f"{src}/b", sup.where(in_b))
    ingest(spark, "supplier", src, lake, state, run_ts=RUN2, layout="ymd_batch")
    return read_lake_table(spark, lake, SUPPLIER_COLS, layout="ymd_batch").select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "day")


def ingest_retry_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 K1: a file is rewritten between crash and retry. The retry keeps the
    unchanged file, the next batch takes the new version, the old one is gone."""
    work = _start(spark, "ingest_retry_rewritten")
    return _crash_then(spark, sf_dir, work, lambda folder, rows: si.stage_csv(
        spark, rows.withColumn("s_name", F.concat("s_name", F.lit("-v2"))), folder, n_files=1, key="s_suppkey"))


def ingest_source_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a source file is deleted between crash and retry; the rest goes in."""
    work = _start(spark, "ingest_source_deleted")
    return _crash_then(spark, sf_dir, work, lambda folder, rows: fs.delete(spark, folder))


def ingest_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run stalls past its lease between write and commit, another run
    takes the context over, retries the batch and commits; the first one is
    fenced off. Every row is there once, committed under the second token."""
    work = _start(spark, "ingest_two_writers")
    args = (spark, "supplier", f"{work}/src", f"{work}/lake", f"{work}/state")
    si.stage_csv(spark, _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS), f"{work}/src", n_files=3, key="s_suppkey")
    fenced = False
    try:
        ingest(*args, run_ts=RUN1, layout="ymd_batch", lease_seconds=0,
               on_written=lambda: ingest(*args, run_ts=RUN2, layout="ymd_batch"))
    except Fenced:
        fenced = True
    tokens = read_manifest(spark, f"{work}/state").where("state = 'committed' AND path IS NOT NULL").agg(
        F.min("token").alias("first_token"), F.max("token").alias("last_token"), F.count(F.lit(1)).alias("n_commits")).first()
    rows = read_lake_table(spark, f"{work}/lake", SUPPLIER_COLS, layout="ymd_batch")
    return rows.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "batch_id", F.lit(fenced).alias("fenced"),
                       *[F.lit(v).cast("bigint").alias(k) for k, v in tokens.asDict().items()])


def ingest_header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another separator, spaces in the header, names that differ
    by case, and a source column of a stamp's name, which the stamp replaces."""
    work = _start(spark, "ingest_header_rules")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier")
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    si.stage_lines(spark, sup.where(~in_b).select(F.concat_ws(";", key, "s_name", F.lit("1999")).alias("value")),
                   "s_suppkey; s_name ;year", f"{src}/a")
    si.stage_lines(spark, sup.where(in_b).select(F.concat_ws(";", "s_name", nation, key).alias("value")),
                   "S_NAME;s_nationkey;S_SUPPKEY", f"{src}/b")
    res = ingest(spark, "supplier", src, lake, state, run_ts=RUN1, glob="*.txt", csv_options={"sep": ";"})
    return read_lake_table(spark, lake, res.columns).select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name",
        F.col("s_nationkey").cast("int").alias("s_nationkey"), "year")


def date_parts_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year / month / day parts of a timestamp, counted."""
    o = _t(spark, sf_dir, "orders")
    return (o.select(*date_parts(F.col("o_orderdate")))
            .groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n_orders")))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 (malformed lines): suppliers of the top nations are staged with an
    unquoted extra field; those lines land in the rejects output (with their
    parsed fields), and ingest goes on."""
    work = _start(spark, "ingest_rejects")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS)
    bad = F.col("s_nationkey") >= REJECT_NATION
    name = F.when(bad, F.concat("s_name", F.lit(",extra"))).otherwise(F.col("s_name"))
    lines = sup.select(F.concat_ws(",", F.col("s_suppkey").cast("string"), name,
                                   F.col("s_nationkey").cast("string"),
                                   F.col("s_acctbal").cast("string")).alias("value"))
    si.stage_lines(spark, lines, ",".join(SUPPLIER_COLS), f"{src}/drop")
    ingest(spark, "supplier", src, lake, state, run_ts=RUN1, rejects_dir=f"{work}/rejects",
           glob="*.txt")
    rej = spark.read.parquet(f"{work}/rejects")
    return rej.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name",
                      F.size(F.split("line", ",")).alias("n_fields"))


def register_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: two ingests, each followed by registration; the catalog table sees
    both runs' partitions."""
    work = _start(spark, "register_table")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    database = "lakeloom_" + work.rsplit("-", 1)[1]
    _, rest = _stage_orders_in_drops(spark, sf_dir, src)
    ingest_and_register(spark, "orders", src, lake, state, database, "orders_orders",
                        run_ts=RUN1, db_location=f"{work}/warehouse")
    si.stage_csv(spark, rest, f"{src}/drop2")
    ingest_and_register(spark, "orders", src, lake, state, database, "orders_orders",
                        run_ts=RUN2, db_location=f"{work}/warehouse")
    return spark.sql(f"SELECT year, month, day, count(*) AS n_orders, "
                     f"count(DISTINCT o_custkey) AS n_customers, max(typeof(o_custkey)) AS key_type, "
                     f"max(typeof(o_totalprice)) AS price_type, max(typeof(o_orderstatus)) AS status_type "
                     f"FROM `{database}`.orders_orders GROUP BY year, month, day")


TYPE_COLS = ["id", "zip", "long_id", "phone", "ordered_on", "flag", "price", "amount", "later_text", "note"]


def register_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: types by lexical profile over two runs. Leading zeros, 20-digit ids,
    signed phone numbers and padded decimals read back as written; ``amount``
    is whole in the first run, ``later_text`` a number."""
    work = _start(spark, "register_types")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    database = "lakeloom_" + work.rsplit("-", 1)[1]
    o, second = _t(spark, sf_dir, "orders"), F.col("o_orderdate") >= F.lit(DROP_SPLIT).cast("timestamp_ntz")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    rows = o.select(
        F.col("o_orderkey").alias("id"), F.lpad(cust, 8, "0").alias("zip"), F.concat(F.lit("9000000000"), F.lpad(key, 10, "0")).alias("long_id"),
        F.concat(F.lit("+34600"), F.lpad(cust, 6, "0")).alias("phone"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered_on"),
        F.when(F.col("o_orderstatus") == "O", "true").otherwise("false").alias("flag"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
        F.when(second, F.concat(cust, F.lit(".5"))).otherwise(cust).alias("amount"),
        F.when(second, F.concat(F.lit("n"), cust)).otherwise(cust).alias("later_text"), F.col("o_orderpriority").alias("note"), second.alias("second"))
    for drop, clock in ((False, RUN1), (True, RUN2)):
        si.stage_csv(spark, rows.where(F.col("second") == drop).select(TYPE_COLS), f"{src}/drop{int(drop)}")
        ingest_and_register(spark, "orders", src, lake, state, database, "orders_types", run_ts=clock, db_location=f"{work}/warehouse")
    t = spark.table(f"`{database}`.orders_types")
    kinds = ",".join(t.schema[c].dataType.simpleString() for c in TYPE_COLS)
    return t.select("id", *[F.col(c).cast("string").alias(c) for c in TYPE_COLS[1:]], F.lit(kinds).alias("kinds"))


def register_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 K2: files of two unrelated kinds in one source folder. Suppliers, with
    drifting headers, make one table, customers another."""
    work = _start(spark, "register_mixed")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    database = "lakeloom_" + work.rsplit("-", 1)[1]
    sup, in_b = _t(spark, sf_dir, "supplier"), F.col("s_nationkey") >= NATION_SPLIT
    si.stage_csv(spark, sup.where(~in_b).select("s_suppkey", "s_name", "s_nationkey"), f"{src}/a")
    si.stage_csv(spark, _t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), f"{src}/b")
    kw = {"db_location": f"{work}/warehouse", "families": 0.5}
    ingest_and_register(spark, "mixed", src, lake, state, database, "mixed", run_ts=RUN1, **kw)
    si.stage_csv(spark, sup.where(in_b).select("s_acctbal", "s_nationkey", "s_suppkey", "s_name"), f"{src}/c")
    ingest_and_register(spark, "mixed", src, lake, state, database, "mixed", run_ts=RUN2, **kw)
    one, two = spark.table(f"`{database}`.mixed_f0"), spark.table(f"`{database}`.mixed_f1")
    none = F.lit(None).cast("string")
    return one.select(F.lit("f0").alias("family"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("extra"),
                      F.col("s_acctbal").cast("double").alias("balance"), "day").unionByName(
        two.select(F.lit("f1").alias("family"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                   F.col("c_mktsegment").alias("extra"), none.cast("double").alias("balance"), "day"))


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a managed table partitioned by order date; partitions more than 90
    days before the latest date are dropped (files included)."""
    work = _start(spark, "retention_keep")
    database = "lakeloom_" + work.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{work}/warehouse/{database}.db'")
    o = _t(spark, sf_dir, "orders")
    parts = ["year", "month", "day"]
    (o.select("o_orderkey", "o_orderstatus", "o_orderdate", *date_parts(F.col("o_orderdate")))
     .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *parts)  # one file per date
     .write.partitionBy(*parts).format("parquet").saveAsTable(f"`{database}`.orders_by_day"))
    latest = o.agg(F.max("o_orderdate").alias("m")).first()["m"]  # one value
    expire_partitions(spark, f"`{database}`.orders_by_day", keep_days=90, now=latest.date())
    return spark.table(f"`{database}`.orders_by_day").select(
        "o_orderkey", "o_orderstatus", _day("o_orderdate").alias("o_orderdate"))


def retention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: a managed table without partitions is rewritten without the rows
    more than 90 days before the latest date."""
    work = _start(spark, "retention_rows")
    database = "lakeloom_" + work.rsplit("-", 1)[1]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{work}/warehouse/{database}.db'")
    o = _t(spark, sf_dir, "orders")
    o.select("o_orderkey", "o_orderstatus", "o_orderdate").write.format("parquet").saveAsTable(f"`{database}`.all_orders")
    latest = o.agg(F.max("o_orderdate").alias("m")).first()["m"]  # one value
    name, _ = expire_rows(spark, f"`{database}`.all_orders", "o_orderdate", keep_days=90, now=latest)
    return spark.table(name).select("o_orderkey", "o_orderstatus", _day("o_orderdate").alias("o_orderdate"))


# ---------------------------------------------------------------------------
# Config records: mapper, SQL asset, asset discovery
# ---------------------------------------------------------------------------

CUSTOMER_MAPPER = [("c_custkey", "customer_id"), ("c_name", "c_name"),
                   ("c_mktsegment", "segment"), ("c_acctbal", "balance")]


def _stage_mapper(spark: SparkSession, path: str, pairs: list[tuple[str, str]]) -> None:
    lines = ["# columns delivered downstream", "from,to"] + [f"{a},{b}" for a, b in pairs]
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)


def mapper_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapper file (with a comment line) selects and renames columns."""
    work = _start(spark, "mapper_project")
    _stage_mapper(spark, f"{work}/mapper", CUSTOMER_MAPPER)
    return apply_mapper(_t(spark, sf_dir, "customer"), mapper_pairs(spark, f"{work}/mapper"))


# The SQL asset kept as a CSV record: commas, a double-quoted literal (doubled
# in the file), newlines and a trailing semicolon. It reads its own table name.
SALES_QUERY = """SELECT r.r_name AS region,
       count(*) AS n_customers,
       round(sum(c.c_acctbal), 2) AS total_sales,
       sum(CASE WHEN c.c_mktsegment <> "NONE" THEN 1 ELSE 0 END) AS n_segmented
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name;"""


def _stage_sql_asset(spark: SparkSession, path: str, database: str, table: str, query: str) -> None:
    quoted = '"' + query.replace('"', '""') + '"'
    text = f"database_name,table_name,sql_query\n{database},{table},{quoted}"
    spark.createDataFrame([(text,)], "value string").write.text(path)


def sql_asset_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read the asset record, run its query, publish it as a view."""
    work = _start(spark, "sql_asset_run")
    for name in ("customer", "nation", "region"):
        _t(spark, sf_dir, name).createOrReplaceTempView(name)
    _stage_sql_asset(spark, f"{work}/asset", "sales_pub_db", "customer", SALES_QUERY)
    database, table, query = sql_asset(spark, f"{work}/asset")
    name, view = run_sql_asset(spark, database, table, query, location=f"{work}/warehouse")
    for left in ("customer", "nation", "region", name):  # the result is planned; the session keeps no views of it
        spark.catalog.dropTempView(left)
    return view


def asset_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL assets ``<project>/<entity>_sql.csv`` (one per supplier, project =
    its nation) and mappers (one per nation) are found; readmes and nested
    mapper folders are skipped."""
    work = _start(spark, "asset_discovery")
    nation = _t(spark, sf_dir, "nation")
    n = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    assets = n.select(nm.squash_name("n_name").alias("d"),
                      F.concat(F.lower("s_name"), F.lit("_sql.csv")).alias("f"),
                      F.concat(F.lit("database_name,table_name,sql_query\n"),
                               nm.squash_name("n_name"), F.lit("_pub_db,"), F.lower("s_name"),
                               F.lit(",SELECT 1")).alias("v"))
    readmes = spark.range(1).select(F.lit(None).cast("string").alias("d"), F.lit("README.md").alias("f"),
                                    F.lit("notes").alias("v"))
    inner_readme = nation.select(nm.squash_name("n_name").alias("d"), F.lit("Readme.MD").alias("f"),
                                 F.lit("notes").alias("v"))
    si.stage_text_files(spark, assets.unionByName(readmes).unionByName(inner_readme),
                        f"{work}/sql", "d", "f", "v")
    mappers = nation.select(F.lit(None).cast("string").alias("d"),
                            F.concat(nm.snake_name("n_name"), F.lit("_mapper_config.csv")).alias("f"),
                            F.lit("from,to\na,b").alias("v"))
    nested = nation.select(F.lit("old").alias("d"),
                           F.concat(nm.snake_name("n_name"), F.lit("_mapper_config.csv")).alias("f"),
                           F.lit("from,to\na,b").alias("v"))
    si.stage_text_files(spark, mappers.unionByName(readmes).unionByName(nested),
                        f"{work}/mappers", "d", "f", "v")
    return discover_assets(spark, f"{work}/sql", f"{work}/mappers").select("kind", "project", "entity")


# ---------------------------------------------------------------------------
# Events (S7, P7–P12, J2, J8, A3, K5, K6)
# ---------------------------------------------------------------------------

def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.envelopes(_t(spark, sf_dir, "events"))


def event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON envelopes are scanned and matched on source, type and the
    nested domain."""
    work = _start(spark, "event_match")
    path = si.stage_events_json(spark, sf_dir, f"{work}/events")
    m = match_events(event_scan(spark, path), [CATALOG_SOURCE], [ASSET_ADDED, METADATA_ACCEPTED],
                     [si.HOME_DOMAIN])
    return m.select("id", F.col("`detail-type`").alias("detail_type"),
                    F.col("detail.metadata.domain").alias("domain"))


def event_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events × the rule table (logical bucket names resolved) → one
    row per target."""
    r = route_events(_envelopes(spark, sf_dir), si.route_rules(spark), si.bucket_map(spark))
    return r.select("id", "rule_name", "service", "action", "supported")


def event_route_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands of rules, matched by the keys of the rule index."""
    r = route_events(si.spread_envelopes(_t(spark, sf_dir, "events")), si.many_rules(_t(spark, sf_dir, "customer")))
    return r.select("id", "rule_name", F.element_at("parameters", "Name").alias("target"))


def event_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and asset ids from type-dependent paths."""
    x = extract_by_type(_envelopes(spark, sf_dir))
    return x.select("id", F.col("`detail-type`").alias("detail_type"), "user_id", "asset_id",
                    "project_id", "known")


def _matched_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_by_type(match_events(_envelopes(spark, sf_dir), [CATALOG_SOURCE], None,
                                        [si.HOME_DOMAIN]))


def _lookups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    return (si.projects(_t(spark, sf_dir, "customer")), si.units(nation), si.domains(spark),
            si.assets(region, nation))


def asset_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project, unit, domain and asset lookups by join; misses listed."""
    e = enrich_asset(_matched_catalog(spark, sf_dir), *_lookups(spark, sf_dir))
    return e.select("id", "project_name", "domain_unit_name", "domain_name", "asset_name",
                    "asset_revision", F.array_join("missing", ",").alias("missing"))


def dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset documents (JSON inside JSON) → column records."""
    return dict_rows(si.part_assets(_t(spark, sf_dir, "part"), _t(spark, sf_dir, "lineitem")))


def latest_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 K5: the latest event per user (by time, then id) in an export table; a
    second export of the same keys replaces their rows and keeps the others."""
    work = _start(spark, "latest_export")
    ev = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    early = ev.where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    export_latest(early, f"{work}/export", ["user_id"], ["ts", "event_id"])
    export_latest(ev, f"{work}/export", ["user_id"], ["ts", "event_id"])
    back = (spark.read.schema("user_id BIGINT, event_id BIGINT, ts STRING, event_type STRING, value DOUBLE")
            .option("header", "true").csv(f"{work}/export"))
    return back.select("user_id", "event_id", "event_type", "value")


def asset_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched catalog events that cannot be exported, with the
    reason (unknown type, failed lookups, missing form)."""
    ev = asset_events(_envelopes(spark, sf_dir), *_lookups(spark, sf_dir), si.HOME_DOMAIN)
    return ev.where(F.col("reject_reason").isNotNull()).select("event_id", "reject_reason")


def notification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: one message row per good dictionary event: key and link expiry."""
    good = asset_events(_envelopes(spark, sf_dir), *_lookups(spark, sf_dir), si.HOME_DOMAIN)
    good = good.where(F.col("reject_reason").isNull())
    n = notify(good.select("event_id", *EXPORT_KEYS, F.col("event_time").alias("created")),
               "dictionary-exports")
    return n.select("event_id", "subject", "bucket", "key",
                    F.date_format("expires_at", TS_MICROS).alias("expires_at"))


# ---------------------------------------------------------------------------
# Governance
# ---------------------------------------------------------------------------

def member_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup key wins over the literal id; rows with neither user nor
    group are dropped."""
    m = resolve_members(si.members(_t(spark, sf_dir, "customer")), si.users(_t(spark, sf_dir, "nation")))
    return m.where("keep").select("member", "project", "designation", "resolved_user",
                                  "groupIdentifier", "unknown_key")


def entity_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, project) × entities → one row each with derived names."""
    u = si.hierarchy_units(_t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"))
    return fan_out_entities(u).select("parent_unit", "unit", "project", "entity_type", "source_bucket",
                                      "schedule", "entity_path", "target_bucket", "database",
                                      "table_prefix", "project_key")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.tree_edges(_t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation"),
                         _t(spark, sf_dir, "customer"))


def hierarchy_closure_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with each of its ancestors and the distance."""
    _start(spark, "hierarchy_closure")
    return hierarchy_closure(spark, _edges(spark, sf_dir))


def hierarchy_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of a tree that is hundreds of levels
    deep and more, by pointer doubling."""
    _start(spark, "hierarchy_deep")
    return hierarchy_depths(spark, si.chain_edges(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")))


GRANT_CREATOR = "role-admin"
GRANT_USERS = ["role-analyst", "role-admin", "role-steward"]


def grant_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit × the creator and user roles; a unit per customer."""
    units = _t(spark, sf_dir, "customer").select(F.concat(F.lit("unit-"), F.col("c_custkey")).alias("id"))
    return fan_out_grants(units, "id", GRANT_CREATOR, GRANT_USERS)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.grant_requests(_t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer"),
                             _t(spark, sf_dir, "nation"))


def grant_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the latest request per grant key decides; Delete removes."""
    g = fold_grants(_requests(spark, sf_dir))
    return g.select("DomainIdentifier", "EntityIdentifier", "EntityType", "PolicyType", "principal_kind",
                    "PrincipalArn", "request_id", "RequestType", "include_child")


def grant_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: requests with an unknown policy type or principal fail; listed."""
    r = rejected_requests(_requests(spark, sf_dir))
    return r.select("request_id", "PolicyType", "PrincipalType")


def _current_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_grants(_requests(spark, sf_dir)).select(
        F.col("EntityIdentifier").alias("entity"), "PolicyType", "principal_kind", "PrincipalArn",
        "include_child")


def grant_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants cover their entity and, with the child flag, all descendants;
    per node, policy and kind of principal, how many act on it."""
    _start(spark, "grant_effective")
    closure = hierarchy_closure(spark, _edges(spark, sf_dir))
    return effective_policies(_current_grants(spark, sf_dir), closure, ["PolicyType", "principal_kind"])


def grant_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 in linear size: one row per node with the numbers of its subtree, one
    per grant with the numbers of the nodes it acts on."""
    _start(spark, "grant_listing")
    iv = tree_intervals(_edges(spark, sf_dir)).checkpoint()
    nodes = iv.select(F.lit("node").alias("kind"), F.col("node").alias("entity"), *[F.lit(None).cast("string").alias(c) for c in (
        "PolicyType", "principal_kind", "PrincipalArn")], F.lit(None).cast("boolean").alias("include_child"), "lo", "hi")
    return nodes.unionByName(grant_intervals(_current_grants(spark, sf_dir), iv).withColumn("kind", F.lit("grant")))


def grant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grants that act on each of the nodes asked about."""
    _start(spark, "grant_lookup")
    iv = tree_intervals(_edges(spark, sf_dir)).checkpoint()
    asked = si.asked_nodes(*(_t(spark, sf_dir, t) for t in ("region", "nation", "customer")))
    return grants_on(asked, grant_intervals(_current_grants(spark, sf_dir), iv), iv)


# ---------------------------------------------------------------------------
# Delivery (K4, T2) and names
# ---------------------------------------------------------------------------

DELIVERY_QUERY = ("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderstatus, "
                  "CAST(o_totalprice AS DOUBLE) AS o_totalprice, upload_time FROM increment;")
DELIVERY_MAPPER = [("o_orderkey", "order_id"), ("o_orderstatus", "status"),
                   ("o_totalprice", "total_price")]


def deliver_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: two daily runs deliver only what was ingested since the last one."""
    work = _start(spark, "deliver_entity")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    out = f"{work}/downstream/{'/'.join(['central', 'orders', 'orders'])}"
    _, rest = _stage_orders_in_drops(spark, sf_dir, src)
    ingest(spark, "orders", src, lake, state, run_ts=RUN1)
    deliver(spark, "deliver-orders", lake, ORDER_COLS, f"{work}/delivery_state", out,
            DELIVERY_MAPPER, DELIVERY_QUERY, run_ts=RUN1)
    si.stage_csv(spark, rest, f"{src}/drop2")
    ingest(spark, "orders", src, lake, state, run_ts=RUN2)
    deliver(spark, "deliver-orders", lake, ORDER_COLS, f"{work}/delivery_state", out,
            DELIVERY_MAPPER, DELIVERY_QUERY, run_ts=RUN2)
    deliver(spark, "deliver-orders", lake, ORDER_COLS, f"{work}/delivery_state", out,
            DELIVERY_MAPPER, DELIVERY_QUERY, run_ts=RUN3)
    back = spark.read.schema("order_id BIGINT, status STRING, total_price DOUBLE, "
                             "run_date STRING, batch_id BIGINT").json(out)
    return back.select("order_id", "status", "total_price", "run_date")


SUPPLIER_PAIRS = [("s_suppkey", "supplier_id"), ("s_name", "supplier")]


def deliver_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a file at a time, in one call, from a lake whose older day is written
    last; nothing is left out."""
    work = _start(spark, "deliver_chunked")
    lake, out = f"{work}/lake", f"{work}/downstream"
    sup = _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS)
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    for part, cond, clock in (("a", ~in_b, RUN2), ("b", in_b, RUN1)):
        si.stage_csv(spark, sup.where(cond), f"{work}/{part}", n_files=1, key="s_suppkey")
        ingest(spark, part, f"{work}/{part}", lake, f"{work}/state", run_ts=clock)
    deliver(spark, "deliver", lake, SUPPLIER_COLS, f"{work}/delivery_state", out, SUPPLIER_PAIRS, run_ts=RUN3, max_files=1)
    deliver(spark, "deliver", lake, SUPPLIER_COLS, f"{work}/delivery_state", out, SUPPLIER_PAIRS, run_ts=RUN3)
    back = spark.read.schema("supplier_id STRING, supplier STRING").json(out)
    return back.select(F.col("supplier_id").cast("bigint").alias("supplier_id"), "supplier")


def deliver_after_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: rows of a batch that crashed are delivered after its retry, once."""
    work = _start(spark, "deliver_after_retry")
    src, lake, state, out = f"{work}/src", f"{work}/lake", f"{work}/state", f"{work}/downstream"
    si.stage_csv(spark, _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS), src, n_files=1, key="s_suppkey")
    kw = {"layout": "ymd_batch", "ingest_ctx": "supplier", "ingest_state": state}
    try:
        ingest(spark, "supplier", src, lake, state, run_ts=RUN1, layout="ymd_batch", stop_after="write")
    except SimulatedCrash:
        pass
    deliver(spark, "deliver", lake, SUPPLIER_COLS, f"{work}/delivery_state", out, SUPPLIER_PAIRS, run_ts=RUN1, **kw)
    ingest(spark, "supplier", src, lake, state, run_ts=RUN2, layout="ymd_batch")
    deliver(spark, "deliver", lake, None, f"{work}/delivery_state", out, SUPPLIER_PAIRS, run_ts=RUN2, **kw)
    back = spark.read.schema("supplier_id STRING, supplier STRING, run_date STRING").json(out)
    return back.select(F.col("supplier_id").cast("bigint").alias("supplier_id"), "supplier", "run_date")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13 P14 P15 P18 over part and supplier names."""
    p = _t(spark, sf_dir, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
        nm.snake_name("p_name").alias("snake"), nm.squash_name("p_name").alias("squash"),
        nm.database_name("p_brand").alias("database"),
        nm.target_name(F.concat(F.lit("source-"), F.col("p_type"), F.lit("-source-"), F.col("p_name")))
        .alias("target"),
        nm.composite_id_part(F.concat_ws("|", "p_brand", "p_type"), 2).alias("second"))
    s = _t(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"),
        nm.snake_name("s_name").alias("snake"), nm.squash_name("s_name").alias("squash"),
        nm.database_name("s_name").alias("database"),
        nm.target_name(F.col("s_name")).alias("target"),
        nm.composite_id_part(F.concat_ws("|", "s_name", F.col("s_nationkey").cast("string")), 2)
        .alias("second"))
    return p.unionByName(s)


def object_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object URL → bucket (part 2) and key (parts 3…)."""
    return _t(spark, sf_dir, "pages").select(
        "page_id", nm.object_bucket("url").alias("bucket"), nm.object_key("url").alias("key"))


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------

def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV drops stream in one file per micro-batch, stamped and written
    keyed by the micro-batch; the result equals the batch ingest."""
    work = _start(spark, "stream_ingest")
    orders = _t(spark, sf_dir, "orders")
    si.stage_csv(spark, orders, f"{work}/src", n_files=4, key="o_orderkey")
    q = ingest_stream_append(spark, f"{work}/src", f"{work}/lake", ORDER_COLS, f"{work}/checkpoint",
                             max_files_per_trigger=1, clock=lambda b: RUN1)
    q.awaitTermination()
    return read_lake_table(spark, f"{work}/lake", ORDER_COLS, layout="ymd_batch").select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus",
        F.date_format("upload_time", TS_TEXT).alias("upload_time"))


def stream_ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving files trigger the manifest ingest; two drops, headers
    in another order, each file once."""
    work = _start(spark, "stream_ingest_manifest")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    sup = _t(spark, sf_dir, "supplier")
    in_b = F.col("s_nationkey") >= NATION_SPLIT
    si.stage_csv(spark, sup.where(~in_b).select("s_suppkey", "s_name"), f"{src}/a", n_files=1, key="s_suppkey")
    for drop, clock in ((None, RUN1), ("b", RUN2)):
        if drop:
            si.stage_csv(spark, sup.where(in_b).select("s_name", "s_suppkey"), f"{src}/{drop}", n_files=1, key="s_suppkey")
        ingest_on_arrival(spark, "supplier", src, lake, state, f"{work}/checkpoint", clock=lambda b, c=clock: c).awaitTermination()
    return read_lake_table(spark, lake, ["s_suppkey", "s_name"]).select(
        F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", "day")


def stream_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lake table streams to the entity. A second stream with a new
    checkpoint delivers anew, on a later day, and replaces nothing."""
    work = _start(spark, "stream_deliver")
    src, lake, out = f"{work}/src", f"{work}/lake", f"{work}/downstream"
    si.stage_csv(spark, _t(spark, sf_dir, "supplier").select(*SUPPLIER_COLS), src, n_files=1, key="s_suppkey")
    ingest(spark, "supplier", src, lake, f"{work}/state", run_ts=RUN1)
    for k, clock in enumerate((RUN1, RUN1, RUN2)):  # the second run of the first checkpoint finds nothing new
        deliver_daily(spark, lake, SUPPLIER_COLS, out, SUPPLIER_PAIRS, f"{work}/checkpoint{k // 2}",
                      clock=lambda b, c=clock: c).awaitTermination()
    back = spark.read.schema("supplier_id STRING, supplier STRING, run_date STRING").json(out)
    return back.select(F.col("supplier_id").cast("bigint").alias("supplier_id"), "supplier", "run_date")


def stream_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON events stream through match → extract → enrich → unnest; the
    dictionary exports (one CSV per domain/unit/project/asset) are read back
    through the latest snapshot."""
    work = _start(spark, "stream_assets")
    path = si.stage_events_json(spark, sf_dir, f"{work}/events")
    q = asset_event_stream(spark, path, *_lookups(spark, sf_dir), si.HOME_DOMAIN,
                           f"{work}/export", f"{work}/notify", f"{work}/rejects", f"{work}/checkpoint",
                           max_files_per_trigger=4)
    q.awaitTermination()
    return read_dictionary(spark, f"{work}/export")


def stream_assets_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive out of order, one file per micro-batch; every
    asset's object is still that of its latest event."""
    work = _start(spark, "stream_assets_late")
    si.envelopes(_t(spark, sf_dir, "events")).repartition(3, "id").write.json(f"{work}/events")
    asset_event_stream(spark, f"{work}/events", *_lookups(spark, sf_dir), si.HOME_DOMAIN,
                       f"{work}/export", f"{work}/notify", f"{work}/rejects", f"{work}/checkpoint",
                       max_files_per_trigger=1).awaitTermination()
    return current_objects(spark, f"{work}/export").select(
        *EXPORT_KEYS, "event_id", F.date_format("event_time", TS_MICROS).alias("event_time"), "n_columns")


# ---------------------------------------------------------------------------
# The minimum slice: land → stamp → register → SQL asset → mapper
# ---------------------------------------------------------------------------

STATUS_QUERY = ("SELECT o_orderstatus, count(*) AS n_orders, "
                "round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS revenue "
                "FROM orders_orders GROUP BY o_orderstatus;")
STATUS_MAPPER = [("o_orderstatus", "status"), ("n_orders", "n_orders"), ("revenue", "revenue")]


def status_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders land as CSV → ingest → register → SQL asset → mapper."""
    work = _start(spark, "status_revenue")
    src, lake, state = f"{work}/src", f"{work}/lake", f"{work}/state"
    database = "orders_" + work.rsplit("-", 1)[1]
    si.stage_csv(spark, _t(spark, sf_dir, "orders"), src)
    ingest_and_register(spark, "orders", src, lake, state, database, "orders_orders", run_ts=RUN1,
                        db_location=f"{work}/warehouse")
    _stage_sql_asset(spark, f"{work}/asset", database, "status_revenue", STATUS_QUERY)
    db, table, query = sql_asset(spark, f"{work}/asset")
    _, view = run_sql_asset(spark, db, table, query, location=f"{work}/warehouse")
    _stage_mapper(spark, f"{work}/mapper", STATUS_MAPPER)
    return apply_mapper(view, mapper_pairs(spark, f"{work}/mapper"))


def _pinned(fn):
    """Run a query under the library's session settings (UTC time zone, AQE),
    whatever session the caller passes."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_defaults(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {
    "status_revenue": status_revenue,
    "ingest_stamp": ingest_stamp,
    "ingest_incremental": ingest_incremental,
    "ingest_modified": ingest_modified,
    "ingest_retry": ingest_retry,
    "ingest_header_drift": ingest_header_drift,
    "ingest_chunks": ingest_chunks,
    "ingest_retry_rewritten": ingest_retry_rewritten,
    "ingest_source_deleted": ingest_source_deleted,
    "ingest_header_rules": ingest_header_rules,
    "ingest_two_writers": ingest_two_writers,
    "deliver_chunked": deliver_chunked,
    "deliver_after_retry": deliver_after_retry,
    "stream_ingest_manifest": stream_ingest_manifest,
    "stream_deliver": stream_deliver,
    "date_parts": date_parts_count,
    "mapper_project": mapper_project,
    "asset_discovery": asset_discovery,
    "sql_asset_run": sql_asset_run,
    "ingest_rejects": ingest_rejects,
    "register_table": register_table_query,
    "register_types": register_types,
    "register_mixed": register_mixed,
    "event_match": event_match,
    "event_route": event_route,
    "event_route_many": event_route_many,
    "event_extract": event_extract,
    "asset_enrich": asset_enrich,
    "dictionary_rows": dictionary_rows,
    "latest_export": latest_export,
    "member_resolve": member_resolve,
    "entity_fan_out": entity_fan_out,
    "hierarchy_closure": hierarchy_closure_query,
    "grant_fan_out": grant_fan_out,
    "grant_state": grant_state,
    "grant_effective": grant_effective,
    "grant_listing": grant_listing,
    "grant_lookup": grant_lookup,
    "hierarchy_deep": hierarchy_deep,
    "grant_rejects": grant_rejects,
    "retention_keep": retention_keep,
    "retention_rows": retention_rows,
    "deliver_entity": deliver_entity,
    "names": names,
    "object_path": object_path,
    "notification_rows": notification_rows,
    "asset_rejects": asset_rejects,
    "stream_ingest": stream_ingest,
    "stream_assets": stream_assets,
    "stream_assets_late": stream_assets_late,
}
QUERIES = {name: _pinned(fn) for name, fn in QUERIES.items()}

__all__ = ["QUERIES", "METADATA_ACCEPTED"]
