"""Event matching, routing and type-dependent extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The catalog event types and field paths per type.
ASSET_ADDED = "Asset Added To Catalog"
METADATA_ACCEPTED = "Metadata Generation Accepted"
CATALOG_SOURCE = "aws.datazone"
OBJECT_SOURCE = "aws.s3"
OBJECT_CREATED = "Object Created"

# Target (service, action) pairs that can be routed; anything else is rejected.
SUPPORTED_TARGETS = [("Glue", "startWorkflowRun"), ("Lambda", "invokeLambdaFunction")]

RULE_SCHEMA = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("source", T.ArrayType(T.StringType())),
    T.StructField("detail_type", T.ArrayType(T.StringType())),
    T.StructField("domains", T.ArrayType(T.StringType())),
    T.StructField("bucket_names", T.ArrayType(T.StringType())),
    T.StructField("targets", T.ArrayType(T.StructType([
        T.StructField("service", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("parameters", T.MapType(T.StringType(), T.StringType())),
    ]))),
])


def match_events(events: DataFrame, sources: list[str], detail_types: list[str] | None = None,
                 domains: list[str] | None = None, buckets: list[str] | None = None) -> DataFrame:
    """Keep events whose source, type and nested domain / bucket are listed.

    A ``None`` list does not restrict. Pushed into the scan where the source
    supports it.
    """
    cond = F.col("source").isin(sources)
    if detail_types is not None:
        cond = cond & F.col("`detail-type`").isin(detail_types)
    if domains is not None:
        cond = cond & F.col("detail.metadata.domain").isin(domains)
    if buckets is not None:
        cond = cond & F.col("detail.bucket.name").isin(buckets)
    return events.where(cond)


def resolve_rule_buckets(rules: DataFrame, bucket_map: DataFrame | None) -> DataFrame:
    """Rules with one row per bucket, logical names resolved.

    Rules without a bucket list keep one row with a null bucket; names that
    resolve to one bucket give one row.
    """
    from lakeloom.operators.lookups import lookup_or_self

    rules = rules.withColumn("_rule", F.to_json(F.struct(*rules.columns)))
    exploded = rules.select("*", F.explode_outer("bucket_names").alias("bucket"))
    if bucket_map is not None:
        exploded = lookup_or_self(exploded, "bucket", bucket_map, "logical", "real")
    return exploded.dropDuplicates(["_rule", "bucket"]).drop("bucket_names", "_rule")


# What stands for "any" in a rule's key, beside a listed value.
_ANY, _LISTED = "*", "="


def rule_index(rules: DataFrame, bucket_map: DataFrame | None = None) -> DataFrame:
    """The enabled rules as keys: one row per listed (source, type, domain,
    bucket), with ``*`` for what a rule does not restrict: columns r_source,
    r_type, r_domain, r_bucket, rule_name and targets."""
    # A catalog rule tests only "domain is ours": without a domain list it is
    # skipped, and a bucket list on it is ignored.
    catalog = F.coalesce(F.get("source", F.lit(0)) == CATALOG_SOURCE, F.lit(False))  # the first source decides
    live = rules.where(F.coalesce("enabled", F.lit(True)) & ~(catalog & F.coalesce(F.size("domains") <= 0, F.lit(True))))
    live = live.withColumn("bucket_names", F.when(~catalog, F.col("bucket_names")))
    r = resolve_rule_buckets(live, bucket_map)

    def keys(c: str) -> Column:
        listed = F.transform(F.array_distinct(F.array_compact(c)), lambda x: F.concat(F.lit(_LISTED), x))
        return F.when(F.col(c).isNull(), F.array(F.lit(_ANY))).otherwise(listed)

    r = r.withColumn("r_source", F.explode(F.array_distinct(F.array_compact("source"))))
    r = r.withColumn("r_type", F.explode(keys("detail_type"))).withColumn("r_domain", F.explode(keys("domains")))
    bucket = F.when(F.col("bucket").isNull(), F.lit(_ANY)).otherwise(F.concat(F.lit(_LISTED), F.col("bucket")))
    return r.select("r_source", "r_type", "r_domain", bucket.alias("r_bucket"), "rule_name", "targets")


def route_events(events: DataFrame, rules: DataFrame, bucket_map: DataFrame | None = None,
                 max_rule_rows: int = 200_000) -> DataFrame:
    """One row per (event, matching enabled rule, target).

    Rule semantics: source ∈ rule sources, type ∈ rule types (if listed);
    catalog rules match ``detail.metadata.domain`` ∈ domains, other rules
    ``detail.bucket.name`` ∈ buckets (if listed).

    The rules become an index of keys (``rule_index``). An event has at most
    eight keys, its own values or ``*`` for type, domain and bucket, of which
    only the combinations that some rule uses are made; each is looked up by an
    equality join, so the work per event does not grow with the number of rules.
    An index that passes the size check is broadcast and events are not
    shuffled; a larger one is joined by ``skew_join``, since a key without a
    domain or bucket may be that of very many events. Columns added: rule_name,
    service, action, parameters, supported.
    """
    from lakeloom.operators.lookups import skew_join

    index = rule_index(rules, bucket_map)
    any_of = [F.col(c) == _ANY for c in ("r_type", "r_domain", "r_bucket")]
    forms = [tuple(r) for r in index.select(*[x.alias(f"a{i}") for i, x in enumerate(any_of)]).distinct().collect()]  # at most eight
    own = [F.concat(F.lit(_LISTED), F.col(c)) for c in ("`detail-type`", "detail.metadata.domain", "detail.bucket.name")]
    keys = F.array(*[F.struct(*[(F.lit(_ANY) if wild else value).alias(f"k{i}") for i, (wild, value) in enumerate(zip(form, own))])
                     for form in sorted(forms)]) if forms else F.array().cast("array<struct<k0: string, k1: string, k2: string>>")
    e = events.withColumn("_k", F.explode(keys)).select(*[f"`{c}`" for c in events.columns], F.col("source").alias("_s"), "_k.k0", "_k.k1", "_k.k2")
    matched = skew_join(e, index, [("_s", "r_source"), ("k0", "r_type"), ("k1", "r_domain"), ("k2", "r_bucket")],
                        salt_by=[c for c, t in e.dtypes if "map<" not in t], max_rows=max_rule_rows)
    pairs = F.array(*[F.struct(F.lit(s).alias("service"), F.lit(a).alias("action"))
                      for s, a in SUPPORTED_TARGETS])
    return (matched.select(*[f"`{c}`" for c in events.columns], "rule_name", F.explode("targets").alias("t"))
            .select("*", F.col("t.service").alias("service"), F.col("t.action").alias("action"),
                    F.col("t.parameters").alias("parameters"))
            .drop("t")
            .withColumn("supported", F.array_contains(
                pairs, F.struct(F.col("service").alias("service"), F.col("action").alias("action")))))


def _by_type(added: Column, accepted: Column) -> Column:
    dt = F.col("`detail-type`")
    return F.when(dt == ASSET_ADDED, added).when(dt == METADATA_ACCEPTED, accepted)


def extract_by_type(events: DataFrame) -> DataFrame:
    """User and asset ids from type-dependent paths, shared fields as is.

    Adds ``known`` (false for any other event type: those go to rejects).
    """
    return events.select(
        "*",
        _by_type(F.col("detail.metadata.user"), F.col("detail.data.userId")).alias("user_id"),
        _by_type(F.col("detail.data.assetId"), F.col("detail.metadata.id")).alias("asset_id"),
        F.col("time").alias("create_date"),
        F.col("detail.metadata.domain").alias("domain_id"),
        F.col("detail.metadata.owningProjectId").alias("project_id"),
        F.col("`detail-type`").isin(ASSET_ADDED, METADATA_ACCEPTED).alias("known"),
    )
