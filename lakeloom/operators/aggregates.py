"""Aggregations: emptiness (A1), latest per key (A3), grant state (A4).

A3 and A4 use ``max_by`` over a struct ordering key rather than a window with
``row_number``: ``max_by`` aggregates partially on the map side, so a key that
holds a third of all rows is folded to one row per task before the shuffle.
Spark runs it as a sort aggregate: each task sorts its own rows by key, so only
the columns that are needed should be passed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.hierarchy import child_flag

# Grant request types.
CREATE, UPDATE, DELETE = "Create", "Update", "Delete"


def is_empty(df: DataFrame) -> bool:
    """A1: true when there is no row; stops at the first row found."""
    return df.isEmpty()


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A3: the row with the greatest ``order`` tuple per ``keys`` (last wins).

    Include a unique column at the end of ``order`` to break ties.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]),
                    F.struct(*[F.col(f"`{c}`") for c in order]))
    return df.groupBy(*keys).agg(last.alias("_last")).select(*keys, "_last.*")


# The policy types a grant request may carry.
POLICY_TYPES = [
    "CREATE_PROJECT", "ADD_TO_PROJECT_MEMBER_POOL", "CREATE_GLOSSARY", "CREATE_FORM_TYPE",
    "CREATE_ASSET_TYPE", "CREATE_ENVIRONMENT_PROFILE", "CREATE_ENVIRONMENT",
    "CREATE_ENVIRONMENT_FROM_BLUEPRINT", "CREATE_PROJECT_FROM_PROJECT_PROFILE",
]
ENV_PROFILE, ENVIRONMENT = "CREATE_ENVIRONMENT_PROFILE", "CREATE_ENVIRONMENT"

GRANT_KEYS = ["DomainIdentifier", "EntityIdentifier", "EntityType", "PolicyType",
              "principal_kind", "principal"]


def principal_of(requests: DataFrame) -> DataFrame:
    """Who a request grants to: ``principal_kind`` (user, group, all_users,
    project) and ``principal`` (the ARN, ``*`` or the project id), from the
    principal type and the policy type. Unknown combinations give null.
    """
    ptype, policy = F.col("PrincipalType"), F.col("PolicyType")
    project = F.col("project_id") if "project_id" in requests.columns else F.lit(None).cast("string")
    kind = (F.when(ptype.isin("IAM_USER", "IAM_ROLE") & (policy != ENV_PROFILE), F.lit("user"))
            .when(ptype == "IAM_GROUP", F.lit("group"))
            .when(ptype == "root", F.lit("all_users"))
            .when(policy.isin(ENV_PROFILE, ENVIRONMENT), F.lit("project")))
    who = (F.when(kind.isin("user", "group"), F.col("PrincipalArn"))
           .when(kind == "all_users", F.lit("*"))
           .when(kind == "project", project))
    return requests.withColumn("principal_kind", kind).withColumn("principal", who)


def valid_request(requests: DataFrame) -> F.Column:
    """A request takes effect only with a known type, policy and principal."""
    known = (F.col("RequestType").isin(CREATE, UPDATE, DELETE) & F.col("PolicyType").isin(POLICY_TYPES)
             & F.col("principal_kind").isNotNull())
    return F.coalesce(known, F.lit(False))  # a null type or policy is no known one


def grant_state(requests: DataFrame, keys: list[str] | None = None,
                order: list[str] | None = None) -> DataFrame:
    """A4: fold Create/Update/Delete requests into the current grants.

    Requests with an unknown policy type or principal fail and change
    nothing. Of the rest, the latest request per grant key decides; a Delete
    removes the grant. The include-children flag is parsed from text
    (``"false"`` is false); the environment policies have none, so it is false
    for them whatever the request says.
    """
    keys = keys or GRANT_KEYS
    order = order or ["ts", "request_id"]
    ok = principal_of(requests)
    last = latest_per_key(ok.where(valid_request(ok)), keys, order)
    return (last.where(F.col("RequestType") != DELETE)
            .withColumn("include_child", child_flag("IncludeChildDomainUnits")
                        & ~F.col("PolicyType").isin(ENV_PROFILE, ENVIRONMENT)))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The requests ``grant_state`` ignores (unknown policy or principal)."""
    ok = principal_of(requests)
    return ok.where(~valid_request(ok))
