"""Dimension lookups: enrichment (J2), member resolution (J3), lookup-or-self.

Broadcast only behind a size check: ``fits_broadcast`` counts at most
``max_rows + 1`` rows of the side. A larger side is joined by ``skew_join``,
which finds the hot keys with a frequent-items sketch and spreads these, and
only these, over many tasks. A lookup gives one match at most: a key that is
listed twice counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 64 << 20
MAX_SALTS = 512


def fits_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                   max_bytes: int = DEFAULT_BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and about ``max_bytes``
    bytes (measured as JSON text of the rows).

    One small job over at most ``max_rows + 1`` rows; nothing reaches the
    driver but two numbers. A streaming side has no bound and is never
    broadcast.
    """
    if df.isStreaming:
        return False
    probe = df.limit(max_rows + 1).select(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))),
                   F.lit(0)).alias("bytes"))
    r = probe.first()
    return r["n"] <= max_rows and r["bytes"] <= max_bytes


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if it passes ``fits_broadcast``, else ``df`` as is."""
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def broadcast_known(df: DataFrame, n_rows: int, n_bytes: int, max_rows: int = DEFAULT_BROADCAST_ROWS,
                    max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size is already known (e.g. built from a
    bounded list on the driver) and within the bounds; no job is run."""
    return F.broadcast(df) if n_rows <= max_rows and n_bytes <= max_bytes else df


def salts_of(spark) -> int:
    """As many salts as shuffle partitions, so a hot key fills the cluster."""
    return max(2, min(MAX_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def one_per_key(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the same one in every run; null keys match nothing."""
    rest = [c for c in lookup.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    known = lookup.dropna(subset=keys)
    if not rest:
        return known.distinct()
    return known.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_row")).select(*keys, "_row.*")


def hot_keys(df: DataFrame, keys: list[str], share: float, tracked: int = 4096) -> list[int]:
    """Hashes of the key tuples that hold at least ``share`` of the rows of
    ``df``, and possibly a few that hold less.

    Spark's frequent-items sketch keeps ``tracked`` counters per task and merges
    them; a key above 1 / ``tracked`` of the rows is never missed. At most
    1 / ``share`` hashes reach the driver. Null keys match nothing and are left
    out.
    """
    h = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    known = df.dropna(subset=keys).select(h.alias("h"))
    r = known.agg(F.expr(f"approx_top_k(h, {max(1, min(1000, int(1 / share)))}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [x["item"] for x in r["top"] or [] if x["count"] >= share * r["n"]]


def skew_join(big: DataFrame, small: DataFrame, cond_keys: list[tuple[str, str]], how: str = "inner",
              salt_by: list[str] | None = None, salts: int | None = None,
              max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Equi-join ``big`` with ``small`` on ``[(big_col, small_col), ...]`` where
    a key of ``big`` may hold a large share of its rows.

    A ``small`` side that passes the size check is broadcast (no shuffle of
    ``big``). Otherwise the keys with more rows than half a shuffle partition's
    share are found (``hot_keys``, one pass over the keys of ``big``). A row of
    ``big`` with such a key, or with a null key, gets a salt from a hash of
    ``salt_by`` (deterministic, so a lost task recomputes the same rows); the
    rows of ``small`` with such a key are there once per salt, all others once.
    A streaming ``big`` cannot be counted first, so all its keys are salted.
    ``how`` is ``inner`` or ``left``.
    """
    cond = [F.col(a) == F.col(b) for a, b in cond_keys]
    if fits_broadcast(small, max_rows, max_bytes):
        return big.join(F.broadcast(small), _and(cond), how)
    cols = salt_by or big.columns
    salts = salts or salts_of(big.sparkSession)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(salts))
    copies = F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    if not big.isStreaming:
        # Of one type on both sides, so that equal keys have equal hashes.
        kinds = [big.schema[a].dataType for a, _ in cond_keys]
        left = F.xxhash64(*[F.col(a) for a, _ in cond_keys])
        right = F.xxhash64(*[F.col(b).cast(t) for (_, b), t in zip(cond_keys, kinds)])
        hot = hot_keys(big, [a for a, _ in cond_keys], 1 / (2 * salts))
        lost = F.col(cond_keys[0][0]).isNull()
        for a, _ in cond_keys[1:]:
            lost = lost | F.col(a).isNull()
        salt = F.when(lost | left.isin(hot), salt).otherwise(F.lit(0))
        copies = F.when(right.isin(hot), copies).otherwise(F.array(F.lit(0).cast("long")))
    b = big.withColumn("_salt", salt)
    s = small.withColumn("_salt2", F.explode(copies))
    return b.join(s, _and(cond + [F.col("_salt") == F.col("_salt2")]), how).drop("_salt", "_salt2")


def _and(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def lookup_or_self(df: DataFrame, col: str, mapping: DataFrame, key: str = "logical",
                   value: str = "real", max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Replace ``col`` by its mapped value where one exists, else keep it."""
    m = one_per_key(mapping.select(F.col(key).alias("_lk"), F.col(value).alias("_lv")), ["_lk"])
    salt = [c for c, t in df.dtypes if "map<" not in t]  # maps cannot be hashed
    out = skew_join(df, m, [(col, "_lk")], "left", salt_by=salt, max_rows=max_rows)
    return out.withColumn(col, F.coalesce("_lv", F.col(col))).drop("_lk", "_lv")


def enrich_asset(events: DataFrame, projects: DataFrame, units: DataFrame, domains: DataFrame,
                 assets: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Project → (name, unit id); unit → name; domain → name; asset → document.

    Keys include the domain id. One left join per lookup keeps every event;
    ``missing`` lists the lookups that failed (empty array = fully enriched).
    Input columns used: domain_id, project_id, asset_id.
    Lookup columns: projects(domain_id, id, name, domainUnitId),
    units(domain_id, id, name), domains(id, name),
    assets(domain_id, id, name, revision, forms).
    """
    p = projects.select(F.col("domain_id").alias("_pd"), F.col("id").alias("_pid"),
                        F.col("name").alias("project_name"), F.col("domainUnitId").alias("domain_unit_id"))
    u = units.select(F.col("domain_id").alias("_ud"), F.col("id").alias("_uid"),
                     F.col("name").alias("domain_unit_name"))
    d = domains.select(F.col("id").alias("_did"), F.col("name").alias("domain_name"))
    a = assets.select(F.col("domain_id").alias("_ad"), F.col("id").alias("_aid"),
                      F.col("name").alias("asset_name"), F.col("revision").alias("asset_revision"),
                      F.col("forms").alias("forms"))
    out, salt = events, [c for c, t in events.dtypes if "map<" not in t]
    for lookup, keys in ((p, [("domain_id", "_pd"), ("project_id", "_pid")]),
                         (u, [("domain_id", "_ud"), ("domain_unit_id", "_uid")]),
                         (d, [("domain_id", "_did")]),
                         (a, [("domain_id", "_ad"), ("asset_id", "_aid")])):
        out = skew_join(out, one_per_key(lookup, [k for _, k in keys]), keys, "left", salt_by=salt, max_rows=max_rows)
    missing = F.filter(F.array(
        F.when(F.col("_pid").isNull(), F.lit("project")),
        F.when(F.col("_uid").isNull(), F.lit("domain_unit")),
        F.when(F.col("_did").isNull(), F.lit("domain")),
        F.when(F.col("_aid").isNull(), F.lit("asset"))), lambda x: x.isNotNull())
    return out.withColumn("missing", missing).drop("_pd", "_pid", "_ud", "_uid", "_did", "_ad", "_aid")


def resolve_members(members: DataFrame, users: DataFrame,
                    max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """The member's user id and whether the row is kept.

    With a lookup key, only the looked-up id counts (null when the key is
    unknown, even if a literal id is also given); without one, the literal id.
    A row is dropped only when both user and group id are null. Adds
    ``resolved_user``, ``unknown_key`` and ``keep``.
    Columns used: members(predefinedUserKey, userIdentifier, groupIdentifier),
    users(user_key, user_id).
    """
    u = one_per_key(users.select(F.col("user_key").alias("_uk"), F.col("user_id").alias("_uv")), ["_uk"])
    j = skew_join(members, u, [("predefinedUserKey", "_uk")], "left", max_rows=max_rows)
    resolved = F.when(F.col("predefinedUserKey").isNotNull(), F.col("_uv")).otherwise(F.col("userIdentifier"))
    return (j.withColumn("resolved_user", resolved)
            .withColumn("unknown_key", F.col("predefinedUserKey").isNotNull() & F.col("_uv").isNull())
            .withColumn("keep", F.col("resolved_user").isNotNull() | F.col("groupIdentifier").isNotNull())
            .drop("_uk", "_uv"))
