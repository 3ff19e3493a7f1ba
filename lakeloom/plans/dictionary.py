"""Catalog event → data dictionary (batch form of T3).

match (P7) → extract by type (P9) → enrich (J2) → pick form, parse, unnest
(P10–P12) → export (K5) + notifications (K6). The per-event remote lookups of
the original become broadcast joins on dimension tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.nested import COMMON_DETAILS_FORM, asset_summary, column_metadata, pick_form
from lakeloom.operators.events import ASSET_ADDED, CATALOG_SOURCE, METADATA_ACCEPTED, extract_by_type, match_events
from lakeloom.operators.lookups import enrich_asset
from lakeloom.sinks.exports import EXPORT_KEYS


def asset_events(events: DataFrame, projects: DataFrame, units: DataFrame, domains: DataFrame,
                 assets: DataFrame, home_domain: str | None) -> DataFrame:
    """Matched catalog events, enriched, with their column records parsed.

    Every matched event is kept; ``reject_reason`` is null for good rows and
    names the failure otherwise (unknown type, missing lookup, missing form).
    """
    # No domain id: the catalog rule is skipped, so nothing matches.
    m = match_events(events, [CATALOG_SOURCE], None,
                     [home_domain] if home_domain is not None else [])
    x = extract_by_type(m)
    e = enrich_asset(x, projects, units, domains, assets)
    cols = column_metadata("forms")
    summary = asset_summary("forms")
    # Both forms are required (the original fails the event on either).
    reason = (F.when(~F.col("known"), F.concat(F.lit("unknown type: "), F.col("`detail-type`")))
              .when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ",")))
              .when(cols.isNull() | pick_form("forms", COMMON_DETAILS_FORM).isNull(),
                    F.lit("missing form")))
    return e.select(
        F.col("id").alias("event_id"), F.col("`detail-type`").alias("detail_type"),
        "user_id", "asset_id", "domain_id", "project_id",
        # try_: a malformed time gives null (ANSI to_timestamp would fail the job).
        F.try_to_timestamp(F.col("create_date")).alias("event_time"),
        *EXPORT_KEYS, "asset_revision",
        summary.alias("asset_summary"),
        cols.alias("columns"),
        reason.alias("reject_reason"))


def dictionary_rows(assets: DataFrame) -> DataFrame:
    """P10–P12 + P5/P6 on asset documents: (asset_name, column_name, description)."""
    return (assets.select(F.col("name").alias("asset_name"),
                          F.explode(column_metadata("forms")).alias("c"))
            .select("asset_name", F.col("c.columnIdentifier").alias("column_name"),
                    F.col("c.description").alias("description")))


__all__ = ["asset_events", "dictionary_rows", "ASSET_ADDED", "METADATA_ACCEPTED"]
