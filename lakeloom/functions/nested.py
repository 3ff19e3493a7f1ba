"""Nested document helpers: pick a form, parse JSON inside JSON, unnest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The form names the asset document carries.
COMMON_DETAILS_FORM = "AssetCommonDetailsForm"
COLUMN_METADATA_FORM = "ColumnBusinessMetadataForm"

FORMS_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("formName", T.StringType()),
    T.StructField("content", T.StringType()),
]))
COMMON_DETAILS_SCHEMA = T.StructType([T.StructField("summary", T.StringType())])
COLUMN_METADATA_SCHEMA = T.StructType([
    T.StructField("columnsBusinessMetadata", T.ArrayType(T.StructType([
        T.StructField("columnIdentifier", T.StringType()),
        T.StructField("description", T.StringType()),
    ]))),
])


def pick_form(forms, name: str) -> Column:
    """P10: content of the first form called ``name``; null when there is none.

    ``get`` (not ``[0]``) so that no match gives null under ANSI mode.
    """
    forms = F.col(forms) if isinstance(forms, str) else forms
    return F.get(F.filter(forms, lambda x: x["formName"] == F.lit(name)), 0)["content"]


def parse_nested_json(content, schema: T.DataType) -> Column:
    """Parse a JSON string that was itself a string field of a document."""
    content = F.col(content) if isinstance(content, str) else content
    return F.from_json(content, schema)


def asset_summary(forms) -> Column:
    return parse_nested_json(pick_form(forms, COMMON_DETAILS_FORM), COMMON_DETAILS_SCHEMA)["summary"]


def column_metadata(forms) -> Column:
    """P11+P12 input: the array of column records of an asset."""
    return parse_nested_json(pick_form(forms, COLUMN_METADATA_FORM),
                             COLUMN_METADATA_SCHEMA)["columnsBusinessMetadata"]
