"""Name and path rules as column expressions.

``(?U)`` makes ``\\s`` match Unicode spaces (a no-break space too), as the
original rules' regex dialect does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's naming rules.
DATABASE_SUFFIX = "_pub_db"
TARGET_PREFIX = "target-"
SOURCE_MARK = "source-"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def snake_name(c) -> Column:
    """Whitespace runs → ``_``, lower case."""
    return F.lower(F.regexp_replace(_c(c), r"(?U)\s+", "_"))


def squash_name(c) -> Column:
    """Whitespace removed, lower case."""
    return F.lower(F.regexp_replace(_c(c), r"(?U)\s+", ""))


def database_name(c) -> Column:
    """Squashed name plus the database suffix."""
    return F.concat(squash_name(c), F.lit(DATABASE_SUFFIX))


def target_name(c) -> Column:
    """Prefix ``target-``, remove only the first ``source-``, lower case."""
    prefixed = F.concat(F.lit(TARGET_PREFIX), _c(c))
    return F.lower(F.regexp_replace(prefixed, r"(?s)^(.*?)" + SOURCE_MARK, "$1"))


def entity_path(parent_unit, unit, entity_type) -> Column:
    """``<parent unit>/<unit>/<entity type>``; the units squashed."""
    return F.concat_ws("/", squash_name(parent_unit), squash_name(unit), _c(entity_type))


def object_bucket(url) -> Column:
    """Part 2 (0-based) of ``scheme://bucket/key``."""
    return F.split_part(_c(url), F.lit("/"), F.lit(3))


def object_key(url) -> Column:
    """Parts 3… (0-based) joined by ``/``; empty if there are none."""
    parts = F.split(_c(url), "/")
    return F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), "/")


def composite_id_part(c, n: int, sep: str = "|") -> Column:
    """The n-th (1-based) part of ``a|b`` style ids."""
    return F.split_part(_c(c), F.lit(sep), F.lit(n))
