"""Canonical keys: compared without letter case and surrounding white space, blank counts as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(col: Column | str) -> Column:
    """Upper case, outer white space removed; blank becomes null."""
    c = F.col(col) if isinstance(col, str) else col
    trimmed = F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(trimmed) > 0, trimmed)


def hash_key(col: Column | str) -> Column:
    """The 64 hex digits of a hash in lower case, whatever label precedes them; null without them."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.lower(F.regexp_extract(c, r"([0-9A-Fa-f]{64})\s*$", 1))
    return F.when(F.length(found) == 64, found)


def sql_key(expr: str) -> str:
    """DuckDB twin of :func:`key`."""
    return rf"nullif(upper(regexp_replace({expr}, '^\s+|\s+$', '', 'g')), '')"


def sql_hash_key(expr: str) -> str:
    """DuckDB twin of :func:`hash_key`."""
    return rf"nullif(lower(regexp_extract({expr}, '([0-9A-Fa-f]{{64}})\s*$', 1)), '')"
