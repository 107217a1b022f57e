"""Registry of the engine's own queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import basics, checks, edges, lives, looks, more, naming, planning, registry, relations, spots, tracks, trips

flagship = basics.day_rollup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (basics, relations, looks, edges, more, naming, planning, registry, tracks, spots, trips, lives, checks):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
