"""All queries of the retrieval engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioq.plans import evidence, flow, ingest, pages, places, reading, records, retrieval, store, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (text, retrieval, flow, store, pages, places, records, evidence, ingest, reading):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
