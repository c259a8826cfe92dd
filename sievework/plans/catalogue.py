"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import extensions, fulltext, preparation, retrieval, revision, statistics, texts
from sievework.plans.span_sql import SPAN_SQL

GROUPS = (retrieval, fulltext, statistics, texts, preparation, revision, extensions)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for group in GROUPS for name, query in group.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for group in GROUPS for name, sql in group.ORACLE_SQL.items()} | SPAN_SQL
