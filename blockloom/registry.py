"""The registered queries outside the corpus subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom import blockqueries, dialectqueries, pipelines, storequeries

FLAGSHIP = "multi_request_budget"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**blockqueries.QUERIES, **dialectqueries.QUERIES, **storequeries.QUERIES, **pipelines.QUERIES}
SQL: dict[str, str] = {**blockqueries.SQL, **dialectqueries.SQL, **storequeries.SQL, **pipelines.SQL}
