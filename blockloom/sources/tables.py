"""Plain table access for directories that hold one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` of the directory ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def normal(column: Column | str) -> Column:
    """Identifiers (hashes, topics, users) are equal without regard to outer blanks and case."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))


def is_value(column: Column) -> Column:
    """True for a normalised identifier that holds something: not null, blank or a bare ``0x``."""
    return column.isNotNull() & ~column.isin("", "0x")
