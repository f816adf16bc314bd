"""Problem 1: the most frequent values of a column with very many rows and distinct values.

Method: exact spillable aggregation. ``groupBy`` combines on the map side, so a value that holds a
third of all rows reaches the shuffle as one row per map task; the hash partitions of the final
aggregation spill to disk; each partition keeps its own top k and one final ordered limit merges them.
Memory per task is bounded by the sort buffer and k, however many distinct values there are.

Defined results: null, blank and bare ``0x`` are no values and count nowhere; rows count as stored,
copies included; ties in count are ordered by value; an empty column gives no rows; further columns of
the table, whatever their names, are not read.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.sources.tables import is_value, normal


def value_counts(df: DataFrame, column: Column | str) -> DataFrame:
    """(value, n) of the normalised column; values only."""
    return df.select(normal(column).alias("value")).where(is_value(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, column: Column | str, k: int) -> DataFrame:
    """The k most frequent values: (value, n), ties by value. Counts are exact."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(k)


def frequent_values(df: DataFrame, column: Column | str, support: float) -> DataFrame:
    """(value, n, total) of every value with n >= support * total, where total counts rows with a value.

    At most 1/support values can qualify, which bounds the k of the ordered limit without loss. The
    total is summed over the same counts, so Spark reuses their shuffle.
    """
    if not 0 < support <= 1:
        raise ValueError("support must lie in (0, 1]")
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n").alias("total"))
    # floor(1/support) in floats may fall one short; one more row costs nothing, the filter decides.
    top = counts.orderBy(F.desc("n"), "value").limit(floor(1 / support) + 1)
    share = Fraction(str(support))  # compared in whole numbers: a share that is met exactly counts
    return top.join(F.broadcast(total)).where(F.col("n") * share.denominator >= F.col("total") * share.numerator)
