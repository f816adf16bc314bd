"""Problem 9: filling containers of fixed capacity with whole items.

Method: best-fit decreasing with a segment tree over remaining capacities. Items of one size are alike, so
the packing is computed on the histogram of sizes: the tree's leaf r holds the ranges of open containers with r
tokens left, and the tightest container for a size is the first non-empty leaf from it on, found in
logarithmic time. All items of a size that go into one range are placed in one step. The result is the exact global
best-fit-decreasing packing, and what the driver holds is bounded by the capacity, not by the data.

Items then find their container by their rank among the items of their size. Ranks are numbered
within salts of bounded size and shifted by prefix sums, so a size shared by a third of all items is no hot group.

Defined results: an item above the capacity is cut into pieces of the capacity and a rest, and only then;
an item of size 0 (null or empty text) takes no space and is put into container 0; equal items and ties are
placed in the order of id and piece; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.session import materialize

CAPACITY = 2048
_MOST = 1 << 20
_PER_SALT = 200_000


class CapacityTree:
    """Segment tree over the remaining capacities 0..capacity: which of them have open containers."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << (capacity + 1).bit_length()
        self.filled = bytearray(2 * self.width)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, left: int, first: int, end: int) -> None:
        """Containers first..end-1 have ``left`` free; full ones need no place."""
        if first >= end or left <= 0:
            return
        self.ranges.setdefault(left, []).append((first, end))
        at = left + self.width
        while at and not self.filled[at]:
            self.filled[at] = 1
            at >>= 1

    def take(self, left: int) -> tuple[int, int]:
        found = self.ranges[left].pop()
        if not self.ranges[left]:
            del self.ranges[left]
            at = left + self.width
            self.filled[at] = 0
            while at > 1 and not self.filled[at ^ 1]:
                at >>= 1
                self.filled[at] = 0
        return found

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of an open container that is ``size`` or more."""
        at = size + self.width
        if self.filled[at]:
            return size
        while at > 1:
            if not at & 1 and self.filled[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at + (not self.filled[2 * at])
                return at - self.width
            at >>= 1
        return None


def best_fit_decreasing(histogram: Mapping[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (size, first rank, first container, items per container) and the number of containers."""
    tree, runs, used = CapacityTree(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        if not 0 < size <= capacity:
            raise ValueError("sizes must lie between 1 and the capacity")
        count, rank = histogram[size], 0
        while count:
            left = tree.tightest(size)
            if left is None:
                each = capacity // size
                first, end, left = used, used + -(-count // each), capacity
                used = end
            else:
                each = left // size
                first, end = tree.take(left)
            runs.append((size, rank, first, each))
            whole = min(end - first, count // each)
            tree.put(left - each * size, first, first + whole)
            count, rank, first = count - whole * each, rank + whole * each, first + whole
            if count and first < end:
                tree.put(left - count * size, first, first + 1)
                count, rank, first = 0, rank + count, first + 1
            tree.put(left, first, end)
    return np.array(runs, dtype=np.int64).reshape(-1, 4), used


def _placer(runs: np.ndarray):
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else np.zeros(0, dtype=np.int64)
    size, rank, first, each = runs[order].T if len(runs) else np.zeros((4, 0), dtype=np.int64)
    keys = size * (np.int64(1) << 41) + rank

    @F.arrow_udf("long")
    def place(sizes: pa.Array, ranks: pa.Array) -> pa.Array:
        s = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
        r = ranks.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(s), dtype=np.int64)
        some = s > 0
        at = np.searchsorted(keys, s[some] * (np.int64(1) << 41) + r[some], side="right") - 1
        out[some] = first[at] + (r[some] - rank[at]) // each[at]
        return pa.array(out)

    return place


def pack(df: DataFrame, id_column: str, size: Column, capacity: int = CAPACITY) -> DataFrame:
    """id_column, piece, first_token, tokens, container: every item, whole or cut where it exceeds the capacity."""
    if not 0 < capacity <= _MOST:
        raise ValueError(f"the capacity must lie between 1 and {_MOST}")
    total = F.coalesce(size.cast("long"), F.lit(0))
    sized = df.select(F.col(id_column), total.alias("_size"))
    last = F.greatest(F.lit(0), F.floor((F.col("_size") - 1) / capacity)).cast("long")
    pieces = sized.select(id_column, "_size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    items = pieces.select(
        id_column,
        "piece",
        (F.col("piece") * capacity).alias("first_token"),
        F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("tokens"),
    )
    items, _ = materialize(items)  # sizes are costly, and three plans need them
    histogram = {r["tokens"]: r["n"] for r in items.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = best_fit_decreasing(histogram, capacity)
    salts = max(1, -(-sum(histogram.values()) // _PER_SALT))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id_column, "piece"), F.lit(salts)).cast("int"))
    per_salt = salted.groupBy("tokens", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("tokens").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    shifts = per_salt.select("tokens", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("tokens", "_salt").orderBy(id_column, "piece")) - 1
    ranked = salted.withColumn("_within", within).join(shifts, ["tokens", "_salt"])
    container = _placer(runs)(F.col("tokens"), F.col("_before") + F.col("_within"))
    return ranked.select(id_column, "piece", "first_token", "tokens", container.alias("container"))
