"""Problem 3: distinct counts over huge identifier sets with multiresolution bitmaps.

Method: an identifier's hash picks a slice geometrically (slice i takes 2^-i of the hash space, the
last one the rest) and a bit in the slice's small bitmap. Bitmaps merge by OR. The estimate takes
the finest slice that is not saturated as its base and sums the linear counts of it and all thinner slices,
scaled by the share of the hash space they cover; so the relative error does not depend on the set's size.

A sketch is kept as rows (slice, word, bits), one per 64-bit word that has a bit: a group's sketch never
has more than ``slices * bits / 64`` rows, ``bit_or`` combines on the map side, and no task ever holds more than
single words. The partial results of files, days or clusters merge through the same ``bit_or``.

Defined results: null identifiers are not counted; blank ones are not either after normalisation. Null
group values form a group of their own (they come out as null beside ``grouping`` that names them), a
group with rows but without any identifier has estimate 0, an empty table gives no rows (not even for the
empty grouping). Copies and ties change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SLICES, FULL = 4096, 32, 0.9
#: Standard relative error of BITS = 4096 where the base slice is least favourable (measured in the tests).
STANDARD_ERROR = 0.02


def sketch(df: DataFrame, identifier: Column, keys: Sequence[str], bits: int = BITS, slices: int = SLICES) -> DataFrame:
    """Bitmap words per group: keys, slice_no (-1 for a group's marker row), word_no, word."""
    if bits & (bits - 1) or bits < 64:
        raise ValueError("bits must be a power of two, 64 at least")
    hashed = F.xxhash64(identifier)
    # Leading zeros of the upper half choose the slice, the lower half the bit; both come from one hash.
    upper = F.shiftrightunsigned(hashed, 32)
    slice_no = F.least(F.lit(slices - 1), 31 - F.floor(F.log2(upper + F.lit(0.5)))).cast("int")
    bit = F.pmod(hashed, F.lit(bits))
    known = identifier.isNotNull()
    return (
        df.select(
            *keys,
            F.when(known, slice_no).otherwise(-1).alias("slice_no"),
            F.when(known, F.shiftright(bit, 6)).otherwise(0).cast("int").alias("word_no"),
            F.when(known, F.expr("1L")).otherwise(F.expr("0L")).alias("_one"),
            F.when(known, bit.bitwiseAND(F.lit(63))).otherwise(0).cast("int").alias("_at"),
        )
        .groupBy(*keys, "slice_no", "word_no")
        .agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias("word"))
    )


def merge(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """OR of partial sketches: of several tables after a union, or of finer groups onto fewer keys."""
    return parts.groupBy(*keys, "slice_no", "word_no").agg(F.bit_or("word").alias("word"))


def merge_groupings(parts: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """The sketches of several combinations of the keys at once, from the finest one; column ``grouping``
    names the keys that a row's group has, joined by ``,``. Only bitmap words are expanded, never input rows."""
    labels = F.explode(F.array(*[F.lit(i) for i in range(len(sets))]))
    expanded = parts.select("*", labels.alias("_set"))
    columns = [F.when(F.col("_set").isin([i for i, s in enumerate(sets) if k in s]), F.col(k)).alias(k) for k in keys]
    names = F.element_at(F.array(*[F.lit(",".join(s)) for s in sets]), F.col("_set") + 1).alias("grouping")
    return merge(expanded.select(names, *columns, "slice_no", "word_no", "word"), ["grouping", *keys])


def estimate(sketches: DataFrame, keys: Sequence[str], bits: int = BITS, slices: int = SLICES, full: float = FULL) -> DataFrame:
    """keys, estimate (double): the number of distinct identifiers of each group."""
    per_slice = sketches.groupBy(*keys, "slice_no").agg(F.sum(F.bit_count("word")).cast("int").alias("_set_bits"))
    arrays = per_slice.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("slice_no", "_set_bits"))).alias("_by"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_by"), i), F.lit(0)))
    dense = arrays.select(*keys, counts.alias("_counts"))
    # The base: the first slice after the last saturated one; never the last slice's successor.
    saturated = F.array_max(F.transform(F.col("_counts"), lambda c, i: F.when(c > full * bits, i + 1).otherwise(0)))
    based = dense.withColumn("_base", F.least(saturated, F.lit(slices - 1)))
    linear = F.aggregate(
        F.transform(F.col("_counts"), lambda c, i: F.when(i >= F.col("_base"), -bits * F.log(1 - F.least(c, F.lit(bits - 1)) / F.lit(float(bits)))).otherwise(0.0)),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    return based.select(*keys, (linear * F.pow(F.lit(2.0), F.col("_base"))).alias("estimate"))


def distinct_counts(df: DataFrame, identifier: Column, keys: Sequence[str], sets: Sequence[Sequence[str]], bits: int = BITS) -> DataFrame:
    """grouping, keys, estimate for each of ``sets``: one scan, then work on bitmap words only."""
    fine = sketch(df, identifier, keys, bits)
    return estimate(merge_groupings(fine, keys, sets), ["grouping", *keys], bits)
