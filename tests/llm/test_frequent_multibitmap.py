import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.llm import frequent, multibitmap

KIND = T.StructType([T.StructField("v", T.StringType()), T.StructField("n", T.StringType()), T.StructField("value", T.StringType())])


def test_frequent_values_against_counter(spark):
    rng = random.Random(1)
    raw = [rng.choice(["0xA", " 0xa", "0xb", "0xc ", "0xd", None, "", " ", "0x", " 0X "] + [f"0x{i}" for i in range(300)]) for _ in range(4000)]
    raw += ["0xhot"] * 2000  # a third of all rows
    df = spark.createDataFrame([(v, "x", "y") for v in raw], KIND)  # columns named as the operator's own
    counts = Counter(v.strip(" ").lower() for v in raw if v is not None and v.strip(" ").lower() not in ("", "0x"))
    total = sum(counts.values())
    found = {r["value"]: r["n"] for r in frequent.frequent_values(df, "v", 0.005).collect()}
    assert found == {k: n for k, n in counts.items() if n >= 0.005 * total}
    top = [(r["value"], r["n"]) for r in frequent.top_k(df, "v", 7).collect()]
    assert sorted(top, key=lambda x: (-x[1], x[0])) == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:7]


def test_frequent_values_empty_and_exact_share(spark):
    empty = spark.createDataFrame([], KIND)
    assert frequent.frequent_values(empty, "v", 0.005).count() == 0
    nothing = spark.createDataFrame([(None, None, None), (" ", "", "")], KIND)
    assert frequent.frequent_values(nothing, "v", 0.005).count() == 0
    tie = spark.createDataFrame([(f"k{i % 4}", "", "") for i in range(8)], KIND)
    assert frequent.frequent_values(tie, "v", 0.25).count() == 4  # exactly the share counts
    with pytest.raises(ValueError):
        frequent.frequent_values(tie, "v", 0)


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 9000, 60_000, 400_000])
def test_estimate_within_known_error(spark, n):
    df = spark.range(max(n, 1)).select(F.lit("g").alias("g"), F.when(F.lit(n > 0), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("u"))
    df = df.unionByName(df)  # copies change nothing
    got = multibitmap.distinct_counts(df, F.col("u"), ["g"], [["g"], []]).collect()
    assert len(got) == 2
    for r in got:
        assert abs(r["estimate"] - n) <= 5 * multibitmap.STANDARD_ERROR * n


def test_standard_error_over_seeds(spark):
    # Relative errors of 60 disjoint sets of 20,000: their root mean square is the standard error.
    df = spark.range(60 * 20_000).select((F.col("id") % 60).alias("g"), F.col("id").cast("string").alias("u"))
    got = multibitmap.distinct_counts(df, F.col("u"), ["g"], [["g"]]).toPandas()
    assert ((got.estimate / 20_000 - 1) ** 2).mean() ** 0.5 < multibitmap.STANDARD_ERROR


def test_partials_merge_to_the_same_sketch(spark):
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7000).cast("string").alias("u"), F.lit(1).alias("word"))
    whole = multibitmap.sketch(df, F.col("u"), ["g"])
    parts = [multibitmap.sketch(df.where(F.pmod("u", F.lit(4)) == i), F.col("u"), ["g"]) for i in range(4)]
    merged = multibitmap.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[0]), ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.select(*whole.columns).collect()))
    assert whole.count() <= 3 * multibitmap.SLICES * multibitmap.BITS // 64


def test_groupings_nulls_and_empty(spark):
    kind = "day date, coin string, user string"
    rows = [(None, "a", "u1"), (None, "a", "u2"), (pd.Timestamp("2023-01-01").date(), None, "u1"), (pd.Timestamp("2023-01-01").date(), "b", None)]
    df = spark.createDataFrame(rows, kind)
    got = {(r["grouping"], r["day"], r["coin"]): round(r["estimate"]) for r in multibitmap.distinct_counts(df, F.col("user"), ["day", "coin"], [["day"], ["coin"], []]).collect()}
    day = rows[2][0]
    assert got == {("day", None, None): 2, ("day", day, None): 1, ("coin", None, "a"): 2, ("coin", None, None): 1, ("coin", None, "b"): 0, ("", None, None): 2}
    assert multibitmap.distinct_counts(spark.createDataFrame([], kind), F.col("user"), ["day"], [["day"], []]).count() == 0
