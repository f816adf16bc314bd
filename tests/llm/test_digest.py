import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import digest

SHARES = [0.01, 0.25, 0.5, 0.75, 0.99]


def _check(values: np.ndarray, row, error: float) -> None:
    cells = np.sort(digest.cell_value(digest.quantise(values)))
    for q in SHARES:
        v = row[f"p{100 * q:g}"]
        low, high = np.searchsorted(cells, v, "left"), np.searchsorted(cells, v, "right")
        slack = error * len(cells) + 1
        assert low - slack <= q * len(cells) <= high + slack, (q, v, low, high)


@given(st.lists(st.floats(allow_nan=False), min_size=2, max_size=50))
def test_quantise_keeps_order(values):
    a = np.sort(np.array(values))
    cells = digest.quantise(a)
    assert (np.diff(cells) >= 0).all() and cells.min() >= 0 and cells.max() < 1 << 32
    back = digest.cell_value(cells)
    finite = np.isfinite(a) & (np.abs(a) > 1e-300)
    assert (np.abs(back[finite] - a[finite]) <= np.abs(a[finite]) * 2.0**-19).all()
    assert (digest.quantise(back) == cells).all()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.sampled_from([0.02, 0.1, 0.5]))
def test_compress_invariants(seed, groups, error):
    rng = np.random.default_rng(seed)
    n, k = 3000, int(np.ceil(digest.DEPTH / error))
    g = rng.integers(0, groups, n)
    v = digest.quantise(np.round(rng.lognormal(0, 2, n), 3)) + (1 << digest.DEPTH)
    limit = np.bincount(g, minlength=groups) // k
    cg, cv, cc = digest.compress(g, v, np.ones(n, dtype=np.int64), limit)
    assert np.bincount(cg, weights=cc, minlength=groups).astype(int).tolist() == np.bincount(g, minlength=groups).tolist()
    inner = cv < 1 << digest.DEPTH
    assert (cc[inner] <= limit[cg[inner]]).all()
    for i in range(groups):
        assert (cg == i).sum() <= 3 * k + 1


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_percentiles_from_days(spark, error):
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame({"coin": np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n)), "day": rng.integers(0, 5, n), "px": np.round(rng.lognormal(3, 2, n), 4), "fee": rng.normal(0, 1, n), "field": "x", "n": 1})
    pdf.loc[::97, "px"] = np.nan
    pdf.loc[::50, "fee"] = 0.25
    df = spark.createDataFrame(pdf).withColumn("px", F.when(F.col("n") == 1, F.col("px"))).repartition(7)
    days = digest.partial_digests(df, ["coin", "day"], ["px", "fee"], error)
    merged = digest.merge(days.drop("day"), ["coin"], error)
    rows = {(r["coin"], r["field"]): r for r in digest.percentiles(merged, ["coin"], SHARES).collect()}
    assert len(rows) == 8
    for (coin, field), row in rows.items():
        values = pdf.loc[(pdf.coin == coin) & pdf[field].notna(), field].to_numpy()
        assert row["n"] == len(values)
        _check(values, row, error)
    assert merged.groupBy("coin", "field").count().agg(F.max("count")).first()[0] <= 3 * np.ceil(32 / error) + 200


def test_small_null_nan_ties_and_empty(spark):
    kind = "coin string, px double"
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", None), ("a", float("nan")), (None, 7.0), ("b", None), ("c", float("inf")), ("d", -0.0), ("d", 0.0)], kind)
    digests = digest.merge(digest.partial_digests(df, ["coin"], ["px"]), ["coin"])
    got = {r["coin"]: (r["n"], r["p50"]) for r in digest.percentiles(digests, ["coin"], [0.5]).collect()}
    assert got == {"a": (3, 2.0), None: (1, 7.0), "c": (1, float("inf")), "d": (2, 0.0)}
    empty = digest.merge(digest.partial_digests(spark.createDataFrame([], kind), ["coin"], ["px"]), ["coin"])
    assert digest.percentiles(empty, ["coin"], [0.5]).count() == 0


def test_groups_are_never_cut(monkeypatch):
    """However small the buffer, each group comes in one piece and in order."""
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 3000))
    rows = pa.RecordBatch.from_arrays([pa.array([None if k == 7 else f"k{k}" for k in keys]), pa.array(np.arange(3000))], names=["k", "v"])
    monkeypatch.setattr(digest, "_BUFFER", 100)
    pieces = list(digest._whole_groups((rows.slice(i, 64) for i in range(0, 3000, 64)), ["k"]))
    assert pa.Table.from_batches(pieces).column("v").to_pylist() == list(range(3000)) and len(pieces) > 10
    seen = [set(p.column(0).to_pylist()) for p in pieces]
    assert sum(map(len, seen)) == len(set().union(*seen))
