import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import features, hierarchy

T0 = dt.datetime(2023, 1, 1)


def _events(spark):
    rows = [
        (1, 0, "U1", "Open Long", T0, 1.5), (1, 0, "U1", "Open Long", T0, 1.5),  # a copy
        (1, 1, " u1", "open_long ", T0 + dt.timedelta(1), float("nan")), (1, 2, "u1", "Close  Long", T0, None), (2, 0, "u2", None, T0, -2.0),
        (2, 1, None, "open long", T0, 9.0), (2, 2, " ", "open long", T0, 9.0), (3, 0, "u2", "", None, 3.0), (None, None, "u2", "Open-Long", None, 0.25),
    ]
    return spark.createDataFrame(rows, "b long, i int, user string, dir string, time timestamp_ntz, pnl double")


def _table(df, **kw):
    return features.feature_table(df, F.lower(F.trim("user")), features.type_name("dir"), F.col("time"), F.col("pnl"), **kw)


def test_feature_table(spark):
    got = {r["entity"]: r.asDict() for r in _table(_events(spark), key=["b", "i"]).collect()}
    assert set(got) == {"u1", "u2"}
    a, b = got["u1"], got["u2"]
    assert (a["open long_n"], a["open long_total"], a["open long_last"]) == (2, 1.5, T0 + dt.timedelta(1))
    assert (a["close long_n"], a["close long_total"], a["close long_last"]) == (1, None, T0)
    assert (a["none_n"], a["none_total"], a["none_last"]) == (0, None, None)
    assert (b["none_n"], b["none_total"], b["none_last"]) == (2, 1.0, T0)
    assert (b["open long_n"], b["open long_total"], b["open long_last"]) == (1, 0.25, None)
    assert {r["entity"]: r["open long_n"] for r in _table(_events(spark)).collect()} == {"u1": 3, "u2": 1}


def test_partial_entries_merge(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.choice(["hot", "hot", f"u{i % 9}"]), f"t{rng.randint(0, 30)}", T0 + dt.timedelta(minutes=rng.randint(0, 999)), rng.choice([float(rng.randint(-9, 9)), None, math.nan])) for i in range(3000)]
    df = spark.createDataFrame(rows, "b long, i int, user string, dir string, time timestamp_ntz, pnl double")
    kinds = features.type_list(df, features.type_name("dir"))
    entry = lambda d: features.entries(features.events(d, F.col("user"), features.type_name("dir"), F.col("time"), F.col("pnl")), kinds)
    parts = entry(df.where("b % 3 = 0")).unionByName(entry(df.where("b % 3 = 1"))).unionByName(entry(df.where("b % 3 = 2")))
    key = lambda x: (x[0], x[1])
    assert sorted(map(tuple, features.merge(parts).collect()), key=key) == sorted(map(tuple, entry(df).collect()), key=key)
    with pytest.raises(ValueError):
        features.type_list(df, features.type_name("dir"), 5)
    assert _table(df.limit(0), types=["a"]).columns == ["entity", "a_n", "a_total", "a_last"] and _table(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 3, 40])
def test_types_outside_the_list_are_left_out(spark, width):
    """Any number of unknown types, whatever the length of the list; the list's order and repeats don't matter."""
    rows = [(i, 0, f"u{i % 7}", f"t{i % 60}", T0 + dt.timedelta(minutes=i), float(i)) for i in range(1000)] + [(2000, 0, "other", "t59", T0, 1.0)]
    df = spark.createDataFrame(rows, "b long, i int, user string, dir string, time timestamp_ntz, pnl double").repartition(5)
    types = [f"t{j}" for j in reversed(range(width))] + ["never", "t0"]
    got = {r["entity"]: r.asDict() for r in _table(df, key=["b", "i"], types=types).collect()}
    assert set(got) == {r[2] for r in rows if r[3] in types} and "other" not in got
    for u, row in got.items():
        for t in types:
            own = [r for r in rows if r[2] == u and r[3] == t]
            assert (row[f"{t}_n"], row[f"{t}_total"], row[f"{t}_last"]) == (len(own), sum(r[5] for r in own) if own else None, max((r[4] for r in own), default=None))


def test_number_of_types_is_bounded_by_an_error(spark):
    df = spark.createDataFrame([(i, 0, "u", f"t{i}", T0, 1.0) for i in range(12)], "b long, i int, user string, dir string, time timestamp_ntz, pnl double")
    with pytest.raises(ValueError):
        _table(df, most=11)
    assert len(_table(df, most=12).columns) == 37


def _brute(links):
    out = {}
    for x in links:
        path, seen, at = [], {}, x
        while at in links and at not in seen:
            seen[at] = len(path)
            path.append(at)
            at = links[at]
        if at in seen:
            ring = path[seen[at] :]
            out[x] = (None, None, None, min(ring), next(i for i, p in enumerate(path) if p in ring))
        else:
            out[x] = (path[-1], len(path) - 1, path[::-1], None, None)
    return out


def _chain(links, x):
    seen = set()
    while x in links and x not in seen:
        seen.add(x)
        x = links[x]
    return seen


def _forest(seed, n):
    rng = random.Random(seed)
    links = {}
    for i in range(n):
        near = [f"0xn{j}" for j in range(max(0, i - 3), i)]
        links[f"0xn{i}"] = rng.choice([*near, *near, None, "0xgone", f"0xn{rng.randint(0, n - 1)}"]) if i % 17 == 0 else (near[-1] if near and rng.random() < 0.8 else rng.choice([*near, None]))
    links["0xself"] = "0xself"
    links["0xtail"] = "0xself"
    links["0xr1"], links["0xr2"], links["0xr3"] = "0xr2", "0xr3", "0xr1"
    links["0xhot"] = None
    links.update({f"0xc{i}": "0xhot" for i in range(n // 2)})  # a third of all nodes below one
    return links


@pytest.mark.parametrize(("seed", "n", "bucket"), [(1, 150, 10_000), (2, 150, 40), (3, 300, 100), (4, 60, 7)])
def test_hierarchy_against_brute_force(spark, seed, n, bucket):
    links = _forest(seed, n)
    rng = random.Random(seed)
    rows = [(k, p, i if rng.random() < 0.95 else None, "x") for i, (k, p) in enumerate(links.items())]
    rows += [(f" {k.upper()} ", p and p.upper() + " ", i, "y") for k, p, i, _ in rows[:20]] + [(None, "0xn1", 5, ""), (" ", None, 5, ""), ("0x", None, 5, "")]
    df = spark.createDataFrame(rows, "hash string, parent_hash string, number long, id string").repartition(3)
    tree = hierarchy.hierarchy(df, "hash", "parent_hash", "number", bucket=bucket)
    got = {r["id"]: r for r in tree.collect()}
    want = _brute(links)
    assert set(got) == set(want) == set(links)
    for k, r in got.items():
        assert (r["root"], r["depth"], r["path"], r["cycle"], r["hops"]) == want[k], k
    below = {k: sum(k in (w[2] or [])[:-1] for w in want.values()) for k in links}
    assert all(r["descendants"] == below[k] for k, r in got.items() if r["cycle"] is None)
    behind = {k: sum(k in _chain(links, x) for x in links) - 1 for k, w in want.items() if w[4]}
    assert all(got[k]["descendants"] == n for k, n in behind.items()) and (behind or seed == 4)
    pairs = {(r["ancestor"], r["descendant"]): r["distance"] for r in hierarchy.descendants(tree).collect()}
    assert pairs == {(a, k): w[1] - i for k, w in want.items() if w[2] for i, a in enumerate(w[2][:-1])}
    scalar = hierarchy.hierarchy(df, "hash", "parent_hash", "number", with_paths=False, bucket=bucket)
    assert {r["id"]: (r["root"], r["depth"], r["cycle"], r["hops"]) for r in scalar.collect()} == {k: (w[0], w[1], w[3], w[4]) for k, w in want.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "hash string, parent_hash string, number long")
    assert hierarchy.hierarchy(df, "hash", "parent_hash", "number").count() == 0


def test_a_long_chain_in_any_order_takes_few_steps(spark, monkeypatch):
    """2,000 nodes in a row and a cycle of 300 with a tail, spread over 23 buckets at random: as many tables as a logarithm asks for."""
    n = 2000
    links = {f"n{i:05}": f"n{i - 1:05}" if i else None for i in range(n)}
    links |= {f"c{i:03}": f"c{(i + 1) % 300:03}" for i in range(300)} | {"t0": "c007", "t1": "t0"}
    order = list(range(len(links)))
    random.Random(5).shuffle(order)
    written = []
    real = hierarchy.materialize
    monkeypatch.setattr(hierarchy, "materialize", lambda df: written.append(1) or real(df))
    df = spark.createDataFrame([(k, p, o) for (k, p), o in zip(links.items(), order)], "hash string, parent_hash string, number long")
    got = {r["id"]: (r["root"], r["depth"], r["descendants"], r["cycle"], r["hops"]) for r in hierarchy.hierarchy(df, "hash", "parent_hash", "number", with_paths=False, bucket=100).collect()}
    assert len(written) < 60
    for i in range(n):
        assert got[f"n{i:05}"] == ("n00000", i, n - 1 - i, None, None)
    assert all(got[f"c{i:03}"][3:] == ("c000", 0) for i in range(300))
    assert got["t0"] == (None, None, 1, "c000", 1) and got["t1"] == (None, None, 0, "c000", 2)
