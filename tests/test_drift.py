import json
import random

import pytest
from pyspark.sql import functions as F

from blockloom.operators import drift

KEYS = [drift.TRANSACTION_KEY, drift.FILL_KEY]


def _rows(spark, files):
    rows = [(f, n, i, json.dumps(x) if not isinstance(x, str) else x, "r", "v") for (f, n), lines in files.items() for i, x in enumerate(lines)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "feed string, file_no int, line_no int, payload string, rec string, value string").repartition(3)


def _parsed(df):
    return drift.parse(df, "feed", "file_no", "line_no", "payload", KEYS)


def _tx(i, **kw):
    return {"block_number": 5, "transaction_index": i, **kw}


def test_each_change(spark):
    files = {
        ("a", 1): [_tx(0, fee=1, units=10, flag=True, gone=1), _tx(1, fee=2, units=11, flag=False, gone=2), _tx(2, fee=3, units=12, flag=True, gone=None)],
        ("a", 3): [_tx(1, fee="2", meta={"units": 11}, flag=0, extra=[1]), _tx(2, fee="3", meta={"units": 12}, flag=1, extra=None), '{"block_number": 5, "tran', "[1]", "", "nonsense"],
        ("a", 4): [_tx(1, fee="2", meta={"units": 11}, flag=0, extra=7), _tx(2, fee="3", meta={"units": 12}, flag=1, extra=None), _tx(9, late=None)],
        ("b", 1): [_tx(0, only=1)],
        ("c", 1): [],
    }
    got = {tuple(r) for r in drift.changes(_parsed(_rows(spark, files))).collect()}
    assert got == {
        ("a", 3, "renamed", "units", "meta.units"), ("a", 3, "removed", "gone", ""), ("a", 3, "added", "", "extra"), ("a", 3, "retyped", "fee", "fee"), ("a", 3, "retyped", "flag", "flag"),
        ("a", 4, "retyped", "extra", "extra"), ("a", 4, "added", "", "late"),
    }


def test_values_decide_before_names(spark):
    # "cost" looks like "cost_units", but the values went to "total"; a field absent in one record only is still the same.
    files = {
        ("a", 1): [_tx(1, cost=4, b=None), _tx(2, cost=5, b="x"), _tx(3, b="y")],
        ("a", 2): [_tx(1, total=4, cost_units=9), _tx(2, total=5, cost_units=8, c="x"), _tx(3, cost_units=1, c="y", total=None)],
    }
    got = {tuple(r)[2:] for r in drift.changes(_parsed(_rows(spark, files))).collect()}
    assert got == {("renamed", "cost", "total"), ("renamed", "b", "c"), ("added", "", "cost_units")}


def test_flooding_prefers_likely_names_on_equal_values():
    old = {"twap_id": "integer", "cost": "integer", "k": "string"}
    new = {"cost_units": "integer", "order.twap_id": "integer", "k": "string"}
    pairs = {(a, b): 2 for a in ("twap_id", "cost") for b in ("cost_units", "order.twap_id")}
    filled = {(a, None): 2 for a in ("twap_id", "cost")} | {(None, b): 2 for b in ("cost_units", "order.twap_id")}
    assert set(drift.correspondences(old, new, pairs, filled)) == {("twap_id", "order.twap_id", 2), ("cost", "cost_units", 2)}
    scores = drift.flood(old, new, {})
    assert max((p for p in scores if p[0] == "k"), key=scores.get) == ("k", "k")


def test_flooding_alone_where_no_record_is_shared():
    old = {"fee": "integer", "compute_units": "integer", "note": "string", "k": "string"}
    new = {"meta.fee": "integer", "computeUnits": "integer", "flag": "boolean", "k": "string"}
    assert set(drift.correspondences(old, new, {}, {})) == {("fee", "meta.fee", 0), ("compute_units", "computeUnits", 0)}
    # A shared record that has a value under one of them only contradicts.
    assert set(drift.correspondences(old, new, {}, {("fee", None): 1})) == {("compute_units", "computeUnits", 0)}
    # Different types don't correspond without values, and neither do names that have nothing in common.
    assert drift.correspondences({"size": "integer"}, {"sizes": "list"}, {}, {}) == [] == drift.correspondences({"abc": "integer"}, {"xyz": "integer"}, {}, {})


def test_unshared_files_are_no_rename_but_unite(spark):
    files = {("a", 1): [_tx(1, compute_units_consumed=5)], ("a", 2): [_tx(2, compute_units=6)]}
    lines = _parsed(_rows(spark, files))
    assert {tuple(r)[2:] for r in drift.changes(lines).collect()} == {("removed", "compute_units_consumed", ""), ("added", "", "compute_units")}
    table = drift.unify(lines, drift.matches(lines), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS)
    assert {r["transaction_index"]: r["compute_units_consumed"] for r in table.collect()} == {1: 5, 2: 6}


def test_one_name_for_two_things_in_two_feeds(spark):
    """In feed a, fee became total; in feed b, total is another field beside fee."""
    files = {("a", 1): [_tx(0, fee=1), _tx(1, fee=2)], ("a", 2): [_tx(1, total=2), _tx(2, total=3)], ("b", 1): [_tx(10, fee=7, total=100), _tx(11, fee=8, total=101)]}
    lines = _parsed(_rows(spark, files))
    got = {r["transaction_index"]: (r["fee"], r["total"]) for r in drift.unify(lines, drift.matches(lines), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS).collect()}
    assert got == {0: (1, None), 1: (2, None), 2: (3, None), 10: (7, "100"), 11: (8, "101")}


def test_a_target_field_that_a_feed_only_has_under_other_names(spark):
    """Flooding against the target; where a file has the field itself beside it, a like name stays what it is."""
    files = {("c", 1): [_tx(20, cost_units=7)], ("c", 2): [_tx(21)], ("c", 3): [_tx(22, costUnits=8)], ("a", 1): [_tx(0, meta={"cost_units": 5}, fee=1, feeUsd=2)], ("a", 2): [_tx(1, costUnits=6, fee=1)], ("b", 1): [_tx(9, cost_units=1, usage={"cost_units": 2})]}
    lines = _parsed(_rows(spark, files))
    table = drift.unify(lines, drift.matches(lines), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS)
    got = {r["transaction_index"]: (r["cost_units"], r["fee"], r["feeUsd"], r["usage_cost_units"]) for r in table.collect()}
    assert got == {0: (5, 1, "2", None), 1: (6, 1, None, None), 9: (1, None, None, "2"), 20: (7, None, None, None), 21: (None, None, None, None), 22: (8, None, None, None)}


def test_many_names_of_equal_values_are_not_compared_pairwise(spark):
    wide = lambda p: {f"{p}{i}": i for i in range(60)}
    files = {("a", 1): [_tx(1, **wide("old")), _tx(2, **wide("old"))], ("a", 2): [_tx(1, **wide("fresh")), _tx(2, **wide("fresh"))]}
    got = {tuple(r)[2:] for r in drift.changes(_parsed(_rows(spark, files))).collect()}
    assert got == {("renamed", f"old{i}", f"fresh{i}") for i in range(60)}


def test_hot_file_and_repeats(spark):
    base = [_tx(i, v=i, w=str(i)) for i in range(400)]
    files = {("a", 1): base, ("a", 2): [_tx(i, vv=i, w=str(i)) for i in range(400)] + [_tx(3, vv=999)], ("b", 1): base[:3]}
    got = {tuple(r) for r in drift.changes(_parsed(_rows(spark, files))).collect()}
    assert got == {("a", 2, "renamed", "v", "vv")}


def test_unify(spark):
    files = {
        ("a", 1): [_tx(0, fee=1, compute_units_consumed=10), _tx(1, fee=2, compute_units_consumed=11, has_dropped_log_messages=True)],
        ("a", 2): [_tx(1, fee="0x3", meta={"cu": 11}, has_dropped_log_messages="false", signatures=["s"]), _tx(2, fee=[7], meta={"cu": 12.0}, note="hi", signatures="t")],
        ("b", 1): [_tx(8, meta={"cu": 99}, fee="x")],
    }
    values = _parsed(_rows(spark, files))
    table = drift.unify(values, drift.changes(values), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS)
    got = {r["transaction_index"]: r for r in table.collect()}
    assert sorted(got) == [0, 1, 2, 8]
    assert [got[i]["compute_units_consumed"] for i in (0, 1, 2, 8)] == [10, 11, 12, 99]
    assert [got[i]["fee"] for i in (0, 1, 2, 8)] == [1, 3, 7, None]
    assert got[1]["has_dropped_log_messages"] is False and got[0]["has_dropped_log_messages"] is None
    assert got[1]["signatures"] == ["s"] and got[2]["signatures"] == ["t"] and got[2]["note"] == "hi"
    lost = {(r["rec"], r["field"], r["value"]) for r in drift.uncastable(values, drift.changes(values), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS).collect()}
    assert lost == {("[5, 8]", "fee", '"x"')}
    with pytest.raises(ValueError):
        drift.unify(values, drift.changes(values), drift.TRANSACTION_KEY, drift.TRANSACTION_FIELDS, most=2)


def test_a_file_without_a_complete_line(spark):
    df = _rows(spark, {("a", 1): [_tx(0, v=1)], ("a", 2): ['{"block_n', '{"x": NaN}'], ("a", 3): [_tx(0, v=1)]})
    names = ["block_number", "transaction_index", "v"]
    got = {tuple(r) for r in drift.changes(_parsed(df), df.select("feed", "file_no")).collect()}
    assert got == {("a", 2, "removed", n, "") for n in names} | {("a", 3, "added", "", n) for n in names}
    assert drift.changes(_parsed(df)).count() == 0


def test_empty(spark):
    df = _rows(spark, {("a", 1): [_tx(0, v=1)]}).limit(0)
    assert drift.changes(_parsed(df)).count() == 0
    assert drift.unify(_parsed(df), drift.changes(_parsed(df)), drift.FILL_KEY, drift.FILL_FIELDS).count() == 0


def test_against_definition(spark, root):
    """The definition of a change, spelled out over the whole small table."""
    table = spark.read.parquet(f"{root}/raw_files.parquet")
    files: dict = {}
    for r in table.orderBy("line_no").collect():
        files.setdefault((r["feed"], r["file_no"]), {})
        try:
            flat = dict(drift.leaves(json.loads(r["payload"])))
        except ValueError:
            continue
        files[r["feed"], r["file_no"]].setdefault((flat.get("block_number"), flat.get("transaction_index", flat.get("fill_index"))), flat)
    want = set()
    for (feed, n), now in files.items():
        then = files.get((feed, n - 1))
        if then is None:
            continue
        a, b = {k for r in then.values() for k in r}, {k for r in now.values() for k in r}
        kinds = lambda rs, k: {drift.json_type(r[k]) for r in rs.values() if r.get(k) is not None}
        want |= {(feed, n, "retyped", k, k) for k in a & b if kinds(then, k) and kinds(now, k) and kinds(then, k) != kinds(now, k)}
        gone, came = a - b, b - a
        both = set(then) & set(now)
        renamed = {(x, y) for x in gone for y in came if all(json.dumps(then[r].get(x)) == json.dumps(now[r].get(y)) for r in both) and any(then[r].get(x) is not None for r in both)}
        want |= {(feed, n, "renamed", x, y) for x, y in renamed}
        want |= {(feed, n, "removed", x, "") for x in gone - {x for x, _ in renamed}} | {(feed, n, "added", "", y) for y in came - {y for _, y in renamed}}
    got = [tuple(r) for r in drift.changes(drift.parse(table, "feed", "file_no", "line_no", "payload", KEYS)).select(F.col("feed"), "file_no", "change", "old_name", "new_name").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
