import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from blockloom.catalog import Catalog, TableDef
from blockloom.errors import ColumnMissing, TableMissing, UnexpectedBaseBlock
from blockloom.functions import base58, bloom, exp
from blockloom.operators import relations as rel
from blockloom.operators.predicates import Bloom, Compare, ContainsAny, Eq, In, discriminator
from blockloom.plans.execute import Execution, Tables
from blockloom.plans.request import parse


def _one(df, shape):
    return [json.loads(r[0]) for r in df.select(shape.row(lambda c: (F.col(c), df.schema[c].dataType) if c in df.columns else None)).collect()]


def test_values_by_type(spark):
    kind = "s string, b binary, i bigint, d double, f float, t timestamp_ntz, z boolean, u decimal(20,0), l array<string>, o struct<a_b:int,c:array<struct<d_e:string>>>"
    rows = [
        ('q"\\\n\u0001ü🧵', bytearray(b"\x01\xff"), 2**62, 1e300, 0.5, dt.datetime(2023, 1, 1, 0, 0, 1, 999000), True, Decimal(2**64 - 1), ["x", None], (1, [("y",), None])),
        (None,) * 10,
        ("", bytearray(b""), 0, float("nan"), float("inf"), dt.datetime(1970, 1, 1), False, Decimal(0), [], (None, None)),
    ]
    df = spark.createDataFrame(rows, kind)
    got = _one(df, exp.Object(tuple((c, exp.Prop(c)) for c in df.columns)))
    assert got[0] == {"s": 'q"\\\n\u0001ü🧵', "b": "0x01ff", "i": 2**62, "d": 1e300, "f": 0.5, "t": 1672531201999, "z": True, "u": 2**64 - 1, "l": ["x", None], "o": {"aB": 1, "c": [{"dE": "y"}, None]}}
    assert got[1] == dict.fromkeys(df.columns)
    assert got[2] == {"s": "", "b": "0x", "i": 0, "d": None, "f": None, "t": 0, "z": False, "u": 0, "l": [], "o": {"aB": None, "c": None}}


def test_special_expressions(spark):
    df = spark.createDataFrame([(1600, Decimal(2**64 - 1), -1, '{"raw": 1.50}', dt.datetime(2023, 1, 1, 0, 0, 1, 999000), [(7, "a")]), (None,) * 6, (0, Decimal(0), 3, None, None, [])], "n int, u decimal(20,0), v smallint, j string, t timestamp_ntz, a array<struct<n:bigint,chain_id:string>>")
    members = exp.ListOf(exp.Members((("nonce", "n", exp.BigNum()), ("chainId", "chain_id", exp.Value()))))
    parts = [("h2", "n", exp.HexNum(2)), ("h8", "u", exp.HexNum(8)), ("big", "u", exp.BigNum()), ("v", "v", exp.Version()), ("j", "j", exp.Json()), ("s", "t", exp.Time("s")), ("ms", "t", exp.Time("ms")), ("a", "a", members)]
    got = _one(df, exp.Object(tuple((k, exp.Prop(c, e)) for k, c, e in parts)))
    assert got[0] == {"h2": "0x0640", "h8": "0xffffffffffffffff", "big": "18446744073709551615", "v": "legacy", "j": {"raw": 1.5}, "s": 1672531201, "ms": 1672531201999, "a": [{"nonce": "7", "chainId": "a"}]}
    assert got[1] == dict.fromkeys([p[0] for p in parts])
    assert got[2] == {"h2": "0x0000", "h8": "0x0000000000000000", "big": "0", "v": 3, "j": None, "s": None, "ms": None, "a": []}
    with pytest.raises(TypeError):
        exp.BigNum().text(F.col("x"), __import__("pyspark").sql.types.DecimalType(10, 2))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_dont_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2023-03-12 02:30:01.999999' as a, timestamp_ntz'1969-12-31 23:59:59.5' as b, timestamp'2023-01-01 00:00:00Z' as c")
        shape = exp.Object(tuple((f"{c}{u}", exp.Prop(c, exp.Time(u))) for c in "abc" for u in ("s", "ms", "us")))
        got = _one(df, shape)[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (got["as"], got["ams"], got["aus"]) == (1678588201, 1678588201999, 1678588201999999)
    assert (got["bs"], got["bms"], got["bus"]) == (-1, -500, -500000) and (got["cs"], got["cms"]) == (1672531200, 1672531200000)


def test_roll(spark):
    df = spark.createDataFrame([("a", "b", ["c", None]), ("a", None, ["c"]), (None, "b", ["c"]), ("a", "b", None), ("a", "b", [])], "x string, y string, r array<string>")
    assert _one(df, exp.Roll(("x", "y", "r"))) == [["a", "b", "c", None], ["a"], [], ["a", "b"], ["a", "b"]]
    assert _one(df, exp.Roll(("x", "y"))) == [["a", "b"], ["a"], [], ["a", "b"], ["a", "b"]]


def test_bloom_and_base58(spark):
    members, outsider = ["So11111111111111111111111111111111111111112", "Vote111111111111111111111111111111111111111", "11111111111111111111111111111111"], "Stake11111111111111111111111111111111111111"
    df = spark.createDataFrame([(1, members), (2, [outsider]), (3, None), (4, [])], "i int, a array<string>").withColumn("f", bloom.bloom_column(F.col("a")))
    found = lambda *v: sorted(r["i"] for r in df.where(Bloom("f", v).on(df)).collect())
    assert found(members[0]) == [1] and found(outsider) == [2] and found(members[1], outsider) == [1, 2]
    assert len(bloom.bloom_of(members)) == 64
    for raw in (b"", b"\0\0a", b"hello world", bytes(range(40))):
        assert base58.decode(base58.encode(raw)) == raw
    assert base58.encode(b"hello world") == "StV1DL6CwTryKyV" and base58.decode("0OIl") is None
    data = spark.createDataFrame([(base58.encode(bytes([255] * 9)),), (base58.encode(b"\1\2\3"),), (None,)], "t string").select(base58.decode_column(F.col("t")).alias("raw"))
    d = data.select(*[c.alias(n) for n, c in base58.prefix_columns(F.col("raw")).items()])
    rows = d.collect()
    assert rows[0]["d8"] == Decimal(2**64 - 1) and rows[0]["d9"] == bytearray([255] * 9) and rows[0]["d10"] is None
    assert (rows[1]["d1"], rows[1]["d2"], rows[1]["d3"], rows[1]["d4"]) == (1, 258, bytearray(b"\1\2\3"), None) and rows[2]["d1"] is None
    assert d.where(discriminator(["0x010203", "0x" + "ff" * 8]).on(d)).count() == 2  # a null prefix doesn't hide the other


def test_literals_out_of_range_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None), (-5, "b", [])], "n int, s string, l array<int>")
    count = lambda p: df.where(p.on(df)).count()
    assert count(Eq("n", 1)) == 1 and count(In("n", (1, 2**40))) == 1 and count(Eq("n", 2**40)) == 0
    assert count(Compare("n", low=-(2**60))) == 2 and count(Compare("n", low=2**60)) == 0 and count(Compare("n", high=2**60)) == 2 and count(Compare("n", -5, 0)) == 1
    assert count(ContainsAny("l", (2, 2**40))) == 1 and count(ContainsAny("l", (2**40,))) == 0


def _trees(seed):
    rng = random.Random(seed)
    address = lambda: [rng.randint(0, 2) for _ in range(rng.randint(0, 4))]
    row = lambda: (rng.randint(0, 1), rng.choice([0, 1, None]), rng.choice([None] + [address() for _ in range(12)]))
    return [row() for _ in range(60)], [row() for _ in range(8)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_tree_relations_against_definitions(spark, seed):
    target, source = _trees(seed)
    kind = "b int, t int, a array<int>"
    out, inp = spark.createDataFrame([(i, *r) for i, r in enumerate(target)], f"i int, {kind}"), spark.createDataFrame(source, kind)
    key = ["b", "t", "a"]
    whole = lambda r: None not in r
    group = lambda x, y: x[:2] == y[:2]
    prefix = lambda x, y: y[2][: len(x[2])] == x[2]
    src = [s for s in source if whole(s)]
    got = lambda keys: sorted(r["i"] for r in rel.select_rows(out, None, [(key, keys)]).collect())
    rows = [(i, r) for i, r in enumerate(target) if whole(r)]
    assert got(rel.join(inp, key, key)) == [i for i, r in rows if r in src]
    assert got(rel.children(inp, out, key)) == [i for i, r in rows if any(group(s, r) and prefix(s, r) and len(s[2]) < len(r[2]) for s in src)]
    assert got(rel.parents(inp, key, key)) == [i for i, r in rows if any(group(s, r) and prefix(r, s) for s in src)]
    anchors = [s for s in src if s in [r for _, r in rows]]
    assert got(rel.foreign_children(inp, key, out, key)) == [i for i, r in rows if any(group(s, r) and prefix(s, r) for s in anchors)]
    assert got(rel.foreign_parents(inp, key, out, key)) == [i for i, r in rows if any(group(s, r) and prefix(r, s) for s in anchors)]


def test_rows_keep_their_multiplicity(spark):
    out = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, v string")
    keys = spark.createDataFrame([(1,), (1,), (3,), (None,)], "k int")
    assert sorted(r["v"] for r in rel.select_rows(out, F.col("v") == "z", [(["k"], keys)]).collect()) == ["x", "x", "z"]
    assert out.count() == 4 and rel.select_rows(out, None, []).count() == 0


def _fills(spark):
    blocks = [(n, f"h{n}", f"h{n - 1}", dt.datetime(2023, 1, 1)) for n in range(10, 20)]
    fills = [(n, i, f"u{i}", "YO" if i else "EZ", float(i)) for n in (11, 12, 15) for i in range(3)]
    return Tables({"blocks": spark.createDataFrame(blocks, "number long, hash string, parent_hash string, timestamp timestamp_ntz"), "fills": spark.createDataFrame(fills, "block_number long, fill_index int, user string, coin string, px double")})


FIELDS = {"block": {"number": True, "hash": True}, "fill": {"fillIndex": True, "coin": True, "px": True}}


def _run(spark, body, **kw):
    return Execution(parse({"type": "hyperliquidFills", "fields": FIELDS, **body}).compile(), _fills(spark), **kw)


def test_blocks_of_a_range(spark):
    got = [json.loads(x) for x in _run(spark, {"fromBlock": 11, "toBlock": 18, "fills": [{"coin": ["EZ"]}, {"user": ["u2"]}]}).json_lines()]
    item = lambda i: {"fillIndex": i, "coin": "YO" if i else "EZ", "px": float(i)}
    header = lambda n: {"number": n, "hash": f"h{n}"}
    assert got == [{"header": header(n), "fills": [item(0), item(2)]} for n in (11, 12, 15)] + [{"header": header(18)}]
    assert json.loads(_run(spark, {"fromBlock": 13, "toBlock": 14, "fills": [{}]}).json_array()) == [{"header": header(13)}, {"header": header(14)}]
    assert _run(spark, {"fromBlock": 100}).json_lines() == []
    every = [json.loads(x)["header"]["number"] for x in _run(spark, {"fromBlock": 12, "includeAllBlocks": True, "fills": []}).json_lines()]
    assert every == list(range(12, 20))


def test_budget(spark):
    body = {"fromBlock": 10, "fills": [{}]}
    # Of a header 2 columns, of a fill key, coin and px: 32 each; three fills a block.
    weights = {r["number"]: r["weight"] for r in _run(spark, body).block_weights().collect()}
    assert weights == {10: 64, 11: 64 + 3 * 128, 12: 64 + 3 * 128, 15: 64 + 3 * 128, 19: 64}
    last = lambda b: _run(spark, body, budget=b).kept().first()["last_block"]
    assert (last(0), last(511), last(512), last(959), last(960), last(10**6)) == (10, 10, 11, 11, 12, 19)
    lines = _run(spark, body, budget=512).json_lines()
    assert [json.loads(x)["header"]["number"] for x in lines] == [10, 11]
    all_blocks = _run(spark, {**body, "includeAllBlocks": True}, budget=64 * 3 + 768).headers()
    assert sorted(r["number"] for r in all_blocks.collect()) == [10, 11, 12]


def test_parent_hash(spark):
    assert _run(spark, {"fromBlock": 12, "parentBlockHash": "h11", "toBlock": 12}).json_lines()
    with pytest.raises(UnexpectedBaseBlock) as e:
        _run(spark, {"fromBlock": 12, "parentBlockHash": "other"}).json_lines()
    assert e.value.previous[-1] == (11, "h11")
    tables = Tables({"blocks": _fills(spark).get("blocks").where("number < 13 or number > 15"), "fills": _fills(spark).get("fills")})
    ask = lambda h: Execution(parse({"type": "hyperliquidFills", "fromBlock": 15, "parentBlockHash": h}).compile(), tables).check_parent()
    ask("h12")  # 13 to 15 aren't there
    with pytest.raises(UnexpectedBaseBlock):
        ask("h14")
    with pytest.raises(UnexpectedBaseBlock):
        Execution(parse({"type": "hyperliquidFills", "fromBlock": 3, "parentBlockHash": "h2"}).compile(), tables).check_parent()


def test_missing_tables_columns_and_defaults(spark):
    with pytest.raises(ColumnMissing, match="column 'dir' is not found in 'fills'"):
        _run(spark, {"fills": [{"dir": ["x"]}]}).json_lines()
    with pytest.raises(ColumnMissing, match="column 'sz' is not found in 'fills'"):
        Execution(parse({"type": "hyperliquidFills", "fields": {"fill": {"sz": True}}, "fills": [{}]}).compile(), _fills(spark)).json_lines()
    with pytest.raises(TableMissing):
        Execution(parse({"type": "evm", "logs": [{}]}).compile(), _fills(spark)).json_lines()
    catalog = Catalog([TableDef("blocks", ("number",)), TableDef("x", ("block_number", "i"), defaults={"late": "string"})])
    from blockloom.plans.plan import PlanBuilder

    b = PlanBuilder(catalog)
    b.request("x", None)
    b.show("x", exp.Object((("late", exp.Prop("late")),)))
    b.show("blocks", exp.Object((("number", exp.Prop("number")),)))
    tables = Tables({"blocks": spark.range(3).withColumnRenamed("id", "number"), "x": spark.createDataFrame([(1, 0)], "block_number int, i int")})
    assert [json.loads(x) for x in Execution(b.build(), tables).json_lines()] == [{"header": {"number": 0}}, {"header": {"number": 1}, "x": [{"late": None}]}, {"header": {"number": 2}}]


def test_null_sizes_and_order_of_items(spark):
    logs = [(1, 2, 0, "a", None), (1, 10, 0, "b", 5), (1, 1, 0, "c", 7)]
    tables = Tables({"blocks": spark.createDataFrame([(1,)], "number long"), "logs": spark.createDataFrame(logs, "block_number long, log_index int, transaction_index int, data string, data_size long")})
    e = Execution(parse({"type": "evm", "fields": {"log": {"data": True}, "block": {"number": True}}, "logs": [{}]}).compile(), tables)
    assert e.block_weights().first()["weight"] == 32 + 3 * 64 + 12
    assert json.loads(e.json_lines()[0])["logs"] == [{"data": "c"}, {"data": "a"}, {"data": "b"}]


def test_filters_and_columns_reach_the_scan(spark, root):
    from blockloom import blockqueries as q

    plan = q.scan_filter(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(topic0)" in plan and "GreaterThanOrEqual(block_number" in plan and "PushedFilters: []" not in plan
    scan = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "topic3" not in scan.split("ReadSchema")[1]


def test_absorbed_plan_has_no_join(spark, root):
    from blockloom import blockqueries as q

    plan = q.full_scan_absorption(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
