import json

import pytest

from blockloom.catalog import Catalog, TableDef, camel, snake
from blockloom.dialects import DIALECTS
from blockloom.errors import QueryError
from blockloom.operators.predicates import All, Any_, Bloom, ContainsAny, Eq, In, discriminator, parse_hex
from blockloom.plans.plan import Plan, PlanBuilder, Relation, Scan, simplify
from blockloom.plans.request import parse

TX = ("block_number", "transaction_index")
CHAIN = Catalog([TableDef("blocks", ("number",)), TableDef("transactions", TX, children={"logs": TX}), TableDef("logs", ("block_number", "log_index"))])
DOWN = Relation("join", "transactions", TX, "logs", TX)
UP = Relation("join", "logs", TX, "transactions", TX)


def _plan(*scans):
    return Plan(CHAIN, scans, {})


def test_a_whole_table_absorbs_its_scans_and_what_leads_to_it():
    p = simplify(_plan(Scan("transactions", None, (DOWN,)), Scan("logs", Eq("topic0", "a"), (UP,))))
    assert set(p.scans) == {Scan("transactions"), Scan("logs")}


def test_an_incomplete_link_of_a_whole_table_stays():
    p = simplify(_plan(Scan("logs", None, (UP,)), Scan("logs", Eq("topic0", "a"), (UP,))))
    assert p.scans == (Scan("logs", None, (UP,)),)  # logs may lack for some transactions


def test_predicates_stay_without_a_whole_table():
    scans = (Scan("transactions", Eq("to", "x"), (DOWN,)), Scan("logs", Eq("topic0", "a"), (UP,)))
    assert simplify(_plan(*scans)).scans == scans


def test_trees_of_a_whole_table_are_whole():
    catalog = Catalog([TableDef("blocks", ("number",)), TableDef("calls", ("block_number", "address"))])
    up = Relation("parents", "calls", ("block_number", "address"), "calls", ("block_number", "address"))
    assert simplify(Plan(catalog, (Scan("calls", None, (up,)), Scan("calls", Eq("name", "x"), (up,))), {})).scans == (Scan("calls"),)


def test_links_are_followed_from_every_whole_table():
    catalog = Catalog([TableDef("blocks", ("number",)), TableDef("a", ("b", "i"), children={"c": ("b", "i")}), TableDef("c", ("b", "i"), children={"d": ("b", "i")}), TableDef("d", ("b", "i"))])
    ac, cd = Relation("join", "a", ("b", "i"), "c", ("b", "i")), Relation("join", "c", ("b", "i"), "d", ("b", "i"))
    p = simplify(Plan(catalog, (Scan("a", None, (ac,)), Scan("c", None, (cd,)), Scan("d", Eq("x", 1))), {}))
    assert set(p.scans) == {Scan("a"), Scan("c"), Scan("d")}


def test_a_relation_must_start_where_its_scan_does():
    with pytest.raises(AssertionError):
        simplify(_plan(Scan("logs", Eq("topic0", "a"), (DOWN,))))


def test_equal_relations_are_one_and_never_requests_leave_nothing():
    b = PlanBuilder(CHAIN)
    b.request("logs", Eq("topic0", "a"), [UP, UP])
    b.request("logs", Eq("topic0", "b"), [UP])
    b.request("logs", All((Eq("topic0", "b"), In("address", ()))), [UP])
    plan = b.build()
    assert len(plan.scans) == 2 and [len(s) for _, s in plan.relations_into("transactions")] == [2]


def test_catalogs_are_checked():
    for tables in ([], [TableDef("blocks", ("a", "b"))], [TableDef("blocks", ("n",)), TableDef("x", ("n",))], [TableDef("blocks", ("n",), children={"y": ("n",)})]):
        with pytest.raises(ValueError):
            Catalog(tables)
    assert TableDef("t", ("b", "i"), weights={"data": "data_size", "bloom": 512, "a1": 0}).weight(["data", "bloom", "a1", "x"]) == (2 * 32 + 512 + 32, ["data_size"])
    assert camel("internal_transactions") == "internalTransactions" and snake("stateDiffs") == "state_diffs"


def test_never():
    assert In("a", ()).is_never() and Bloom("a", ()).is_never() and ContainsAny("a", ()).is_never()
    assert not All(()).is_never() and not Any_(()).is_never() and Any_((In("a", ()),)).is_never() and not Any_((In("a", ()), Eq("a", 1))).is_never()
    assert discriminator(["zz", "0x1"]).is_never() and discriminator(["0x"]) is None and discriminator(["0x01", "0x"]) is None
    assert discriminator(["0x01", "0x0a0b0c", "0x02"]) == Any_((In("d1", (1, 2)), In("d3", (b"\n\x0b\x0c",))))
    assert parse_hex("0x 12") is None and parse_hex("0xzz") is None and parse_hex("0x0102", 2) == b"\1\2" and parse_hex("0x0102", 3) is None


@pytest.mark.parametrize(
    "body",
    [
        {},
        {"type": "nochain"},
        {"type": "evm", "extra": 1},
        {"type": "evm", "fromBlock": 5, "toBlock": 4},
        {"type": "evm", "fromBlock": -1},
        {"type": "evm", "fromBlock": True},
        {"type": "evm", "fields": {"block": {"numbr": True}}},
        {"type": "evm", "fields": {"blocks": {}}},
        {"type": "evm", "fields": {"block": {"number": 1}}},
        {"type": "evm", "logs": [{"topic": ["0x"]}]},
        {"type": "evm", "logs": [{"topic0": "0x"}]},
        {"type": "evm", "logs": [{"transaction": 1}]},
        {"type": "evm", "logs": {}},
        {"type": "evm", "logs": [{}] * 60, "transactions": [{}] * 41},
        {"type": "solana", "instructions": [{"mentionsAccount": ["a"] * 11}]},
        {"type": "solana", "instructions": [{"d1": ["0x01"], "discriminator": ["0x01"]}]},
        {"type": "solana", "instructions": [{"discriminator": ["0x012"]}]},
        {"type": "solana", "instructions": [{"discriminator": ["0x" + "00" * 17]}]},
        {"type": "hyperliquidReplicaCmds", "actions": [{}] * 50, "orderActions": [{}] * 51},
        {"type": "hyperliquidReplicaCmds", "actions": [{"status": "maybe"}]},
        {"type": "evm", "includeAllBlocks": "yes"},
        {"type": "evm", "parentBlockHash": 4},
    ],
)
def test_bad_queries_are_refused(body):
    with pytest.raises(QueryError):
        parse(body)


def test_repeated_properties_and_broken_documents():
    for text in ('{"type":"evm","logs":[],"logs":[]}', "{", "[]", '"evm"'):
        with pytest.raises(QueryError):
            parse(text)


@pytest.mark.parametrize("name", sorted(DIALECTS))
def test_every_field_filter_and_relation_compiles(name):
    d = DIALECTS[name]
    samples = {"strings": ["0x01"], "integers": [1], "integer": 1, "boolean": True, "string": "ok"}
    body = {"type": name, "fields": {k: {f.name: True for f in item.fields} for k, item in d.items.items()}}
    for k, r in d.requests.items():
        usable = {f: samples[x.kind] for f, x in r.filters.items() if f not in r.exclusive[1:]}
        body[k] = [usable, {link: True for link in r.links}, {**usable, **{link: True for link in r.links}}]
    plan = parse(json.dumps(body)).compile()
    plan.check()
    for t, output in plan.outputs.items():
        assert output.columns or t not in {i.table for i in d.items.values()}
    # Field order is the declared one, whatever the request's.
    first = next(iter(d.items))
    names = [f.name for f in d.items[first].fields]
    shape = parse({"type": name, "fields": {first: dict.fromkeys(reversed(names), True)}}).compile().outputs[d.items[first].table].shape
    assert [k for k, _ in shape.parts] == names


def test_trace_fields_by_type():
    plan = parse({"type": "evm", "fields": {"trace": {"callTo": True, "callCallType": True, "createFrom": True, "type": True, "rewardValue": True}}}).compile()
    variants = dict(plan.outputs["traces"].shape.variants)
    names = lambda o: [(k, [n for n, _ in v.parts] if hasattr(v, "parts") else None) for k, v in o.parts]
    assert names(variants["call"]) == [("type", None), ("action", ["to", "callType"])]
    assert names(variants["create"]) == [("type", None), ("action", ["from"])]
    assert names(variants["suicide"]) == [("type", None)]
