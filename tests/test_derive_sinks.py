import gzip
import json

from blockloom.dialects import DIALECTS
from blockloom.functions import base58, bloom, derive
from blockloom.plans.execute import Execution, Tables
from blockloom.plans.request import parse
from blockloom.sources import sinks
from blockloom.sources.physical import SORT_KEYS, sort_keys
from blockloom.sources.store import Store
from blockloom.streaming.retention import Follower


def test_instructions_are_found_by_what_is_derived(spark):
    accounts = [f"acc{i}" for i in range(18)]
    rows = [(1, 0, [0], "prog", accounts, base58.encode(bytes(range(1, 12)))), (1, 0, [0, 1], "prog", accounts[:2], base58.encode(b"\xff")), (1, 1, [0], "other", None, None), (1, 2, [0], "other", accounts[:16], "")]
    df = spark.createDataFrame(rows, "block_number long, transaction_index int, instruction_address array<int>, program_id string, accounts array<string>, data string")
    got = {(r["transaction_index"], len(r["instruction_address"])): r for r in derive.solana_instructions(df).collect()}
    a, b, c, d = got[0, 1], got[0, 2], got[1, 1], got[2, 1]
    assert a["a0"] == "acc0" and a["a15"] == "acc15" and a["rest_accounts"] == ["acc16", "acc17"] and a["accounts_size"] == 18 * 44
    assert a["d1"] == 1 and a["d2"] == 258 and bytes(a["d3"]) == b"\1\2\3" and bytes(a["d11"]) == bytes(range(1, 12)) and a["d12"] is None and a["data_size"] == len(rows[0][5])
    assert b["a1"] == "acc1" and b["a2"] is None and b["rest_accounts"] is None and b["d1"] == 255 and b["d2"] is None
    assert c["a0"] is None and c["d1"] is None and c["accounts_size"] == 0 and d["rest_accounts"] == [] and bytes(a["accounts_bloom"]) == bloom.bloom_of(accounts)
    tables = Tables({"blocks": spark.createDataFrame([(1,)], "number long"), "instructions": derive.solana_instructions(df)})
    query = lambda **f: parse({"type": "solana", "fields": {"instruction": {"accounts": True, "d1": True, "instructionAddress": True}}, "instructions": [f]})
    found = lambda **f: [x["instructionAddress"] for x in json.loads(Execution(query(**f).compile(), tables).json_lines()[0]).get("instructions", [])]
    assert found(discriminator=["0x0102030405"]) == [[0]] and found(d1=["0xff"]) == [[0, 1]] and found(d1=["0xff"], parentInstructions=True) == [[0], [0, 1]]
    assert found(a0=["acc0"], d8=["0x0102030405060708"]) == [[0]] and found(d8=["0x0102030405060708"], innerInstructions=True) == [[0], [0, 1]]
    assert found(mentionsAccount=["acc17"]) == [[0]] and found(mentionsAccount=[]) == []
    text = json.loads(Execution(query(d1=["0x01"]).compile(), tables).json_lines()[0])["instructions"]
    assert text == [{"instructionAddress": [0], "accounts": accounts, "d1": "0x01"}]


def test_actions(spark):
    rows = [
        ('{"type":"order","orders":[{"a":3,"c":"x"},{"a":3},{"a":5,"c":"x"}]}', None), ('{"type":"cancel","cancels":[{"a":7},{"a":7}]}', "ok"),
        ('{"type":"cancelByCloid","cancels":[{"asset":1,"cloid":"c1"}]}', None), ('{"type":"batchModify","modifies":[{"order":{"a":2,"c":"m"}}]}', None), ('{"type":"vote"}', None), (None, None), ("broken", None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, action string, response string")
    got = {r["i"]: r for r in derive.replica_actions(df).collect()}
    assert (got[0]["action_type"], got[0]["order_asset"], got[0]["order_cloid"], got[0]["cancel_asset"]) == ("order", [3, 5], ["x"], None)
    assert got[1]["cancel_asset"] == [7] and got[1]["order_asset"] is None and got[1]["response_size"] == 2
    assert (got[2]["cancel_by_cloid_asset"], got[2]["cancel_by_cloid_cloid"]) == ([1], ["c1"])
    assert (got[3]["batch_modify_asset"], got[3]["batch_modify_cloid"]) == ([2], ["m"])
    assert all(got[i]["order_asset"] is None and got[i]["batch_modify_cloid"] is None for i in (4, 5, 6)) and got[5]["action_size"] == 0


def test_transactions(spark, root):
    df = spark.read.parquet(f"{root}/sol_transactions.parquet")
    out = derive.solana_transactions(df.drop("signatures_size", "loaded_addresses_size")).collect()
    stored = {(r["block_number"], r["transaction_index"]): r for r in df.collect()}
    for r in out:
        was = stored[r["block_number"], r["transaction_index"]]
        assert r["account_keys_size"] == 44 * len(r["account_keys"] or [])
        if was["signatures"] and None not in was["signatures"] and was["signatures_size"] is not None:
            assert r["signatures_size"] == was["signatures_size"]
    evm = derive.evm_transactions(spark.createDataFrame([("0xa9f5787300",), ("0x",), (None,)], "input string")).collect()
    assert [(r["sighash"], r["input_size"]) for r in evm] == [("0xa9f57873", 12), (None, 2), (None, 0)]
    assert derive.sizes(spark.createDataFrame([("ü",)], "data string"), "data").first()["data_size"] == 2


def test_sinks(spark, tmp_path):
    tables = Tables({"blocks": spark.createDataFrame([(1, "h"), (2, None)], "number long, hash string")})
    e = Execution(parse({"type": "evm", "fields": {"block": {"number": True, "hash": True}}, "includeAllBlocks": True}).compile(), tables)
    sinks.write_lines(e, f"file://{tmp_path}/lines")
    text = "".join(gzip.open(p, "rt").read() for p in sorted((tmp_path / "lines").glob("*.gz")))
    assert [json.loads(x) for x in text.splitlines()] == [{"header": {"number": 1, "hash": "h"}}, {"header": {"number": 2, "hash": None}}]
    assert sinks.write_array(e, f"file://{tmp_path}", "a.json") and not sinks.write_array(e, f"file://{tmp_path}", "a.json")
    assert len(json.loads((tmp_path / "a.json").read_text())) == 2
    flat = [r["json"] for r in sinks.flat_rows(tables.get("blocks")).collect()]
    assert sorted(flat) == ['{"number":1,"hash":"h"}', '{"number":2,"hash":null}']


def test_sort_keys_name_filters_first():
    assert set(SORT_KEYS) <= set(DIALECTS)
    for kind, tables in SORT_KEYS.items():
        assert set(tables) == {t.name for t in DIALECTS[kind].catalog}
    assert sort_keys("evm", {"logs": ["block_number", "topic0", "log_index"], "x": ["y"]}) == {"logs": ["topic0", "block_number", "log_index"], "x": []}


def test_follower(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", DIALECTS["evm"].catalog, "evm")
    schema = "number long, hash string, parent_hash string"
    for n in range(3):
        store.append({"blocks": spark.createDataFrame([(n, f"h{n}", f"h{n - 1}")], schema)}, f"h{n - 1}")
    clock = [0.0]
    follower = Follower({"a": store, "b": store}, lambda: (10.0, {"a": 2, "b": None}), lambda: clock[0], delay=5)
    assert follower.step() == {}
    clock[0] = 15.0
    assert follower.step()["a"].first == 2 and follower.step() == {} and store.snapshot().first == 2
