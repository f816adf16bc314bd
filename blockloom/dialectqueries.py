"""Registered queries of the dialects for which the test data have no tables of their own.

Orders and line items are shaped into each dialect's tables: an order is a transaction (block: its number without the last two
digits, index: these), its line items are the transaction's parts. Whole tables go in; the SQL shapes them in the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions import derive
from blockloom.plans.execute import Execution, Tables
from blockloom.plans.request import parse
from blockloom.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _key(order: str) -> list:
    return [F.floor(F.col(order) / 100).cast("long").alias("block_number"), (F.col(order) % 100).cast("int").alias("transaction_index")]


def _orders(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "orders").select(*_key("o_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key"))


def _items(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "lineitem").select(
        *_key("l_orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"), F.col("l_quantity").cast("long").alias("quantity"), F.col("l_orderkey").alias("key"),
    )


def _blocks(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.select(F.col("block_number").alias("number")).unionByName(items.select(F.col("block_number").alias("number"))).distinct()


def _run(tables: dict[str, DataFrame], body: dict) -> Execution:
    return Execution(parse(body).compile(), Tables(tables))


_SHAPES = """WITH o AS (SELECT o_orderkey // 100 AS b, CAST(o_orderkey % 100 AS INTEGER) AS t, o_orderstatus AS status, o_custkey AS customer, o_orderpriority AS priority FROM orders),
  l AS (SELECT l_orderkey // 100 AS b, CAST(l_orderkey % 100 AS INTEGER) AS t, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag, l_linestatus AS line_status, CAST(floor(l_quantity) AS BIGINT) AS quantity FROM lineitem)"""
_TX = "b AS block_number, t AS transaction_index"
_SAME = "x.b = y.b AND x.t = y.t"


def _named(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Bitcoin: items are inputs and outputs.


def _bitcoin(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders, items = _orders(spark, root), _items(spark, root)
    key = ["block_number", "transaction_index"]
    inputs = items.select(*key, F.col("line").alias("input_index"), F.col("flag").alias("type"), _named("s", "supplier").alias("prevout_script_pub_key_address"), F.col("line_status").alias("prevout_script_pub_key_type"), (F.col("line_status") == "F").alias("prevout_generated"))
    outputs = items.select(*key, F.col("line").alias("output_index"), _named("p", "part").alias("script_pub_key_address"), F.col("flag").alias("script_pub_key_type"))
    return {"blocks": _blocks(orders, items), "transactions": orders.select(*key, F.col("key").cast("string").alias("hash")), "inputs": inputs, "outputs": outputs}


@_query(f"{_SHAPES} SELECT {_TX}, line AS output_index FROM l x WHERE part IN (7, 11) OR EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.supplier IN (3, 4) AND y.flag = 'R' AND y.line_status = 'F')")
def bitcoin_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Outputs to an address, and those of transactions that spend from another one."""
    body = {"type": "bitcoin", "inputs": [{"prevoutScriptPubKeyAddress": ["s3", "s4"], "type": ["R"], "prevoutGenerated": True, "transactionOutputs": True}], "outputs": [{"scriptPubKeyAddress": ["p7", "p11"]}]}
    return _run(_bitcoin(spark, root), body).selected("outputs").select("block_number", "transaction_index", "output_index")


@_query(f"{_SHAPES} SELECT {_TX} FROM o x WHERE EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.part IN (7, 11))")
def bitcoin_transactions(spark: SparkSession, root: str) -> DataFrame:
    body = {"type": "bitcoin", "outputs": [{"scriptPubKeyAddress": ["p7", "p11"], "transaction": True}]}
    return _run(_bitcoin(spark, root), body).selected("transactions").select("block_number", "transaction_index")


# Fuel: items are receipts and typed inputs and outputs.


def _fuel(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders, items = _orders(spark, root), _items(spark, root)
    its = ["block_number", "transaction_index"]
    transactions = orders.select("block_number", F.col("transaction_index").alias("index"), F.col("status").alias("type"))
    receipts = items.select(*its, F.col("line").alias("index"), F.col("flag").alias("receipt_type"), _named("c", "part").alias("contract"))
    inputs = items.select(*its, F.col("line").alias("index"), F.when(F.col("flag") == "A", "InputCoin").when(F.col("flag") == "N", "InputMessage").otherwise("InputContract").alias("type"), _named("s", "supplier").alias("coin_owner"), _named("m", "part").alias("message_sender"))
    outputs = items.select(*its, F.col("line").alias("index"), F.when(F.col("line_status") == "F", "CoinOutput").otherwise("ChangeOutput").alias("type"))
    return {"blocks": _blocks(orders, items), "transactions": transactions, "receipts": receipts, "inputs": inputs, "outputs": outputs}


@_query(f"""{_SHAPES}, k AS (SELECT b, t FROM o WHERE status = 'P')
  SELECT {_TX}, line AS "index", 'receipt' AS kind FROM l x WHERE flag = 'R' AND part IN (7, 11) OR EXISTS (SELECT 1 FROM k y WHERE {_SAME})
  UNION ALL SELECT {_TX}, line, 'input' FROM l x WHERE (flag = 'A' AND supplier = 3) OR EXISTS (SELECT 1 FROM k y WHERE {_SAME})""")
def fuel_receipts_and_inputs(spark: SparkSession, root: str) -> DataFrame:
    body = {
        "type": "fuel",
        "transactions": [{"type": ["P"], "receipts": True, "inputs": True}],
        "receipts": [{"type": ["R"], "contract": ["c7", "c11"]}],
        "inputs": [{"type": ["InputCoin"], "coinOwner": ["s3"]}],
    }
    e = _run(_fuel(spark, root), body)
    parts = [e.selected(t).select("block_number", "transaction_index", "index", F.lit(kind).alias("kind")) for t, kind in (("receipts", "receipt"), ("inputs", "input"))]
    return parts[0].unionByName(parts[1])


@_query(f"{_SHAPES} SELECT b AS block_number, t AS \"index\" FROM o x WHERE EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.flag = 'N' AND y.part = 7) OR EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.line_status = 'O')")
def fuel_transactions(spark: SparkSession, root: str) -> DataFrame:
    body = {"type": "fuel", "inputs": [{"type": ["InputMessage"], "messageSender": ["m7"], "transaction": True}], "outputs": [{"type": ["ChangeOutput"], "transaction": True}]}
    return _run(_fuel(spark, root), body).selected("transactions").select("block_number", "index")


# Tron: typed transactions, logs and internal transactions.


def _tron(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders, items = _orders(spark, root), _items(spark, root)
    its = ["block_number", "transaction_index"]
    kind = F.when(F.col("status") == "F", "TransferContract").when(F.col("status") == "O", "TriggerSmartContract").otherwise("VoteWitnessContract")
    transactions = orders.select(*its, kind.alias("type"), _named("0xc", "customer").alias("_transfer_contract_to"), _named("0xc", "customer").alias("_trigger_smart_contract_contract"))
    logs = items.select(*its, F.col("line").alias("log_index"), _named("0xp", "part").alias("address"), F.col("flag").alias("topic0"))
    internal = items.select(*its, F.col("line").alias("internal_transaction_index"), _named("0xs", "supplier").alias("caller_address"))
    return {"blocks": _blocks(orders, items), "transactions": transactions, "logs": logs, "internal_transactions": internal}


@_query(f"{_SHAPES} SELECT {_TX}, line AS log_index FROM l x WHERE part = 7 OR EXISTS (SELECT 1 FROM o y WHERE {_SAME} AND y.status = 'F' AND y.customer BETWEEN 1 AND 9)")
def tron_logs(spark: SparkSession, root: str) -> DataFrame:
    """Addresses are compared in lower case; a request of one contract type is bound to that type."""
    body = {"type": "tron", "transferTransactions": [{"to": [f"0xC{i}" for i in range(1, 10)], "logs": True}], "logs": [{"address": ["0xP7"]}]}
    return _run(_tron(spark, root), body).selected("logs").select("block_number", "transaction_index", "log_index")


@_query(f"{_SHAPES} SELECT {_TX} FROM o x WHERE (status = 'O' AND customer = 5) OR EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.supplier = 3)")
def tron_transactions(spark: SparkSession, root: str) -> DataFrame:
    body = {"type": "tron", "triggerSmartContractTransactions": [{"contract": ["0xc5"]}], "internalTransactions": [{"caller": ["0xs3"], "transaction": True}]}
    return _run(_tron(spark, root), body).selected("transactions").select("block_number", "transaction_index")


# Substrate: an order is an extrinsic with a call, its items are subcalls and events.


def _substrate(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders, items = _orders(spark, root), _items(spark, root)
    extrinsics = orders.select("block_number", F.col("transaction_index").alias("index"), (F.col("status") == "F").alias("success"))
    group = ["block_number", F.col("transaction_index").alias("extrinsic_index")]
    none = F.lit(None).cast("string")
    calls = orders.select(*group, F.array().cast("array<int>").alias("address"), F.concat(F.lit("Order."), "status").alias("name"), none.alias("_ethereum_transact_to")).unionByName(
        items.select(*group, F.array("line").alias("address"), F.when(F.col("flag") == "A", "Ethereum.transact").otherwise("Item.place").alias("name"), _named("0xp", "part").alias("_ethereum_transact_to"))
    )
    events = items.select(*group, (F.col("transaction_index") * 100 + F.col("line")).alias("index"), F.array("line").alias("call_address"), F.when(F.col("flag") == "R", "EVM.Log").otherwise("Item.placed").alias("name"), _named("0xs", "supplier").alias("_evm_log_address"))
    return {"blocks": _blocks(orders, items), "extrinsics": extrinsics, "calls": calls, "events": events}


_CALLS = ", c AS (SELECT b, t, CAST([] AS INTEGER[]) AS a, 'Order.' || status AS name, NULL AS part FROM o UNION ALL SELECT b, t, [line], CASE WHEN flag = 'A' THEN 'Ethereum.transact' ELSE 'Item.place' END, part FROM l)"


@_query(f"{_SHAPES}{_CALLS} SELECT b AS block_number, t AS extrinsic_index, array_to_string(a, '.') AS address FROM c x WHERE EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND (len(x.a) = 0 OR x.a = [y.line]) AND ((y.flag = 'R' AND y.supplier = 3) OR (y.flag = 'A' AND y.part = 7)))")
def substrate_calls(spark: SparkSession, root: str) -> DataFrame:
    """Calls of a kind with what lies above them, and the stack of an event's call."""
    body = {"type": "substrate", "ethereumTransactions": [{"to": ["0xP7"], "stack": True}], "evmLogs": [{"address": ["0xS3"], "stack": True}]}
    e = _run(_substrate(spark, root), body)
    return e.selected("calls").select("block_number", "extrinsic_index", F.array_join("address", ".").alias("address"))


@_query(f"{_SHAPES} SELECT b AS block_number, t * 100 + line AS \"index\" FROM l x WHERE (flag = 'R' AND supplier = 3) OR EXISTS (SELECT 1 FROM l y WHERE {_SAME} AND y.line = x.line AND y.flag = 'A' AND y.part IN (7, 11))")
def substrate_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of a contract, and all events at or below calls to an address."""
    body = {"type": "substrate", "evmLogs": [{"address": ["0xs3"]}], "ethereumTransactions": [{"to": ["0xP7", "0xP11"], "events": True}]}
    return _run(_substrate(spark, root), body).selected("events").select("block_number", "index")


# Replica commands: an order is an action whose JSON names its items.


def _replica(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    items = _items(spark, root)
    order = F.struct(F.col("part").alias("a"), _named("0x", "line").alias("c"))
    named = items.groupBy("block_number", "transaction_index").agg(F.collect_list(order).alias("orders"), F.min("flag").alias("flag"), F.max("supplier").alias("supplier"))
    action = F.to_json(F.struct(F.when(F.col("flag") == "A", "order").otherwise("batchModify").alias("type"), F.when(F.col("flag") == "A", F.col("orders")).alias("orders"), F.when(F.col("flag") != "A", F.transform("orders", lambda x: F.struct(x.alias("order")))).alias("modifies")))
    actions = named.select("block_number", F.col("transaction_index").alias("action_index"), action.alias("action"), _named("0xu", "supplier").alias("user"), F.lit("{}").alias("response"), F.lit("ok").alias("status"))
    return {"blocks": items.select(F.col("block_number").alias("number")).distinct(), "actions": derive.replica_actions(actions)}


@_query(f"""{_SHAPES}, a AS (SELECT b, t, list(part) AS parts, list('0x' || line) AS lines, min(flag) AS flag, max(supplier) AS supplier FROM l GROUP BY 1, 2)
  SELECT b AS block_number, t AS action_index, CASE flag WHEN 'A' THEN 'order' ELSE 'batchModify' END AS action_type FROM a WHERE (flag = 'A' AND list_has_any(parts, [7, 11])) OR (flag <> 'A' AND list_has_any(lines, ['0x6']) AND supplier = 60)""")
def replica_actions(spark: SparkSession, root: str) -> DataFrame:
    """Actions by the assets and client ids that their JSON names."""
    body = {"type": "hyperliquidReplicaCmds", "orderActions": [{"containsAsset": [7, 11]}], "batchModifyActions": [{"containsCloid": ["0x6"], "user": ["0xu60"]}]}
    return _run(_replica(spark, root), body).selected("actions").select("block_number", "action_index", "action_type")


# EVM traces and state differences.


def _traced(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    orders, items = _orders(spark, root), _items(spark, root)
    its = ["block_number", "transaction_index"]
    none = F.lit(None).cast("string")
    top = orders.select(*its, F.array().cast("array<int>").alias("trace_address"), F.lit("call").alias("type"), _named("0xc", "customer").alias("call_to"), none.alias("suicide_address"))
    middle = items.select(*its, F.array("line").alias("trace_address"), F.when(F.col("flag") == "R", "create").otherwise("call").alias("type"), _named("0xp", "part").alias("call_to"), none.alias("suicide_address"))
    leaves = items.where("line_status = 'F'").select(*its, F.array("line", F.lit(0)).alias("trace_address"), F.lit("suicide").alias("type"), none.alias("call_to"), _named("0xs", "supplier").alias("suicide_address"))
    diffs = items.select(*its, _named("0xs", "supplier").alias("address"), F.col("line").cast("string").alias("key"), F.when(F.col("flag") == "A", "+").when(F.col("flag") == "N", "*").otherwise("-").alias("kind"))
    return {"blocks": _blocks(orders, items), "transactions": orders.select(*its, F.col("key").cast("string").alias("hash")), "traces": top.unionByName(middle).unionByName(leaves), "statediffs": diffs}


_TRACES = """, c AS (SELECT b, t, CAST([] AS INTEGER[]) AS a, 'call' AS type, '0xc' || customer AS call_to, NULL AS suicide FROM o UNION ALL SELECT b, t, [line], CASE flag WHEN 'R' THEN 'create' ELSE 'call' END, '0xp' || part, NULL FROM l
  UNION ALL SELECT b, t, [line, 0], 'suicide', NULL, '0xs' || supplier FROM l WHERE line_status = 'F')"""
_TRACE = "b AS block_number, t AS transaction_index, array_to_string(a, '.') AS trace_address, type"


def _traces(e: Execution) -> DataFrame:
    return e.selected("traces").select("block_number", "transaction_index", F.array_join("trace_address", ".").alias("trace_address"), "type")


@_query(f"{_SHAPES}{_TRACES}, k AS (SELECT DISTINCT b, t, a FROM c WHERE type = 'call' AND call_to IN ('0xc5', '0xp7')) SELECT {_TRACE} FROM c y WHERE (type = 'call' AND call_to IN ('0xc5', '0xp7')) OR EXISTS (SELECT 1 FROM k x WHERE {_SAME} AND len(x.a) < len(y.a) AND list_slice(y.a, 1, len(x.a)) = x.a)")
def evm_subtraces(spark: SparkSession, root: str) -> DataFrame:
    """Calls to an address with all that they caused."""
    return _traces(_run(_traced(spark, root), {"type": "evm", "traces": [{"type": ["call"], "callTo": ["0xC5", "0xP7"], "subtraces": True}]}))


@_query(f"{_SHAPES}{_TRACES}, k AS (SELECT DISTINCT b, t, a FROM c WHERE type = 'suicide' AND suicide = '0xs3') SELECT {_TRACE} FROM c y WHERE EXISTS (SELECT 1 FROM k x WHERE {_SAME} AND len(y.a) <= len(x.a) AND list_slice(x.a, 1, len(y.a)) = y.a)")
def evm_trace_parents(spark: SparkSession, root: str) -> DataFrame:
    """Self-destructions of an address with all that led to them."""
    return _traces(_run(_traced(spark, root), {"type": "evm", "traces": [{"type": ["suicide"], "suicideAddress": ["0xS3"], "parents": True}]}))


@_query(f"{_SHAPES} SELECT {_TX}, '0xs' || supplier AS address, CAST(line AS VARCHAR) AS key FROM l x WHERE (flag = 'A' AND supplier = 3) OR EXISTS (SELECT 1 FROM o y WHERE {_SAME} AND y.status = 'P')")
def evm_state_diffs(spark: SparkSession, root: str) -> DataFrame:
    """Differences of an address by kind, and those of transactions chosen otherwise."""
    tables = _traced(spark, root)
    tables["transactions"] = _orders(spark, root).select("block_number", "transaction_index", F.lower("status").alias("sighash"))
    body = {"type": "evm", "stateDiffs": [{"address": ["0xS3"], "kind": ["+"]}], "transactions": [{"sighash": ["p"], "stateDiffs": True}]}
    return _run(tables, body).selected("statediffs").select("block_number", "transaction_index", "address", "key")


# Solana instructions with the writer's derived columns.


def _instructions(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    t = load(spark, root, "sol_transactions")
    its = ["block_number", "transaction_index"]
    raw = t.where("account_keys is not null").select(*its, F.array(F.lit(0)).alias("instruction_address"), F.col("fee_payer").alias("program_id"), F.col("account_keys").alias("accounts"), F.lit(None).cast("string").alias("data"), F.lit(True).alias("is_committed"))
    return {"blocks": t.select(F.col("block_number").alias("number")).distinct(), "transactions": t.select(*its, "fee_payer"), "instructions": derive.solana_instructions(raw)}


_FIRST = "(SELECT min(account_keys[1]) FROM sol_transactions)"
_LAST = "(SELECT max(account_keys[1]) FROM sol_transactions)"


@_query(f"SELECT block_number, transaction_index, account_keys[1] AS a0, CAST(greatest(len(account_keys) - 16, 0) AS INTEGER) AS rest, 44 * len(account_keys) AS accounts_size FROM sol_transactions WHERE account_keys[1] IN ({_FIRST}, {_LAST}) OR fee_payer = (SELECT max(fee_payer) FROM sol_transactions)")
def solana_instructions(spark: SparkSession, root: str) -> DataFrame:
    """Instructions by their first account or program, with the positional columns that a writer makes."""
    table = load(spark, root, "sol_transactions")
    least, greatest, program = table.agg(F.min(F.get("account_keys", F.lit(0))), F.max(F.get("account_keys", F.lit(0))), F.max("fee_payer")).first()
    known = lambda *x: [v for v in x if v is not None]
    body = {"type": "solana", "instructions": [{"a0": known(least, greatest)}, {"programId": known(program)}]}
    chosen = _run(_instructions(spark, root), body).selected("instructions")
    if chosen is None:
        chosen = _instructions(spark, root)["instructions"].limit(0)
    rest = F.when(F.col("rest_accounts").isNotNull(), F.size("rest_accounts")).otherwise(0)
    return chosen.select("block_number", "transaction_index", "a0", rest.alias("rest"), "accounts_size")
