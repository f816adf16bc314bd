"""Registered queries of the block engine, over whole tables, with the SQL that checks them.

EVM queries run on evm_logs and evm_transactions (the header table is the set of block numbers), fills queries on
hl_blocks and fills, tree queries on region, nation, customer and orders: nations and customers are calls addressed
[nation] and [nation, customer] in the group of their region, orders are events of their customer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.catalog import Catalog, TableDef, camel
from blockloom.dialects import evm as evm_dialect
from blockloom.functions import base58, bloom, derive, exp
from blockloom.operators import relations as rel
from blockloom.operators.predicates import All, Any_, Bloom, Compare, ContainsAny, Eq, In, discriminator
from blockloom.plans.execute import BUDGET, Execution, Tables
from blockloom.plans.plan import PARENTS, PlanBuilder
from blockloom.plans.request import parse
from blockloom.session import materialize, shared_folder
from blockloom.sources.layout import write_table
from blockloom.sources.store import broken_links
from blockloom.sources.tables import load, normal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Filters for the queries below.
TRANSFER = "0x23e0847681f30c60a21ac773d9e30fe7f3a213104e3538e22d4f1ed205c99490"
SWAP = "0x1c6b93cf506180fef37aedecff24fe89ce81899be2dd22167cb7ebb8eeeb38a3"
CALLS = ["0xa9f57873", "0x279dc607"]
COINS = ["kSSXXV", "kVUK", "NDR", "YO", "EZ", "XB", "AVG", "EXFTT", "@105", "@122", "@139", "@156", "@173"]
_in = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"


def evm(spark: SparkSession, root: str) -> Tables:
    transactions, logs = load(spark, root, "evm_transactions"), load(spark, root, "evm_logs")
    blocks = transactions.select(F.col("block_number").alias("number")).unionByName(logs.select(F.col("block_number").alias("number"))).distinct()
    return Tables({"blocks": blocks, "transactions": transactions, "logs": logs})


def fills(spark: SparkSession, root: str) -> Tables:
    headers = load(spark, root, "hl_blocks").groupBy("number").agg(F.min(F.struct(F.lower(F.trim("hash")).alias("hash"), F.lower(F.trim("parent_hash")).alias("parent_hash"), "timestamp")).alias("h"))
    return Tables({"blocks": headers.select("number", "h.*"), "fills": load(spark, root, "fills")})


def run(spark: SparkSession, root: str, tables: Callable[[SparkSession, str], Tables], body: dict, **kw) -> Execution:
    return Execution(parse(body).compile(), tables(spark, root), **kw)


def _logs(e: Execution) -> DataFrame:
    return e.selected("logs").select("block_number", "log_index", "transaction_index", "topic0")


_LOGS = "block_number, log_index, transaction_index, topic0"

# Predicates -----------------------------------------------------------------------------------------------------


@_query(f"SELECT {_LOGS} FROM evm_logs WHERE topic0 = '{TRANSFER}' AND block_number BETWEEN 18000000 AND 18000300")
def scan_filter(spark: SparkSession, root: str) -> DataFrame:
    """One value and a block range, both pushed to the scan; the value is given in upper case."""
    return _logs(run(spark, root, evm, {"type": "evm", "fromBlock": 18000000, "toBlock": 18000300, "logs": [{"topic0": [TRANSFER.upper()]}]}))


@_query(f"SELECT {_LOGS} FROM evm_logs WHERE topic0 IN ('{TRANSFER}', '{SWAP}')")
def in_list_small(spark: SparkSession, root: str) -> DataFrame:
    return _logs(run(spark, root, evm, {"type": "evm", "logs": [{"topic0": [TRANSFER, SWAP, "0x00"]}]}))


@_query(f"SELECT block_number, fill_index, coin, dir FROM fills WHERE coin IN {_in(COINS)}")
def in_list_large(spark: SparkSession, root: str) -> DataFrame:
    e = run(spark, root, fills, {"type": "hyperliquidFills", "fills": [{"coin": COINS}]})
    return e.selected("fills").select("block_number", "fill_index", "coin", "dir")


@_query("SELECT block_number, transaction_index, nonce FROM evm_transactions WHERE nonce BETWEEN 10 AND 99")
def range_between(spark: SparkSession, root: str) -> DataFrame:
    e = run(spark, root, evm, {"type": "evm", "transactions": [{"firstNonce": 10, "lastNonce": 99}]})
    return e.selected("transactions").select("block_number", "transaction_index", "nonce")


@_query("SELECT block_number, transaction_index FROM evm_transactions WHERE nonce >= 1000")
def range_open(spark: SparkSession, root: str) -> DataFrame:
    """Out-of-range literals fold away: the upper bound is beyond any long."""
    df = load(spark, root, "evm_transactions")
    return df.where(Compare("nonce", 1000, 1 << 70).on(df)).select("block_number", "transaction_index")


@_query(f"SELECT {_LOGS} FROM evm_logs WHERE topic0 = '{SWAP}'")
def never_filter(spark: SparkSession, root: str) -> DataFrame:
    """A request with an empty list matches nothing, whatever else it asks; the other one still counts."""
    return _logs(run(spark, root, evm, {"type": "evm", "logs": [{"topic0": [], "transactionLogs": True}, {"topic0": [SWAP]}]}))


@_query("SELECT block_number, fill_index FROM fills")
def no_condition(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, root, fills, {"type": "hyperliquidFills", "fills": [{}, {"coin": ["YO"]}]}).selected("fills").select("block_number", "fill_index")


@_query("SELECT block_number, transaction_index, value FROM evm_transactions WHERE value >= '0x1'")
def non_zero_value(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "evm_transactions")
    return df.where(Compare("value", low="0x1").on(df)).select("block_number", "transaction_index", "value")


@_query("SELECT block_number, transaction_index, status FROM evm_transactions WHERE status = 0")
def equals_number(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "evm_transactions")
    return df.where(In("status", (0, 1 << 40)).on(df)).select("block_number", "transaction_index", "status")


@_query("SELECT block_number, transaction_index, sighash, status FROM evm_transactions WHERE (sighash = '0xa9f57873' AND status = 1) OR sighash = '0x279dc607' OR status IS NOT DISTINCT FROM 0")
def and_or_predicates(spark: SparkSession, root: str) -> DataFrame:
    """A null on one side of OR doesn't hide a match on the other."""
    df = load(spark, root, "evm_transactions")
    p = Any_((All((Eq("sighash", "0xa9f57873"), Eq("status", 1))), Eq("sighash", "0x279dc607"), Eq("status", 0)))
    return df.where(p.on(df)).select("block_number", "transaction_index", "sighash", "status")


@_query("SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['battery', 'Batterie', 'zipper'])")
def list_contains_text(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return df.where(ContainsAny("words", ("battery", "Batterie", "zipper")).on(df)).select("doc_id")


@_query("SELECT block_number, transaction_index FROM sol_transactions WHERE len(list_filter(flatten(list_transform(coalesce(address_table_lookups, []), lambda x: coalesce(x.readonly_indexes, []))), lambda x: x IN (1, 7, 196))) > 0")
def list_contains_number(spark: SparkSession, root: str) -> DataFrame:
    lists = F.transform(F.coalesce("address_table_lookups", F.expr("array()")), lambda x: F.coalesce(x["readonly_indexes"], F.expr("array()")))
    df = load(spark, root, "sol_transactions").select("block_number", "transaction_index", F.flatten(lists).alias("indexes"))
    return df.where(ContainsAny("indexes", (1, 7, 196, 1 << 20)).on(df)).select("block_number", "transaction_index")


def _accounts(spark: SparkSession, root: str) -> tuple[DataFrame, tuple[str, ...]]:
    df = load(spark, root, "sol_transactions").select("block_number", "transaction_index", "account_keys", bloom.bloom_column(F.col("account_keys")).alias("accounts_bloom"))
    wanted = load(spark, root, "sol_transactions").agg(F.min("fee_payer"), F.max("fee_payer")).first()
    return df, tuple(x for x in wanted if x is not None)


@_query()
def bloom_probe(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose filter may hold one of two accounts; false positives stay in."""
    df, wanted = _accounts(spark, root)
    return df.where(Bloom("accounts_bloom", wanted).on(df)).select("block_number", "transaction_index")


@_query("SELECT 0 AS missed, true AS few_false FROM sol_transactions HAVING count(*) > 0")
def bloom_errors(spark: SparkSession, root: str) -> DataFrame:
    """Over all rows: how many that hold one of the accounts the filter misses (none), and whether at most one in fifty of the others passes it."""
    df, wanted = _accounts(spark, root)
    passes, holds = Bloom("accounts_bloom", wanted).on(df), F.coalesce(ContainsAny("account_keys", wanted).on(df), F.lit(False))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(holds & ~F.coalesce(passes, F.lit(False))).cast("int").alias("missed"), F.count_if(passes & ~holds).alias("false"), F.count_if(~holds).alias("others"))
    return counts.where("n > 0").select("missed", (F.col("false") * 50 <= F.col("others")).alias("few_false"))


@_query("SELECT block_number, transaction_index, fee_payer AS text FROM sol_transactions")
def base58_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Base58 text decoded and encoded again."""
    raw = base58.decode_column(F.col("fee_payer"))
    return load(spark, root, "sol_transactions").select("block_number", "transaction_index", base58.encode_column(raw).alias("text"))


@_query("SELECT block_number, transaction_index, CASE WHEN signatures IS NULL THEN 'null' ELSE '[' || coalesce(array_to_string(list_transform(signatures, lambda y: coalesce(y, 'null')), ','), '') || ']' END AS spliced FROM sol_transactions")
def list_of_json(spark: SparkSession, root: str) -> DataFrame:
    """A list whose elements are rendered by an expression of their own, here spliced as they are."""
    df = load(spark, root, "sol_transactions")
    return df.select("block_number", "transaction_index", _column(df, "signatures", exp.ListOf(exp.Json())).alias("spliced"))


@_query("SELECT block_number, transaction_index FROM sol_transactions WHERE list_contains(account_keys, (SELECT min(fee_payer) FROM sol_transactions)) OR list_contains(account_keys, (SELECT max(fee_payer) FROM sol_transactions))")
def bloom_recheck(spark: SparkSession, root: str) -> DataFrame:
    """The filter first, then the list itself: exact."""
    df, wanted = _accounts(spark, root)
    return df.where(Bloom("accounts_bloom", wanted).on(df) & ContainsAny("account_keys", wanted).on(df)).select("block_number", "transaction_index")


@_query("SELECT block_number, log_index FROM evm_logs WHERE lower(trim(topic0, ' ')) LIKE '0x23%' OR lower(trim(topic0, ' ')) LIKE '0x1c6b93%' OR lower(trim(topic0, ' ')) LIKE '0x1a7b75e59384d12a%'")
def discriminator_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Prefixes of 1, 3 and 8 bytes on the columns d1, d3 and d8."""
    logs = load(spark, root, "evm_logs").select("block_number", "log_index", F.unhex(F.substring(F.lower(F.trim("topic0")), 3, 64)).alias("raw"))
    df = logs.select("*", *[c.alias(n) for n, c in base58.prefix_columns(F.col("raw")).items()])
    return df.where(discriminator(["0x23", "0x1c6b93", "0x1a7b75e59384d12a"]).on(df)).select("block_number", "log_index")


@_query()
def base58_prefixes(spark: SparkSession, root: str) -> DataFrame:
    """The prefix columns of decoded Base58 text."""
    raw = load(spark, root, "sol_transactions").select("block_number", "transaction_index", base58.decode_column(F.col("fee_payer")).alias("raw"))
    d = base58.prefix_columns(F.col("raw"))
    return raw.select("block_number", "transaction_index", d["d1"].alias("d1"), d["d2"].alias("d2"), d["d4"].alias("d4"), d["d8"].cast("string").alias("d8"), F.hex(d["d3"]).alias("d3"))


# Relations --------------------------------------------------------------------------------------------------------

_TX = "block_number, transaction_index, hash"


def _transactions(e: Execution) -> DataFrame:
    return e.selected("transactions").select("block_number", "transaction_index", "hash")


@_query("SELECT block_number, fill_index FROM fills WHERE coin = 'YO' OR dir = 'Open Long' OR (coin = 'NDR' AND fee_token = 'USDX')")
def multi_request_or(spark: SparkSession, root: str) -> DataFrame:
    body = {"type": "hyperliquidFills", "fills": [{"coin": ["YO"]}, {"dir": ["Open Long"]}, {"coin": ["NDR"], "feeToken": ["USDX"]}]}
    return run(spark, root, fills, body).selected("fills").select("block_number", "fill_index")


@_query(f"SELECT {_LOGS} FROM evm_logs l WHERE EXISTS (SELECT 1 FROM evm_transactions t WHERE t.block_number = l.block_number AND t.transaction_index = l.transaction_index AND t.sighash IN {_in(CALLS)})")
def semi_join_children(spark: SparkSession, root: str) -> DataFrame:
    return _logs(run(spark, root, evm, {"type": "evm", "transactions": [{"sighash": CALLS, "logs": True}]}))


@_query(f"SELECT {_TX} FROM evm_transactions t WHERE EXISTS (SELECT 1 FROM evm_logs l WHERE t.block_number = l.block_number AND t.transaction_index = l.transaction_index AND l.topic0 = '{SWAP}')")
def semi_join_parent(spark: SparkSession, root: str) -> DataFrame:
    return _transactions(run(spark, root, evm, {"type": "evm", "logs": [{"topic0": [SWAP], "transaction": True}]}))


@_query(f"SELECT {_LOGS} FROM evm_logs l WHERE topic0 = '{SWAP}' OR EXISTS (SELECT 1 FROM evm_logs m WHERE m.block_number = l.block_number AND m.transaction_index = l.transaction_index AND m.topic0 = '{SWAP}')")
def self_join_siblings(spark: SparkSession, root: str) -> DataFrame:
    return _logs(run(spark, root, evm, {"type": "evm", "logs": [{"topic0": [SWAP], "transactionLogs": True}]}))


@_query(
    f"""SELECT {_LOGS} FROM evm_logs l WHERE topic0 = '{TRANSFER}' AND address = '0x370a197d9227c5a3a7c4803151c84548a6b2a82d'
    OR EXISTS (SELECT 1 FROM evm_transactions t WHERE t.block_number = l.block_number AND t.transaction_index = l.transaction_index AND t.sighash = '0x279dc607')"""
)
def exists_or_predicate(spark: SparkSession, root: str) -> DataFrame:
    body = {"type": "evm", "logs": [{"topic0": [TRANSFER], "address": ["0x370A197d9227c5a3a7c4803151c84548a6b2a82d"]}], "transactions": [{"sighash": ["0x279dc607"], "logs": True}]}
    return _logs(run(spark, root, evm, body))


@_query(f"SELECT {_TX} FROM evm_transactions")
def full_scan_absorption(spark: SparkSession, root: str) -> DataFrame:
    """A request for everything makes relations into the same tables needless; the plan is one scan."""
    body = {"type": "evm", "transactions": [{"logs": True}], "logs": [{"topic0": [SWAP], "transaction": True, "transactionLogs": True}]}
    return _transactions(run(spark, root, evm, body))


TREE = Catalog([TableDef("blocks", ("number",)), TableDef("calls", ("block_number", "extrinsic_index", "address")), TableDef("events", ("block_number", "index"))])
_CALL = ("block_number", "extrinsic_index", "address")
_ITS_CALL = ("block_number", "extrinsic_index", "call_address")


def tree(spark: SparkSession, root: str) -> Tables:
    nation, customer = load(spark, root, "nation"), load(spark, root, "customer")
    one = lambda c: F.col(c).cast("int")
    nations = nation.select(F.col("n_regionkey").cast("long").alias("block_number"), F.lit(0).alias("extrinsic_index"), F.array(one("n_nationkey")).alias("address"), F.col("n_name").alias("name"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = placed.select(F.col("n_regionkey").cast("long").alias("block_number"), F.lit(0).alias("extrinsic_index"), F.array(one("n_nationkey"), one("c_custkey")).alias("address"), F.col("c_mktsegment").alias("name"))
    regions = load(spark, root, "region").select(F.col("r_regionkey").cast("long").alias("block_number"), F.lit(0).alias("extrinsic_index"), F.array().cast("array<int>").alias("address"), F.col("r_name").alias("name"))
    orders = load(spark, root, "orders").join(placed, F.col("o_custkey") == F.col("c_custkey"))
    # Urgent orders belong to the nation's call, the others to their customer's; high ones to a call that isn't there.
    address = F.when(F.col("o_orderpriority").startswith("1"), F.array(one("n_nationkey"))).when(F.col("o_orderpriority").startswith("2"), F.array(one("n_nationkey"), F.lit(-1))).otherwise(F.array(one("n_nationkey"), one("c_custkey")))
    events = orders.select(F.col("n_regionkey").cast("long").alias("block_number"), F.col("o_orderkey").alias("index"), F.lit(0).alias("extrinsic_index"), address.alias("call_address"), F.col("o_orderstatus").alias("name"), "o_totalprice")
    calls = regions.unionByName(nations).unionByName(customers)
    return Tables({"blocks": regions.select(F.col("block_number").alias("number")), "calls": calls, "events": events})


_TREE = """WITH calls AS (SELECT CAST(r_regionkey AS BIGINT) AS b, CAST([] AS INTEGER[]) AS a, r_name AS name FROM region
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), [CAST(n_nationkey AS INTEGER)], n_name FROM nation
    UNION ALL SELECT CAST(n_regionkey AS BIGINT), [CAST(n_nationkey AS INTEGER), CAST(c_custkey AS INTEGER)], c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
  events AS (SELECT CAST(n_regionkey AS BIGINT) AS b, o_orderkey AS i, o_orderstatus AS name, o_totalprice AS price, CASE WHEN o_orderpriority LIKE '1%' THEN [CAST(n_nationkey AS INTEGER)]
    WHEN o_orderpriority LIKE '2%' THEN [CAST(n_nationkey AS INTEGER), -1] ELSE [CAST(n_nationkey AS INTEGER), CAST(c_custkey AS INTEGER)] END AS a FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_BELOW = "len(x.a) {op} len(y.a) AND list_slice(y.a, 1, len(x.a)) = x.a"
_CALL_ROW = "b AS block_number, coalesce(array_to_string(a, '.'), '') AS address, name"


def _call_rows(df: DataFrame) -> DataFrame:
    return df.select("block_number", F.array_join("address", ".").alias("address"), "name")


def _related(spark: SparkSession, root: str, build: Callable[[PlanBuilder], None]) -> Execution:
    builder = PlanBuilder(TREE)
    build(builder)
    return Execution(builder.build(), tree(spark, root))


@_query(f"{_TREE} SELECT {_CALL_ROW} FROM calls y WHERE EXISTS (SELECT 1 FROM calls x WHERE x.b = y.b AND x.name IN ('FRANCE', 'CHINA', 'NATION_3') AND {_BELOW.format(op='<')}) OR name IN ('FRANCE', 'CHINA', 'NATION_3')")
def tree_children(spark: SparkSession, root: str) -> DataFrame:
    e = _related(spark, root, lambda b: b.request("calls", In("name", ("FRANCE", "CHINA", "NATION_3")), [b.tree("children", "calls")]))
    return _call_rows(e.selected("calls"))


@_query(f"{_TREE} SELECT {_CALL_ROW} FROM calls x WHERE EXISTS (SELECT 1 FROM calls y WHERE x.b = y.b AND y.name = 'BUILDING' AND {_BELOW.format(op='<=')})")
def tree_parents(spark: SparkSession, root: str) -> DataFrame:
    e = _related(spark, root, lambda b: b.request("calls", Eq("name", "BUILDING"), [b.tree(PARENTS, "calls")]))
    return _call_rows(e.selected("calls"))


@_query(f"{_TREE}, m AS (SELECT DISTINCT c.b, c.a FROM calls c JOIN events e ON e.b = c.b AND e.a = c.a WHERE c.name = 'MACHINERY' OR len(c.a) = 1) SELECT b AS block_number, i AS \"index\" FROM events y WHERE EXISTS (SELECT 1 FROM m x WHERE x.b = y.b AND {_BELOW.format(op='<=')})")
def tree_foreign_children(spark: SparkSession, root: str) -> DataFrame:
    """Events at or below calls that have an event of their own."""
    t = tree(spark, root)
    chosen = t.get("calls").where((F.col("name") == "MACHINERY") | (F.size("address") == 1))
    keys = rel.foreign_children(chosen, _CALL, t.get("events"), _ITS_CALL)
    return rel.select_rows(t.get("events"), None, [(_ITS_CALL, keys)]).select("block_number", "index")


@_query(f"{_TREE}, m AS (SELECT DISTINCT c.b, c.a FROM calls c JOIN events e ON e.b = c.b AND e.a = c.a WHERE e.name = 'F' AND e.price > 100000) SELECT {_CALL_ROW} FROM calls x WHERE EXISTS (SELECT 1 FROM m y WHERE x.b = y.b AND {_BELOW.format(op='<=')})")
def tree_foreign_parents(spark: SparkSession, root: str) -> DataFrame:
    """Calls at or above the call of some event, if that call is there."""
    e = _related(spark, root, lambda b: b.request("events", All((Eq("name", "F"), Compare("o_totalprice", low=100000.0000001))), [b.foreign("foreign_parents", "events", "calls", _CALL, _ITS_CALL)]))
    return _call_rows(e.selected("calls"))


# Weights, budget, headers -----------------------------------------------------------------------------------------

_BODY = {
    "type": "evm",
    "fromBlock": 18000000,
    "fields": {"block": {"number": True}, "log": {"logIndex": True, "transactionIndex": True, "address": True, "data": True, "topics": True}, "transaction": {"hash": True, "sighash": True, "input": True, "to": True}},
    "logs": [{"topic0": [SWAP], "transaction": True}, {"topic0": [TRANSFER]}],
    "transactions": [{"sighash": CALLS, "logs": True}],
}
#: Small, so that budget_cut cuts; the other queries have the standard budget.
_BUDGET = 400_000
#: Of a log: block_number, log_index, transaction_index, address and four topics, each 32; of a transaction: key, hash, sighash, to.
_WEIGHTS = f"""WITH blocks AS (SELECT DISTINCT block_number AS number FROM (SELECT block_number FROM evm_transactions UNION ALL SELECT block_number FROM evm_logs) WHERE block_number >= 18000000),
  l AS (SELECT * FROM evm_logs x WHERE block_number >= 18000000 AND (topic0 IN ('{SWAP}', '{TRANSFER}') OR EXISTS (SELECT 1 FROM evm_transactions t WHERE t.block_number = x.block_number AND t.transaction_index = x.transaction_index AND t.sighash IN {_in(CALLS)}))),
  t AS (SELECT * FROM evm_transactions x WHERE block_number >= 18000000 AND (sighash IN {_in(CALLS)} OR EXISTS (SELECT 1 FROM evm_logs y WHERE y.block_number = x.block_number AND y.transaction_index = x.transaction_index AND y.topic0 = '{SWAP}'))),
  items AS (SELECT block_number AS number, 8 * 32 + coalesce(data_size, 0) AS w FROM l UNION ALL SELECT block_number, 5 * 32 + coalesce(input_size, 0) FROM t),
  picked AS (SELECT number, 32 + sum(w) AS weight FROM (SELECT * FROM items UNION ALL SELECT min(number), 0 FROM blocks UNION ALL SELECT max(number), 0 FROM blocks) GROUP BY number),
  every AS (SELECT b.number, 32 + coalesce(sum(w), 0) AS weight FROM blocks b LEFT JOIN items i ON b.number = i.number GROUP BY b.number),
  run AS (SELECT number, weight, sum(weight) OVER (ORDER BY number) AS running FROM picked),
  cut AS (SELECT coalesce(max(CASE WHEN running <= {_BUDGET} THEN number END), min(number)) AS last_block FROM run),
  standard AS (SELECT coalesce(max(CASE WHEN running <= {BUDGET} THEN number END), min(number)) AS last_block FROM run)"""


@_query(f"{_WEIGHTS} SELECT number, CAST(weight AS BIGINT) AS weight FROM picked")
def weight_per_block(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, root, evm, _BODY).block_weights()


@_query(f"{_WEIGHTS} SELECT block_number, log_index, 8 * 32 + coalesce(data_size, 0) AS weight FROM l")
def weight_per_row(spark: SparkSession, root: str) -> DataFrame:
    e = run(spark, root, evm, _BODY)
    logs = e.selected("logs")
    return logs.select("block_number", "log_index", e.weight(evm_dialect.CATALOG["logs"], e.plan.outputs["logs"], logs).alias("weight"))


@_query(f"{_WEIGHTS} SELECT number, CAST(running AS BIGINT) AS running FROM run")
def running_weight(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, root, evm, _BODY).running().select("number", "running")


@_query(f"{_WEIGHTS} SELECT block_number, log_index FROM l WHERE block_number <= (SELECT last_block FROM cut)")
def budget_cut(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, root, evm, _BODY, budget=_BUDGET).items("logs").select("block_number", "log_index")


@_query(f"{_WEIGHTS} SELECT min(number) AS last_block FROM picked")
def budget_first_block(spark: SparkSession, root: str) -> DataFrame:
    """A budget that nothing fits into still gives the first block."""
    return run(spark, root, evm, _BODY, budget=1).kept()


@_query(f"{_WEIGHTS}, c2 AS (SELECT coalesce(max(CASE WHEN r <= {BUDGET} THEN number END), min(number)) AS k FROM (SELECT number, sum(weight) OVER (ORDER BY number) AS r FROM every)) SELECT number FROM blocks WHERE number <= (SELECT k FROM c2)")
def include_all_blocks(spark: SparkSession, root: str) -> DataFrame:
    return run(spark, root, evm, {**_BODY, "includeAllBlocks": True}).headers().select("number")


@_query(f"{_WEIGHTS} SELECT number FROM blocks WHERE number IN (SELECT number FROM run WHERE number <= (SELECT last_block FROM standard))")
def header_boundaries(spark: SparkSession, root: str) -> DataFrame:
    """Headers of blocks with items, and of the range's first and last block."""
    return run(spark, root, evm, _BODY).headers().select("number")


def _float(x: str) -> str:
    """SQL of a float's text: plain for decimal exponents from -5 to 9, else digits, e and the exponent."""
    t = f"CAST(abs({x}) AS VARCHAR)"
    m, e = f"split_part({t}, 'e', 1)", f"CAST(split_part({t}, 'e', 2) AS INTEGER)"
    i, d = f"split_part({t}, '.', 1)", f"rtrim(replace({t}, '.', ''), '0')"
    beyond = f"(CASE WHEN contains({m}, '.') THEN {m} ELSE {m} || '.0' END) || 'e' || {e}"
    small = f"CASE WHEN {e} = -5 THEN '0.0000' || replace({m}, '.', '') ELSE {beyond} END"
    large = f"left({d}, 1) || '.' || CASE WHEN length({d}) > 1 THEN substr({d}, 2) ELSE '0' END || 'e' || (length({i}) - 1)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN 'null' ELSE (CASE WHEN CAST({x} AS VARCHAR) LIKE '-%' THEN '-' ELSE '' END) || (CASE WHEN contains({t}, 'e') THEN {small} WHEN abs({x}) >= 1e10 THEN {large} ELSE {t} END) END"


def _text(column: str) -> str:
    return f"coalesce('\"' || {column} || '\"', 'null')"


_TOPICS = "'[' || CASE WHEN topic0 IS NULL THEN '' ELSE '\"' || topic0 || '\"' || CASE WHEN topic1 IS NULL THEN '' ELSE ',\"' || topic1 || '\"' || CASE WHEN topic2 IS NULL THEN '' ELSE ',\"' || topic2 || '\"' || CASE WHEN topic3 IS NULL THEN '' ELSE ',\"' || topic3 || '\"' END END END END || ']'"


@_query(
    f"""{_WEIGHTS},
  lj AS (SELECT block_number AS number, log_index AS k, '{{"logIndex":' || log_index || ',"transactionIndex":' || coalesce(CAST(transaction_index AS VARCHAR), 'null') || ',"address":' || {_text("address")} || ',"data":' || {_text("data")} || ',"topics":' || {_TOPICS} || '}}' AS j FROM l),
  tj AS (SELECT block_number AS number, transaction_index AS k, '{{"hash":' || {_text("hash")} || ',"to":' || {_text("to_address")} || ',"input":' || {_text("input")} || ',"sighash":' || {_text("sighash")} || '}}' AS j FROM t),
  ll AS (SELECT number, string_agg(j, ',' ORDER BY k, j) AS a FROM lj GROUP BY 1), tl AS (SELECT number, string_agg(j, ',' ORDER BY k, j) AS a FROM tj GROUP BY 1)
  SELECT r.number, '{{"header":{{"number":' || r.number || '}}' || coalesce(',"transactions":[' || tl.a || ']', '') || coalesce(',"logs":[' || ll.a || ']', '') || '}}' AS json
  FROM run r LEFT JOIN ll ON r.number = ll.number LEFT JOIN tl ON r.number = tl.number WHERE r.number <= (SELECT last_block FROM standard)"""
)
def multi_request_budget(spark: SparkSession, root: str) -> DataFrame:
    """The flagship: several requests with relations, the standard budget, and one nested record per block."""
    return run(spark, root, evm, _BODY).blocks()


_LIST_OF_TEXT = "CASE WHEN {x} IS NULL THEN 'null' ELSE '[' || coalesce(array_to_string(list_transform({x}, lambda y: coalesce('\"' || y || '\"', 'null')), ','), '') || ']' END"
_HL = """WITH h AS (SELECT number, min((lower(trim(hash, ' ')), lower(trim(parent_hash, ' ')))) AS x FROM hl_blocks GROUP BY 1),
  i AS (SELECT * FROM fills WHERE coin IN ('YO', 'EZ') OR dir = 'Close Short'), w AS (SELECT block_number AS number, count(*) * 672 AS w FROM i GROUP BY 1),
  p AS (SELECT h.number, 64 + coalesce(w.w, 0) AS w FROM h LEFT JOIN w ON h.number = w.number WHERE w.number IS NOT NULL OR h.number IN (SELECT min(number) FROM h UNION ALL SELECT max(number) FROM h)),
  r AS (SELECT number, sum(w) OVER (ORDER BY number) AS running FROM p), c AS (SELECT coalesce(max(CASE WHEN running <= 20971520 THEN number END), min(number)) AS last_block FROM r)"""


_FILL_FIELDS = [
    ("fill_index", "CAST(fill_index AS VARCHAR)"), ("user", _text('"user"')), ("coin", _text("coin")), ("px", _float("px")), ("sz", _float("sz")), ("side", _text("side")),
    ("time", "CAST(epoch_ms(\"time\") AS VARCHAR)"), ("start_position", _float("start_position")), ("dir", _text("dir")), ("closed_pnl", _float("closed_pnl")), ("hash", _text("hash")),
    ("oid", "CAST(oid AS VARCHAR)"), ("crossed", "CAST(crossed AS VARCHAR)"), ("fee", _float("fee")), ("builder_fee", _float("builder_fee")), ("tid", "CAST(tid AS VARCHAR)"), ("cloid", _text("cloid")),
    ("fee_token", _text("fee_token")), ("builder", _text("builder")), ("twap_id", "CAST(twap_id AS VARCHAR)"),
]
_FILL_JSON = " || ".join(f"""'{"," if i else "{{"}"{camel(name)}":' || coalesce({text}, 'null')""" for i, (name, text) in enumerate(_FILL_FIELDS)).replace("{{", "{") + " || '}'"


@_query(
    f"""{_HL}, j AS (SELECT block_number AS number, fill_index AS k, {_FILL_JSON} AS t FROM i),
  l AS (SELECT number, string_agg(t, ',' ORDER BY k, t) AS a FROM j GROUP BY 1)
  SELECT r.number, '{{"header":{{"number":' || r.number || ',"hash":"' || h.x[1] || '"}}' || coalesce(',"fills":[' || l.a || ']', '') || '}}' AS json FROM r JOIN h ON r.number = h.number LEFT JOIN l ON l.number = r.number WHERE r.number <= (SELECT last_block FROM c)"""
)
def fills_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Nested records of fills, all fields, with the standard budget; the first header of a number (by hash) stands for it."""
    chosen = {camel(name): True for name, _ in _FILL_FIELDS}
    body = {"type": "hyperliquidFills", "fields": {"block": {"number": True, "hash": True}, "fill": chosen}, "fills": [{"coin": ["YO", "EZ"]}, {"dir": ["Close Short"]}]}
    return run(spark, root, fills, body).blocks()


def solana(spark: SparkSession, root: str) -> Tables:
    transactions = load(spark, root, "sol_transactions").withColumn("account_keys_size", F.lit(0).cast("long")).withColumn("address_table_lookups_size", F.lit(0).cast("long"))
    return Tables({"blocks": transactions.select(F.col("block_number").alias("number")).distinct(), "transactions": transactions})


@_query(
    """WITH r AS (SELECT block_number AS number, sum(5 * 32 + coalesce(signatures_size, 0)) + 32 AS w FROM sol_transactions GROUP BY 1), u AS (SELECT number, sum(w) OVER (ORDER BY number) AS running FROM r),
  c AS (SELECT coalesce(max(CASE WHEN running <= 20971520 THEN number END), min(number)) AS last_block FROM u)
  SELECT block_number AS number, '{"header":{"number":' || block_number || '},"transactions":[' || string_agg(t, ',' ORDER BY k, t) || ']}' AS json FROM (
    SELECT block_number, transaction_index AS k, '{"transactionIndex":' || transaction_index || ',"version":' || CASE version WHEN -1 THEN '"legacy"' ELSE coalesce(CAST(version AS VARCHAR), 'null') END
    || ',"signatures":' || """
    + _LIST_OF_TEXT.replace("{x}", "signatures")
    + """ || ',"err":' || coalesce(err, 'null') || ',"fee":' || coalesce('"' || fee || '"', 'null') || '}' AS t FROM sol_transactions WHERE block_number <= (SELECT last_block FROM c)) GROUP BY 1"""
)
def solana_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Nested records of transactions with the standard budget: stored JSON, big numbers, versions, lists; weights of stored sizes."""
    chosen = dict.fromkeys(("transactionIndex", "version", "signatures", "err", "fee"), True)
    body = {"type": "solana", "fields": {"block": {"number": True}, "transaction": chosen}, "transactions": [{}]}
    return run(spark, root, solana, body).blocks()


# Projections --------------------------------------------------------------------------------------------------------


def _column(df: DataFrame, name: str, e: exp.Exp) -> Column:
    return e.text(F.col(name), df.schema[name].dataType)


@_query(f"SELECT block_number, log_index, {_TOPICS} AS topics FROM evm_logs")
def roll_until_null(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "evm_logs")
    return df.select("block_number", "log_index", exp.Roll(("topic0", "topic1", "topic2", "topic3")).row(lambda c: (F.col(c), df.schema[c].dataType)).alias("topics"))


@_query("SELECT block_number, fill_index, CASE side WHEN 'A' THEN '{\"kind\":\"A\",\"ask\":\"' || oid || '\"}' WHEN 'B' THEN '{\"kind\":\"B\",\"bid\":{\"crossed\":' || coalesce(CAST(crossed AS VARCHAR), 'null') || '}}' ELSE 'null' END AS json FROM fills")
def enum_switch(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "fills")
    ask = exp.Object((("kind", exp.Prop("side")), ("ask", exp.Prop("oid", exp.BigNum()))))
    bid = exp.Object((("kind", exp.Prop("side")), ("bid", exp.Object((("crossed", exp.Prop("crossed")),)))))
    return df.select("block_number", "fill_index", exp.Enum("side", (("A", ask), ("B", bid))).row(lambda c: (F.col(c), df.schema[c].dataType)).alias("json"))


@_query("SELECT block_number, transaction_index, coalesce('\"0x' || lpad(lower(printf('%x', nonce)), 16, '0') || '\"', 'null') AS hex8, coalesce('\"' || nonce || '\"', 'null') AS big FROM evm_transactions")
def hex_and_big_numbers(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "evm_transactions")
    return df.select("block_number", "transaction_index", _column(df, "nonce", exp.HexNum(8)).alias("hex8"), _column(df, "nonce", exp.BigNum()).alias("big"))


@_query("SELECT number, hash, CAST(coalesce(CAST(CAST(floor(epoch(\"timestamp\")) AS BIGINT) AS VARCHAR), 'null') AS VARCHAR) AS s, coalesce(CAST(epoch_ms(\"timestamp\") AS VARCHAR), 'null') AS ms FROM hl_blocks")
def timestamps(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "hl_blocks")
    return df.select("number", "hash", _column(df, "timestamp", exp.Time("s")).alias("s"), _column(df, "timestamp", exp.Time("ms")).alias("ms"))


@_query("SELECT block_number, transaction_index, CASE version WHEN -1 THEN '\"legacy\"' ELSE coalesce(CAST(version AS VARCHAR), 'null') END AS version, coalesce(err, 'null') AS err FROM sol_transactions")
def version_and_json(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "sol_transactions")
    return df.select("block_number", "transaction_index", _column(df, "version", exp.Version()).alias("version"), _column(df, "err", exp.Json()).alias("err"))


_LIST = "CASE WHEN {x} IS NULL THEN 'null' ELSE '[' || coalesce(array_to_string(list_transform({x}, lambda y: {e}), ','), '') || ']' END"
_STRINGS = lambda x: _LIST.format(x=x, e="coalesce('\"' || y || '\"', 'null')")
_NUMBERS = lambda x: _LIST.format(x=x, e="coalesce(CAST(y AS VARCHAR), 'null')").replace("lambda y:", "lambda z:").replace("(y AS", "(z AS")
_LOOKUP = f"CASE WHEN y IS NULL THEN 'null' ELSE '{{\"accountKey\":' || coalesce('\"' || y.account_key || '\"', 'null') || ',\"readonlyIndexes\":' || {_NUMBERS('y.readonly_indexes')} || ',\"writableIndexes\":' || {_NUMBERS('y.writable_indexes')} || '}}' END"


@_query(
    f"""SELECT block_number, transaction_index, {_STRINGS("account_keys")} AS keys, {_LIST.format(x="address_table_lookups", e=_LOOKUP)} AS lookups,
    CASE WHEN loaded_addresses IS NULL THEN 'null' ELSE '{{"readonly":' || {_STRINGS("loaded_addresses.readonly")} || ',"writable":' || {_STRINGS("loaded_addresses.writable")} || '}}' END AS loaded FROM sol_transactions"""
)
def nested_values(spark: SparkSession, root: str) -> DataFrame:
    """Lists, lists of objects, objects of lists, nulls at every level."""
    df = load(spark, root, "sol_transactions")
    v = exp.Value()
    return df.select("block_number", "transaction_index", _column(df, "account_keys", v).alias("keys"), _column(df, "address_table_lookups", v).alias("lookups"), _column(df, "loaded_addresses", v).alias("loaded"))


_DOUBLES = ("px", "sz", "start_position", "closed_pnl", "fee", "builder_fee")


@_query(f"SELECT block_number, fill_index, {', '.join(f'{_float(c)} AS {c}' for c in _DOUBLES)} FROM fills")
def float_values(spark: SparkSession, root: str) -> DataFrame:
    """The text of every double of the table, large and small ones, not-a-number as null."""
    df = load(spark, root, "fills")
    return df.select("block_number", "fill_index", *[_column(df, c, exp.Value()).alias(c) for c in _DOUBLES])


@_query(f"SELECT block_number, fill_index, {_float('closed_pnl')} AS pnl FROM fills")
def not_a_number_is_null(spark: SparkSession, root: str) -> DataFrame:
    df = load(spark, root, "fills")
    return df.select("block_number", "fill_index", _column(df, "closed_pnl", exp.Value()).alias("pnl"))


# Derived columns, storage and chain checks ----------------------------------------------------------------------


@_query("SELECT block_number, transaction_index, CASE WHEN length(input) >= 10 THEN substr(input, 1, 10) END AS sighash, coalesce(strlen(input), 0) AS input_size FROM evm_transactions")
def derived_columns(spark: SparkSession, root: str) -> DataFrame:
    """What a writer computes of a transaction: the call's signature hash and the size of a payload."""
    df = load(spark, root, "evm_transactions").drop("sighash", "input_size")
    return derive.evm_transactions(df).select("block_number", "transaction_index", "sighash", "input_size")


@_query(
    """WITH t AS (SELECT *, loaded_addresses.readonly AS r, loaded_addresses.writable AS w FROM sol_transactions) SELECT block_number, transaction_index, 44 * coalesce(len(account_keys), 0) AS account_keys_size,
    CAST(coalesce(list_sum(list_transform(signatures, lambda x: coalesce(strlen(x), 0))), 0) AS BIGINT) AS signatures_size, 44 * (coalesce(len(r), 0) + coalesce(len(w), 0)) AS loaded_addresses_size FROM t"""
)
def derived_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Sizes of a transaction's nested lists, computed anew: 44 bytes an account, the bytes of the signatures."""
    df = load(spark, root, "sol_transactions").drop("signatures_size", "loaded_addresses_size")
    return derive.solana_transactions(df).select("block_number", "transaction_index", "account_keys_size", "signatures_size", "loaded_addresses_size")


@_query("SELECT block_number, log_index, topic0, address, CAST(row_number() OVER (ORDER BY topic0 NULLS LAST, address NULLS LAST, block_number, log_index) - 1 AS INTEGER) AS _idx FROM (SELECT DISTINCT block_number, log_index, topic0, address FROM evm_logs)")
def sorted_write_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    """Distinct logs written in sort order with their position, and read back."""
    logs, _ = materialize(load(spark, root, "evm_logs").select("block_number", "log_index", "topic0", "address").distinct())
    path = f"{shared_folder(spark)}/blockloom-{uuid.uuid4().hex}"
    write_table(logs, path, ["topic0", "address", "block_number", "log_index"], index=True)
    return spark.read.parquet(path)


@_query(
    """WITH h AS (SELECT DISTINCT number, lower(trim(hash, ' ')) AS hash, lower(trim(parent_hash, ' ')) AS parent_hash FROM hl_blocks WHERE number IS NOT NULL),
    p AS (SELECT hash, max(number) AS pn FROM h WHERE hash IS NOT NULL GROUP BY 1), k AS (SELECT parent_hash, count(*) AS children FROM h WHERE parent_hash IS NOT NULL GROUP BY 1), m AS (SELECT number, count(*) AS same FROM h GROUP BY 1),
    c AS (SELECT h.*, p.pn, k.children, m.same FROM h JOIN m ON m.number = h.number LEFT JOIN p ON h.parent_hash = p.hash LEFT JOIN k ON h.parent_hash = k.parent_hash)
    SELECT number AS n, hash, parent_hash FROM c WHERE (number > (SELECT min(number) FROM h) AND (pn IS NULL OR pn >= number)) OR (pn IS NOT NULL AND children > 1) OR same > 1"""
)
def continuity_check(spark: SparkSession, root: str) -> DataFrame:
    """Of all distinct headers those that don't link to an earlier one, or share their parent or their number."""
    headers = load(spark, root, "hl_blocks").where("number is not null").select("number", normal("hash").alias("hash"), normal("parent_hash").alias("parent_hash")).distinct()
    return broken_links(headers, "number")


STAR = Catalog([TableDef("orders", ("o_orderkey",), children={"lineitem": ("l_orderkey",)}), TableDef("lineitem", ("l_orderkey", "l_linenumber"))])


@_query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1995-01-01' OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority LIKE '1%' AND o_orderstatus = 'F')")
def star_exists(spark: SparkSession, root: str) -> DataFrame:
    """The same planner over orders and lineitem."""
    orders, items = load(spark, root, "orders"), load(spark, root, "lineitem")
    chosen = orders.where(F.col("o_orderpriority").startswith("1") & (F.col("o_orderstatus") == "F"))
    keys = rel.join(chosen, ["o_orderkey"], ["l_orderkey"])
    p = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    return rel.select_rows(items, p, [(["l_orderkey"], keys)]).select("l_orderkey", "l_linenumber", "l_returnflag")
