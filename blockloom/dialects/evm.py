"""EVM chains. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import BigNum, ListOf, Members, Prop, Time, Value
from blockloom.plans.request import SUB, UP, Dialect, Field, Item, Request, at_least, at_most, fields, in_list, in_lower, non_zero, placed, to, topics

TX = ("block_number", "transaction_index")

CATALOG = Catalog(
    [
        TableDef("blocks", ("number",), weights={"logs_bloom": 512, "extra_data": "extra_data_size", "withdrawals": "withdrawals_size"}),
        TableDef("transactions", TX, children={"logs": TX, "traces": TX, "statediffs": TX}, weights={"logs_bloom": 512, "input": "input_size", "access_list": "access_list_size"}, aliases={"from": "from_address", "to": "to_address"}),
        TableDef("logs", ("block_number", "log_index"), weights={"data": "data_size"}),
        TableDef("traces", (*TX, "trace_address"), weights={c: f"{c}_size" for c in ("create_init", "create_result_code", "call_input", "call_result_output")}),
        TableDef("statediffs", (*TX, "address", "key"), weights={"prev": "prev_size", "next": "next_size"}, item="stateDiffs"),
    ]
)

AUTHORIZATION = ListOf(Members((("chainId", "chain_id", Value()), ("address", "address", Value()), ("nonce", "nonce", BigNum()), ("yParity", "y_parity", Value()), ("r", "r", Value()), ("s", "s", Value()))))

BLOCK = fields(
    "number hash parent_hash timestamp transactions_root receipts_root state_root logs_bloom sha3_uncles extra_data miner nonce mix_hash size "
    "gas_limit gas_used difficulty total_difficulty base_fee_per_gas uncles withdrawals withdrawals_root blob_gas_used excess_blob_gas "
    "parent_beacon_block_root requests_hash l1_block_number main_block_general_gas_limit shared_gas_limit timestamp_millis_part",
    timestamp=Time("s"),
)
TRANSACTION = fields(
    "transaction_index hash nonce from to input value gas gas_price max_fee_per_gas max_priority_fee_per_gas v r s y_parity access_list chain_id "
    "sighash contract_address gas_used logs_bloom cumulative_gas_used effective_gas_price type status blob_gas_used blob_gas_price "
    "max_fee_per_blob_gas blob_versioned_hashes authorization_list calls nonce_key signature fee_token fee_payer_v fee_payer_r fee_payer_s "
    "valid_before valid_after aa_authorization_list key_authorization l1_fee l1_fee_scalar l1_gas_price l1_gas_used l1_blob_base_fee "
    "l1_blob_base_fee_scalar l1_base_fee_scalar",
    authorization_list=AUTHORIZATION,
)
_CALL_TYPE = (Field("callType", Prop("call_type"), ("action", "type")), Field("callCallType", Prop("call_type"), ("action", "callType")))
TRACE = (
    *fields("transaction_index trace_address type subtraces error revert_reason"),
    *placed("create", "action", "from value gas init"),
    *placed("create_result", "result", "gas_used code address"),
    *placed("call", "action", "from to value gas input sighash"),
    *_CALL_TYPE,
    *placed("call_result", "result", "gas_used output"),
    *placed("suicide", "action", "address refund_address balance"),
    *placed("reward", "action", "author value type"),
)
_named = lambda *starts: tuple(f.name for f in TRACE if f.name.startswith(starts))

EVM = Dialect(
    "evm",
    CATALOG,
    {
        "block": Item("blocks", BLOCK),
        "transaction": Item("transactions", TRANSACTION),
        "log": Item("logs", fields("log_index transaction_index transaction_hash address data topics", topics=topics())),
        "trace": Item("traces", TRACE, "type", (("create", _named("create")), ("call", _named("call")), ("suicide", _named("suicide")), ("reward", _named("reward")))),
        "stateDiff": Item("statediffs", fields("transaction_index address key kind prev next")),
    },
    {
        "transactions": Request(
            "transactions",
            {"from": in_lower("from"), "to": in_lower("to"), "sighash": in_lower("sighash"), "firstNonce": at_least("nonce"), "lastNonce": at_most("nonce")},
            {"logs": to("logs"), "traces": to("traces"), "stateDiffs": to("statediffs")},
        ),
        "logs": Request(
            "logs",
            {n: in_lower(n) for n in ("address", "topic0", "topic1", "topic2", "topic3")},
            {"transaction": to("transactions"), "transactionTraces": to("traces"), "transactionLogs": to("logs"), "transactionStateDiffs": to("statediffs")},
        ),
        "traces": Request(
            "traces",
            {
                "type": in_list("type"),
                "createFrom": in_lower("create_from"),
                "createResultAddress": in_lower("create_result_address"),
                "callFrom": in_lower("call_from"),
                "callTo": in_lower("call_to"),
                "callSighash": in_lower("call_sighash"),
                "callCallType": in_list("call_type"),
                "suicideAddress": in_lower("suicide_address"),
                "suicideRefundAddress": in_lower("suicide_refund_address"),
                "rewardAuthor": in_lower("reward_author"),
                "createValueNonZero": non_zero("create_value"),
                "callValueNonZero": non_zero("call_value"),
                "suicideBalanceNonZero": non_zero("suicide_balance"),
                "rewardValueNonZero": non_zero("reward_value"),
            },
            {"transaction": to("transactions"), "transactionLogs": to("logs"), "transactionTraces": to("traces"), "subtraces": SUB, "parents": UP},
        ),
        "stateDiffs": Request("statediffs", {"address": in_lower("address"), "key": in_list("key"), "kind": in_list("kind")}, {"transaction": to("transactions")}),
    },
)
