"""Tron. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import BigNum, Json, Time
from blockloom.operators.predicates import Eq
from blockloom.plans.request import Dialect, Filter, Item, Request, fields, in_list, in_lower, to, topics

TX = ("block_number", "transaction_index")
CATALOG = Catalog(
    [
        TableDef("blocks", ("number",)),
        TableDef("transactions", TX, children={"logs": TX, "internal_transactions": TX}, weights={"raw_data_hex": "raw_data_hex_size"}),
        TableDef("logs", (*TX, "log_index"), weights={"data": "data_size"}),
        TableDef("internal_transactions", (*TX, "internal_transaction_index"), item="internalTransactions"),
    ]
)
_OF_TX = {"logs": to("logs"), "internalTransactions": to("internal_transactions")}
_BIG = "fee_limit fee withdraw_amount unfreeze_amount withdraw_expire_amount energy_fee energy_usage energy_usage_total net_usage net_fee origin_energy_usage energy_penalty_total"


def _typed(contract: str, filters: dict[str, Filter]) -> Request:
    return Request("transactions", filters, _OF_TX, (Eq("type", contract),))


TRON = Dialect(
    "tron",
    CATALOG,
    {
        "block": Item("blocks", fields("number hash parent_hash tx_trie_root version witness_address witness_signature timestamp", timestamp=Time("ms"))),
        "transaction": Item(
            "transactions",
            fields(
                "transaction_index hash signature type permission_id ref_block_bytes ref_block_hash raw_data_hex contract_result contract_address res_message result "
                "ret parameter fee_limit expiration timestamp fee withdraw_amount unfreeze_amount withdraw_expire_amount cancel_unfreeze_v2_amount energy_fee energy_usage "
                "energy_usage_total net_usage net_fee origin_energy_usage energy_penalty_total",
                ret=Json(),
                parameter=Json(),
                cancel_unfreeze_v2_amount=Json(),
                expiration=Time("ms"),
                timestamp=Time("ms"),
                **{n: BigNum() for n in _BIG.split()},
            ),
        ),
        "log": Item("logs", fields("transaction_index log_index address data topics", topics=topics())),
        "internalTransaction": Item("internal_transactions", fields("transaction_index internal_transaction_index hash caller_address transfer_to_address note rejected extra call_value_info", call_value_info=Json())),
    },
    {
        "transactions": Request("transactions", {"type": in_list("type")}, _OF_TX),
        "transferTransactions": _typed("TransferContract", {"owner": in_lower("_transfer_contract_owner"), "to": in_lower("_transfer_contract_to")}),
        "transferAssetTransactions": _typed(
            "TransferAssetContract", {"owner": in_lower("_transfer_asset_contract_owner"), "to": in_lower("_transfer_asset_contract_to"), "asset": in_list("_transfer_asset_contract_asset")}
        ),
        "triggerSmartContractTransactions": _typed(
            "TriggerSmartContract",
            {"owner": in_lower("_trigger_smart_contract_owner"), "contract": in_lower("_trigger_smart_contract_contract"), "sighash": in_lower("_trigger_smart_contract_sighash")},
        ),
        "logs": Request("logs", {n: in_lower(n) for n in ("address", "topic0", "topic1", "topic2", "topic3")}, {"transaction": to("transactions")}),
        "internalTransactions": Request("internal_transactions", {"caller": in_lower("caller_address"), "transferTo": in_lower("transfer_to_address")}, {"transaction": to("transactions")}),
    },
)
