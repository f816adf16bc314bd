"""Substrate chains. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import BigNum, Json, Time
from blockloom.operators.predicates import Eq
from blockloom.plans.plan import FOREIGN_CHILDREN, FOREIGN_PARENTS
from blockloom.plans.request import SUB, UP, Dialect, Filter, Item, Request, fields, foreign, in_list, in_lower, to

CALL = ("block_number", "extrinsic_index", "address")
ITS_CALL = ("block_number", "extrinsic_index", "call_address")
EXTRINSIC = ("block_number", "index")
ITS_EXTRINSIC = ("block_number", "extrinsic_index")

CATALOG = Catalog(
    [
        TableDef("blocks", ("number",), weights={"digest": 128}),
        TableDef("events", ("block_number", "index"), weights={"args": "args_size"}),
        TableDef("calls", CALL, weights={"args": "args_size"}),
        TableDef("extrinsics", EXTRINSIC, children={"calls": ITS_EXTRINSIC}, weights={"signature": 128}),
    ]
)
_OF_EVENT = {"extrinsic": to("extrinsics", EXTRINSIC, ITS_EXTRINSIC), "call": to("calls", CALL, ITS_CALL), "stack": foreign(FOREIGN_PARENTS, "calls", CALL, ITS_CALL)}
_OF_CALL = {"extrinsic": to("extrinsics", EXTRINSIC, ITS_EXTRINSIC), "stack": UP, "events": foreign(FOREIGN_CHILDREN, "events", ITS_CALL, CALL)}


def _events(name: str, filters: dict[str, Filter]) -> Request:
    return Request("events", filters, _OF_EVENT, (Eq("name", name),))


SUBSTRATE = Dialect(
    "substrate",
    CATALOG,
    {
        "block": Item("blocks", fields("number hash parent_hash state_root extrinsics_root digest spec_name spec_version impl_name impl_version validator timestamp", digest=Json(), timestamp=Time("ms"))),
        "extrinsic": Item("extrinsics", fields("index version success hash fee tip signature error", fee=BigNum(), tip=BigNum(), signature=Json(), error=Json())),
        "call": Item("calls", fields("extrinsic_index address name success args origin error", args=Json(), origin=Json(), error=Json())),
        "event": Item("events", fields("index extrinsic_index call_address name phase topics args", args=Json())),
    },
    {
        "calls": Request("calls", {"name": in_list("name")}, {"subcalls": SUB, **_OF_CALL}),
        "events": Request("events", {"name": in_list("name")}, _OF_EVENT),
        "evmLogs": _events("EVM.Log", {"address": in_lower("_evm_log_address"), **{f"topic{i}": in_lower(f"_evm_log_topic{i}") for i in range(4)}}),
        "ethereumTransactions": Request("calls", {"to": in_lower("_ethereum_transact_to"), "sighash": in_lower("_ethereum_transact_sighash")}, _OF_CALL, (Eq("name", "Ethereum.transact"),)),
        "contractsEvents": _events("Contracts.ContractEmitted", {"contractAddress": in_list("_contract_address")}),
        "gearMessagesEnqueued": _events("Gear.UserMessageEnqueued", {"programId": in_list("_gear_program_id")}),
        "gearUserMessagesSent": _events("Gear.UserMessageSent", {"programId": in_list("_gear_program_id")}),
        "reviveContractEmitted": _events("Revive.ContractEmitted", {"contract": in_list("_revive_contract"), **{f"topic{i}": in_list(f"_revive_topic{i}") for i in range(4)}}),
    },
)
