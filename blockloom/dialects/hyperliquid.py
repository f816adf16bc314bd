"""Fills and replica commands of Hyperliquid. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import Json, Time
from blockloom.plans.request import Dialect, Item, Request, contains_number, contains_text, fields, in_list, one_of

FILLS = Dialect(
    "hyperliquidFills",
    Catalog([TableDef("blocks", ("number",)), TableDef("fills", ("block_number", "fill_index"))]),
    {
        "block": Item("blocks", fields("number hash parent_hash timestamp", timestamp=Time("ms"))),
        "fill": Item(
            "fills",
            fields("fill_index user coin px sz side time start_position dir closed_pnl hash oid crossed fee builder_fee tid cloid fee_token builder twap_id", time=Time("ms")),
        ),
    },
    {"fills": Request("fills", {"user": in_list("user"), "coin": in_list("coin"), "dir": in_list("dir"), "cloid": in_list("cloid"), "feeToken": in_list("fee_token"), "builder": in_list("builder")})},
)

_SENDER = {"user": in_list("user"), "vaultAddress": in_list("vault_address"), "status": one_of("status", "ok", "err")}


def _holding(kind: str) -> Request:
    """Actions of one kind by the assets and client ids they name; the kind itself is no condition."""
    filters = {"containsAsset": contains_number(f"{kind}_asset"), **({} if kind == "cancel" else {"containsCloid": contains_text(f"{kind}_cloid")})}
    return Request("actions", {**filters, **_SENDER})


REPLICA_COMMANDS = Dialect(
    "hyperliquidReplicaCmds",
    Catalog([TableDef("blocks", ("number",)), TableDef("actions", ("block_number", "action_index"), weights={"action": "action_size", "response": "response_size"})]),
    {
        "block": Item("blocks", fields("number hash parent_hash round parent_round proposer timestamp hardfork", timestamp=Time("ms"), hardfork=Json())),
        "action": Item("actions", fields("action_index user action signature nonce vault_address status response", action=Json(), signature=Json(), response=Json())),
    },
    {
        "actions": Request("actions", {"actionType": in_list("action_type"), **_SENDER}),
        "orderActions": _holding("order"),
        "cancelActions": _holding("cancel"),
        "cancelByCloidActions": _holding("cancel_by_cloid"),
        "batchModifyActions": _holding("batch_modify"),
    },
)
