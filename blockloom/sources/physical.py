"""How tables are laid out on disk: filter columns first in the sort key, the block number after, so that file and
row-group statistics prune by filters. The keys are fixed values of the data model."""

from __future__ import annotations

TX = ("block_number", "transaction_index")

SORT_KEYS: dict[str, dict[str, tuple[str, ...]]] = {
    "evm": {
        "blocks": ("number",),
        "transactions": ("sighash", "to", *TX),
        "logs": ("topic0", "address", "block_number", "log_index"),
        "traces": ("type", "create_from", "call_sighash", "call_to", *TX, "trace_address"),
        "statediffs": ("address", *TX),
    },
    "solana": {
        "blocks": ("number",),
        "transactions": ("fee_payer", *TX),
        "instructions": ("program_id", "d1", *TX),
        "logs": ("program_id", *TX, "log_index"),
        "balances": ("account", *TX),
        "token_balances": ("post_program_id", "post_mint", "account", *TX),
        "rewards": ("pubkey", "block_number"),
    },
    "bitcoin": {
        "blocks": ("number",),
        "transactions": TX,
        "inputs": ("prevout_script_pub_key_address", *TX, "input_index"),
        "outputs": ("script_pub_key_address", *TX, "output_index"),
    },
    "tron": {
        "blocks": ("number",),
        "transactions": (
            "type",
            "_trigger_smart_contract_sighash",
            "_trigger_smart_contract_contract",
            "_trigger_smart_contract_owner",
            "_transfer_contract_owner",
            "_transfer_contract_to",
            "_transfer_asset_contract_owner",
            "_transfer_asset_contract_to",
            "_transfer_asset_contract_asset",
            *TX,
        ),
        "logs": ("topic0", "address", *TX, "log_index"),
        "internal_transactions": ("transfer_to_address", "caller_address", *TX, "internal_transaction_index"),
    },
    "hyperliquidFills": {"blocks": ("number",), "fills": ("user", "coin", "block_number", "fill_index")},
    "hyperliquidReplicaCmds": {"blocks": ("number",), "actions": ("action_type", "user", "vault_address", "block_number", "action_index")},
}


def sort_keys(kind: str, tables: dict[str, list[str]]) -> dict[str, list[str]]:
    """The sort key of each table, as far as its columns (given by table) have it; keys of unknown kinds are empty."""
    known = SORT_KEYS.get(kind, {})
    return {name: [c for c in known.get(name, ()) if c in columns] for name, columns in tables.items()}
