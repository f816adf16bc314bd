"""Fuel. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import BigNum, Json
from blockloom.plans.request import Dialect, Item, Request, fields, in_list, placed, to

TX = ("block_number", "index")
ITS_TX = ("block_number", "transaction_index")
PART = (*ITS_TX, "index")

CATALOG = Catalog(
    [
        TableDef("blocks", ("number",)),
        TableDef("transactions", TX, weights={c: f"{c}_size" for c in ("input_asset_ids", "input_contracts", "witnesses", "storage_slots", "proof_set", "script_data", "raw_payload")}),
        TableDef("receipts", PART, weights={"data": "data_size"}),
        TableDef("inputs", PART, weights={"coin_predicate": "coin_predicate_size", "message_predicate": "message_predicate_size"}),
        TableDef("outputs", PART),
    ]
)
INPUT = (
    *fields("transaction_index index type"),
    *placed("coin", "", "utxo_id owner amount asset_id tx_pointer witness_index predicate_gas_used predicate predicate_data", amount=BigNum(), predicate_gas_used=BigNum()),
    *placed("contract", "", "utxo_id balance_root state_root tx_pointer contract_id"),
    *placed("message", "", "sender recipient amount nonce witness_index predicate_gas_used data predicate predicate_data", amount=BigNum(), predicate_gas_used=BigNum()),
)
OUTPUT = (
    *fields("transaction_index index type"),
    *placed("coin", "", "to amount asset_id"),
    *placed("contract", "", "input_index balance_root state_root"),
    *placed("change", "", "to amount asset_id"),
    *placed("variable", "", "to amount asset_id"),
    *placed("contract_created", "", "contract state_root"),
)


def _named(of: tuple, start: str, but: str = "-") -> tuple[str, ...]:
    return tuple(f.name for f in of if f.name.startswith(start) and not f.name.startswith(but))


_RECEIPT_NUMBERS = "pc is amount gas param1 param2 val ptr reason ra rb rc rd len result gas_used"
_POLICY_NUMBERS = "policies_tip policies_witness_limit policies_max_fee script_gas_limit mint_amount mint_gas_price"

FUEL = Dialect(
    "fuel",
    CATALOG,
    {
        "block": Item(
            "blocks",
            fields(
                "number hash transactions_root transactions_count message_receipt_count prev_root application_hash event_inbox_root consensus_parameters_version "
                "state_transition_bytecode_version message_outbox_root da_height time",
                da_height=BigNum(),
                time=BigNum(),
            ),
        ),
        "transaction": Item(
            "transactions",
            fields(
                "index hash type input_asset_ids input_contracts input_contract_utxo_id input_contract_balance_root input_contract_state_root input_contract_tx_pointer "
                "input_contract_contract_id output_contract_input_index output_contract_balance_root output_contract_state_root maturity mint_asset_id tx_pointer is_script "
                "is_create is_mint is_upgrade is_upload witnesses receipts_root script script_data bytecode_witness_index bytecode_root salt storage_slots raw_payload "
                "subsection_index subsections_number proof_set policies_maturity policies_tip policies_witness_limit policies_max_fee script_gas_limit mint_amount "
                "mint_gas_price status upgrade_purpose",
                status=Json(),
                upgrade_purpose=Json(),
                **{n: BigNum() for n in _POLICY_NUMBERS.split()},
            ),
        ),
        "receipt": Item(
            "receipts",
            fields(
                "index transaction_index contract to to_address asset_id digest receipt_type data sender recipient nonce contract_id sub_id pc is amount gas param1 param2 "
                "val ptr reason ra rb rc rd len result gas_used",
                **{n: BigNum() for n in _RECEIPT_NUMBERS.split()},
            ),
        ),
        "input": Item("inputs", INPUT, "type", (("InputCoin", _named(INPUT, "coin")), ("InputContract", _named(INPUT, "contract")), ("InputMessage", _named(INPUT, "message")))),
        "output": Item(
            "outputs",
            OUTPUT,
            "type",
            (
                ("CoinOutput", _named(OUTPUT, "coin")),
                ("ContractOutput", _named(OUTPUT, "contract", "contractCreated")),
                ("ChangeOutput", _named(OUTPUT, "change")),
                ("VariableOutput", _named(OUTPUT, "variable")),
                ("ContractCreated", _named(OUTPUT, "contractCreated")),
            ),
        ),
    },
    {
        "receipts": Request("receipts", {"type": in_list("receipt_type"), "contract": in_list("contract")}, {"transaction": to("transactions", TX, ITS_TX)}),
        "transactions": Request("transactions", {"type": in_list("type")}, {"receipts": to("receipts", ITS_TX, TX), "inputs": to("inputs", ITS_TX, TX), "outputs": to("outputs", ITS_TX, TX)}),
        "inputs": Request(
            "inputs",
            {
                "type": in_list("type"),
                "coinOwner": in_list("coin_owner"),
                "coinAssetId": in_list("coin_asset_id"),
                "contractContract": in_list("contract_contract"),
                "messageSender": in_list("message_sender"),
                "messageRecipient": in_list("message_recipient"),
            },
            {"transaction": to("transactions", TX, ITS_TX)},
        ),
        "outputs": Request("outputs", {"type": in_list("type")}, {"transaction": to("transactions", TX, ITS_TX)}),
    },
)
