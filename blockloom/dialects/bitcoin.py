"""Bitcoin. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import Time
from blockloom.plans.request import Dialect, Item, Request, equals, fields, in_list, to

TX = ("block_number", "transaction_index")
CATALOG = Catalog([TableDef("blocks", ("number",)), TableDef("transactions", TX, children={"inputs": TX, "outputs": TX}), TableDef("inputs", (*TX, "input_index")), TableDef("outputs", (*TX, "output_index"))])
_OF_PART = {"transaction": to("transactions"), "transactionInputs": to("inputs"), "transactionOutputs": to("outputs")}

BITCOIN = Dialect(
    "bitcoin",
    CATALOG,
    {
        "block": Item("blocks", fields("number hash parent_hash timestamp median_time version merkle_root nonce target bits difficulty chain_work stripped_size size weight", timestamp=Time("s"), median_time=Time("s"))),
        "transaction": Item("transactions", fields("transaction_index hex txid hash size vsize weight version locktime")),
        "input": Item(
            "inputs",
            fields(
                "transaction_index input_index type txid vout script_sig_hex script_sig_asm sequence coinbase tx_in_witness prevout_generated prevout_height prevout_value "
                "prevout_script_pub_key_hex prevout_script_pub_key_asm prevout_script_pub_key_desc prevout_script_pub_key_type prevout_script_pub_key_address"
            ),
        ),
        "output": Item("outputs", fields("transaction_index output_index value script_pub_key_hex script_pub_key_asm script_pub_key_desc script_pub_key_type script_pub_key_address")),
    },
    {
        "transactions": Request("transactions", {}, {"inputs": to("inputs"), "outputs": to("outputs")}),
        "inputs": Request(
            "inputs",
            {
                "type": in_list("type"),
                "prevoutScriptPubKeyAddress": in_list("prevout_script_pub_key_address"),
                "prevoutScriptPubKeyType": in_list("prevout_script_pub_key_type"),
                "prevoutGenerated": equals("prevout_generated"),
            },
            _OF_PART,
        ),
        "outputs": Request("outputs", {"scriptPubKeyAddress": in_list("script_pub_key_address"), "scriptPubKeyType": in_list("script_pub_key_type")}, _OF_PART),
    },
)
