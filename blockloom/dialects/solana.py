"""Solana. Names of tables, columns and fields are fixed values of the data model."""

from __future__ import annotations

from blockloom.catalog import Catalog, TableDef
from blockloom.functions.exp import BigNum, HexNum, Json, Roll, Time, Version
from blockloom.plans.request import SUB, UP, Dialect, Item, Request, bloom, equals, fields, hex_number, in_list, prefixes, to

TX = ("block_number", "transaction_index")
INSTRUCTION = (*TX, "instruction_address")
ACCOUNTS = tuple(f"a{i}" for i in range(16))

CATALOG = Catalog(
    [
        TableDef("blocks", ("number",)),
        TableDef("transactions", TX, children={t: TX for t in ("logs", "balances", "token_balances")}, weights={c: f"{c}_size" for c in ("account_keys", "address_table_lookups", "signatures", "loaded_addresses")}),
        TableDef("instructions", INSTRUCTION, weights={"data": "data_size", "a0": "accounts_size", **{c: 0 for c in (*ACCOUNTS[1:], "rest_accounts")}}),
        TableDef("logs", (*TX, "log_index"), weights={"message": "message_size"}),
        TableDef("balances", (*TX, "account")),
        TableDef("token_balances", (*TX, "account")),
        TableDef("rewards", ("block_number", "pubkey", "reward_type")),
    ]
)

SOLANA = Dialect(
    "solana",
    CATALOG,
    {
        "block": Item("blocks", fields("number hash parent_number parent_hash height timestamp", timestamp=Time("s"))),
        "transaction": Item(
            "transactions",
            fields(
                "transaction_index version account_keys address_table_lookups num_readonly_signed_accounts num_readonly_unsigned_accounts "
                "num_required_signatures recent_blockhash signatures err fee compute_units_consumed loaded_addresses fee_payer has_dropped_log_messages",
                version=Version(),
                err=Json(),
                fee=BigNum(),
                compute_units_consumed=BigNum(),
            ),
        ),
        "instruction": Item(
            "instructions",
            fields(
                "transaction_index instruction_address program_id accounts data d1 d2 d4 d8 error compute_units_consumed is_committed has_dropped_log_messages",
                accounts=Roll((*ACCOUNTS, "rest_accounts")),
                d1=HexNum(1),
                d2=HexNum(2),
                d4=HexNum(4),
                d8=HexNum(8),
                compute_units_consumed=BigNum(),
            ),
        ),
        "log": Item("logs", fields("transaction_index log_index instruction_address program_id kind message")),
        "balance": Item("balances", fields("transaction_index account pre post", pre=BigNum(), post=BigNum())),
        "tokenBalance": Item(
            "token_balances",
            fields("transaction_index account pre_mint post_mint pre_decimals post_decimals pre_program_id post_program_id pre_owner post_owner pre_amount post_amount", pre_amount=BigNum(), post_amount=BigNum()),
        ),
        "reward": Item("rewards", fields("pubkey lamports post_balance reward_type commission", lamports=BigNum(), post_balance=BigNum())),
    },
    {
        "transactions": Request(
            "transactions",
            {"feePayer": in_list("fee_payer"), "mentionsAccount": bloom("accounts_bloom")},
            {"instructions": to("instructions"), "logs": to("logs"), "balances": to("balances"), "tokenBalances": to("token_balances")},
        ),
        "instructions": Request(
            "instructions",
            {
                "programId": in_list("program_id"),
                "discriminator": prefixes(),
                **{f"d{n}": hex_number(f"d{n}", n) for n in (1, 2, 4, 8)},
                "mentionsAccount": bloom("accounts_bloom"),
                **{a: in_list(a) for a in ACCOUNTS},
                "isCommitted": equals("is_committed"),
            },
            {
                "transaction": to("transactions"),
                "transactionBalances": to("balances"),
                "transactionTokenBalances": to("token_balances"),
                "transactionInstructions": to("instructions"),
                "innerInstructions": SUB,
                "parentInstructions": UP,
                "logs": to("logs", INSTRUCTION),
            },
            exclusive=("d1", "d2", "d4", "d8", "discriminator"),
        ),
        "logs": Request("logs", {"programId": in_list("program_id"), "kind": in_list("kind")}, {"transaction": to("transactions"), "instruction": to("instructions", INSTRUCTION)}),
        "balances": Request("balances", {"account": in_list("account")}, {"transaction": to("transactions"), "transactionInstructions": to("instructions")}),
        "tokenBalances": Request(
            "token_balances",
            {
                "account": in_list("account"),
                "preMint": in_list("pre_mint"),
                "postMint": in_list("post_mint"),
                "preProgramId": in_list("pre_program_id"),
                "postProgramId": in_list("post_program_id"),
                "preOwner": in_list("pre_owner"),
                "postOwner": in_list("post_owner"),
            },
            {"transaction": to("transactions"), "transactionInstructions": to("instructions"), "transactionBalances": to("balances"), "transactionTokenBalances": to("token_balances")},
        ),
        "rewards": Request("rewards", {"pubkey": in_list("pubkey")}),
    },
)
