"""Columns that a writer computes: payload sizes, signature hashes, positional accounts, prefixes, filters, and the
assets and client ids that an action names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions import base58, bloom

#: Fixed value: bytes that an account counts in a row's weight.
ACCOUNT_SIZE = 44


def size_of(column: str) -> Column:
    """The bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")


def sighash(payload: str) -> Column:
    """The first ten characters of a call's input; null where it is shorter."""
    return F.when(F.length(payload) >= 10, F.substring(payload, 1, 10))


def evm_transactions(df: DataFrame) -> DataFrame:
    return df.withColumns({"sighash": sighash("input"), "input_size": size_of("input")})


def sizes(df: DataFrame, *columns: str) -> DataFrame:
    """``<column>_size`` for each of the text columns."""
    return df.withColumns({f"{c}_size": size_of(c) for c in columns})


def solana_instructions(df: DataFrame) -> DataFrame:
    """From ``accounts`` and Base58 ``data``: a0..a15, rest_accounts, sizes, d1..d16, accounts_bloom."""
    a = F.col("accounts")
    columns = {f"a{i}": F.get(a, F.lit(i)) for i in range(16)}
    columns["rest_accounts"] = F.when(F.size(a) >= 16, F.slice(a, 17, F.greatest(F.size(a) - 16, F.lit(0))))
    columns["accounts_size"] = (F.coalesce(F.size(a), F.lit(0)) * ACCOUNT_SIZE).cast("long")
    columns["data_size"] = size_of("data")
    columns["accounts_bloom"] = bloom.bloom_column(F.coalesce(a, F.array().cast("array<string>")))
    raw = df.withColumns(columns).withColumn("_raw", base58.decode_column(F.col("data")))
    return raw.withColumns(base58.prefix_columns(F.col("_raw"))).drop("_raw", "accounts")


def solana_transactions(df: DataFrame) -> DataFrame:
    """Sizes of the nested account lists, the bytes of the signatures, and the filter over all accounts of the transaction."""
    empty = F.array().cast("array<string>")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    loaded = F.concat(F.coalesce("loaded_addresses.readonly", empty), F.coalesce("loaded_addresses.writable", empty))
    signatures = F.aggregate(F.coalesce("signatures", empty), F.lit(0).cast("long"), lambda n, s: n + F.coalesce(F.octet_length(s), F.lit(0)))
    return df.withColumns(
        {
            "account_keys_size": (count("account_keys") * ACCOUNT_SIZE).cast("long"),
            "signatures_size": signatures,
            "loaded_addresses_size": (F.size(loaded) * ACCOUNT_SIZE).cast("long"),
            "accounts_bloom": bloom.bloom_column(F.concat(F.coalesce("account_keys", empty), loaded)),
        }
    )


def _named(items: Column, kind: str, action: str) -> Column:
    """The distinct values in order, null unless the action is of the kind."""
    known = F.array_distinct(F.filter(F.coalesce(items, F.array().cast(items_type(action))), lambda x: x.isNotNull()))
    return F.when(F.get_json_object("action", "$.type") == kind, known)


def items_type(what: str) -> str:
    return "array<bigint>" if what == "asset" else "array<string>"


def replica_actions(df: DataFrame) -> DataFrame:
    """From the JSON of ``action``: type, the assets and client ids of orders, cancels and modifies, and sizes."""
    order = "struct<a:bigint,c:string>"
    parsed = F.from_json("action", f"type string, orders array<{order}>, cancels array<struct<a:bigint,asset:bigint,cloid:string>>, modifies array<struct<order:{order}>>")
    pick = lambda path: F.col(f"_a.{path}")
    columns = {
        "action_type": pick("type"),
        "order_asset": _named(pick("orders.a"), "order", "asset"),
        "order_cloid": _named(pick("orders.c"), "order", "cloid"),
        "cancel_asset": _named(pick("cancels.a"), "cancel", "asset"),
        "cancel_by_cloid_asset": _named(pick("cancels.asset"), "cancelByCloid", "asset"),
        "cancel_by_cloid_cloid": _named(pick("cancels.cloid"), "cancelByCloid", "cloid"),
        "batch_modify_asset": _named(pick("modifies.order.a"), "batchModify", "asset"),
        "batch_modify_cloid": _named(pick("modifies.order.c"), "batchModify", "cloid"),
        "action_size": size_of("action"),
        "response_size": size_of("response"),
    }
    return df.withColumn("_a", parsed).withColumns(columns).drop("_a")
