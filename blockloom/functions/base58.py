"""Base58 text to bytes, and the prefix columns made from it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the Base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGITS = {c: i for i, c in enumerate(ALPHABET)}


def decode(text: str) -> bytes | None:
    """The bytes, or None where a character is not of the alphabet."""
    number = 0
    for c in text:
        digit = _DIGITS.get(c)
        if digit is None:
            return None
        number = number * 58 + digit
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")


def encode(raw: bytes) -> str:
    number = int.from_bytes(raw, "big")
    out = ""
    while number:
        number, digit = divmod(number, 58)
        out = ALPHABET[digit] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def decode_column(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else decode(t) for t in texts.to_pylist()], type=pa.binary())

    return run(text)


def encode_column(raw: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else encode(v) for v in values.to_pylist()], type=pa.string())

    return run(raw)


def prefix_columns(raw: Column, longest: int = 16) -> dict[str, Column]:
    """d1..d16 of a binary column: unsigned numbers for 1, 2, 4 and 8 bytes, bytes otherwise; null if too short."""
    out = {}
    for n in range(1, longest + 1):
        head = F.substring(raw, 1, n)
        if n in (1, 2, 4):
            value = F.conv(F.hex(head), 16, 10).cast("int" if n < 4 else "long")
        elif n == 8:
            value = F.conv(F.hex(head), 16, 10).cast("decimal(20,0)")
        else:
            value = head
        out[f"d{n}"] = F.when(F.length(raw) >= n, value)
    return out
