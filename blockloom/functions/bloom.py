"""Fixed-size Bloom filters over strings, as stored beside account lists.

A value sets, for each seed from 0, the bit xxh3_64(value bytes + 0xFF, seed) mod the number of bits.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def bloom_bits(value: str, size: int = 64, hashes: int = 7) -> list[int]:
    raw = value.encode() + b"\xff"
    return sorted({xxhash.xxh3_64_intdigest(raw, seed) % (size * 8) for seed in range(hashes)})


def bloom_of(values: Iterable[str | None], size: int = 64, hashes: int = 7) -> bytes:
    out = bytearray(size)
    for v in values:
        if v is not None:
            for bit in bloom_bits(v, size, hashes):
                out[bit >> 3] |= 1 << (bit & 7)
    return bytes(out)


def contains_bits(bloom: Column, bits: list[int]) -> Column:
    """All bits are set; bytes are compared inside the JVM, one test per touched byte."""
    masks: dict[int, int] = {}
    for bit in bits:
        masks[bit >> 3] = masks.get(bit >> 3, 0) | 1 << (bit & 7)
    tests = None
    for at, mask in sorted(masks.items()):
        byte = F.conv(F.hex(F.substring(bloom, at + 1, 1)), 16, 10).cast("int")
        test = byte.bitwiseAND(F.lit(mask)) == mask
        tests = test if tests is None else tests & test
    return tests if tests is not None else F.lit(True)


def bloom_column(values: Column, size: int = 64, hashes: int = 7) -> Column:
    """The filter of a list of strings; null for a null list."""

    @F.arrow_udf("binary")
    def build(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else bloom_of(x, size, hashes) for x in lists.to_pylist()], type=pa.binary())

    return build(values)
