"""The filter language: small immutable predicates that compile to Spark columns.

A predicate that is null for a row doesn't select it. Literals outside a column's domain fold to false before Spark
sees them; an empty list makes a whole request match nothing, which the planner handles (``is_never``).
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.bloom import bloom_bits, contains_bits

#: Inclusive bounds of the integer types.
BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


class Predicate:
    def columns(self) -> set[str]:
        raise NotImplementedError

    def on(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def is_never(self) -> bool:
        return False


def _fits(value: object, kind: T.DataType) -> bool:
    """Whether an integer literal can occur in a column of the type at all."""
    if isinstance(value, bool) or not isinstance(value, int):
        return True
    bits = next((b for t, b in BOUNDS.items() if isinstance(kind, t)), None)
    if bits is None:
        return not isinstance(kind, T.DecimalType) or abs(value) < 10**kind.precision
    return -(1 << bits) <= value < 1 << bits


def _literal(value: object, kind: T.DataType) -> Column:
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytearray(value))
    if isinstance(value, int) and abs(value) >= 1 << 63:
        value = str(value)  # beyond a JVM long
    return F.lit(value).cast(kind) if isinstance(kind, (T.NumericType, T.BooleanType)) else F.lit(value)


@dataclass(frozen=True)
class In(Predicate):
    """The column is one of the values; one value is equality, and Spark turns long lists into a hash set."""

    column: str
    values: tuple

    def columns(self) -> set[str]:
        return {self.column}

    def is_never(self) -> bool:
        return not self.values

    def on(self, df: DataFrame) -> Column:
        kind = df.schema[self.column].dataType
        values = [v for v in dict.fromkeys(self.values) if _fits(v, kind)]
        if not values:
            return F.lit(False)
        if len(values) == 1:
            return F.col(self.column) == _literal(values[0], kind)
        return F.col(self.column).isin([_literal(v, kind) for v in values])


def Eq(column: str, value: object) -> In:  # noqa: N802
    return In(column, (value,))


@dataclass(frozen=True)
class Compare(Predicate):
    """low <= column <= high, either side open; integers out of range fold away."""

    column: str
    low: object = None
    high: object = None

    def columns(self) -> set[str]:
        return {self.column}

    def on(self, df: DataFrame) -> Column:
        kind, c = df.schema[self.column].dataType, F.col(self.column)
        bits = next((b for t, b in BOUNDS.items() if isinstance(kind, t)), None)
        conditions = []
        for value, lower in ((self.low, True), (self.high, False)):
            if value is None:
                continue
            if bits is not None and isinstance(value, int) and not _fits(value, kind):
                if (value > 0) == lower:
                    return F.lit(False)
                conditions.append(c.isNotNull())
            else:
                conditions.append(c >= _literal(value, kind) if lower else c <= _literal(value, kind))
        return functools.reduce(operator.and_, conditions) if conditions else F.lit(True)


@dataclass(frozen=True)
class Bloom(Predicate):
    """The row's Bloom filter may contain one of the values: no recheck, false positives are returned."""

    column: str
    values: tuple[str, ...]
    size: int = 64
    hashes: int = 7

    def columns(self) -> set[str]:
        return {self.column}

    def is_never(self) -> bool:
        return not self.values

    def on(self, df: DataFrame) -> Column:
        each = [contains_bits(F.col(self.column), bloom_bits(v, self.size, self.hashes)) for v in self.values]
        return functools.reduce(operator.or_, each) if each else F.lit(False)


@dataclass(frozen=True)
class ContainsAny(Predicate):
    """A list column holds one of the values; a null list doesn't."""

    column: str
    values: tuple

    def columns(self) -> set[str]:
        return {self.column}

    def is_never(self) -> bool:
        return not self.values

    def on(self, df: DataFrame) -> Column:
        kind = df.schema[self.column].dataType.elementType
        values = [v for v in dict.fromkeys(self.values) if _fits(v, kind)]
        if not values:
            return F.lit(False)
        return F.exists(F.col(self.column), lambda x: x.isin([_literal(v, kind) for v in values]))


@dataclass(frozen=True)
class All(Predicate):
    """Conjunction; true without parts."""

    parts: tuple[Predicate, ...]

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def is_never(self) -> bool:
        return any(p.is_never() for p in self.parts)

    def on(self, df: DataFrame) -> Column:
        return functools.reduce(operator.and_, [p.on(df) for p in self.parts]) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Any_(Predicate):
    """Disjunction in SQL's logic: a null part doesn't hide a true one; false without parts."""

    parts: tuple[Predicate, ...]

    def columns(self) -> set[str]:
        return set().union(*(p.columns() for p in self.parts))

    def is_never(self) -> bool:
        return bool(self.parts) and all(p.is_never() for p in self.parts)

    def on(self, df: DataFrame) -> Column:
        return functools.reduce(operator.or_, [p.on(df) for p in self.parts]) if self.parts else F.lit(False)


def parse_hex(text: str, size: int | None = None) -> bytes | None:
    """The bytes of a ``0x`` literal of even length (and of ``size`` bytes), or None."""
    if not isinstance(text, str) or not text.startswith("0x") or len(text) % 2:
        return None
    try:
        raw = bytes.fromhex(text[2:])
    except ValueError:
        return None
    if len(raw) * 2 + 2 != len(text):  # fromhex skips blanks
        return None
    return raw if size is None or len(raw) == size else None


#: Prefix columns that hold unsigned integers; the others hold bytes.
INTEGER_PREFIXES = (1, 2, 4, 8)


def discriminator(values: Sequence[str], longest: int = 16) -> Predicate | None:
    """Data begins with one of the prefixes, by columns d1..d16; None where an empty prefix matches everything."""
    parsed = [raw for raw in map(parse_hex, values) if raw is not None and len(raw) <= longest]
    if any(not raw for raw in parsed):
        return None
    by_size: dict[int, list] = {}
    for raw in parsed:
        by_size.setdefault(len(raw), []).append(int.from_bytes(raw, "big") if len(raw) in INTEGER_PREFIXES else raw)
    if not by_size:
        return In("d1", ())
    return Any_(tuple(In(f"d{n}", tuple(v)) for n, v in sorted(by_size.items())))
