"""The projection language: expressions that render columns as JSON text, entirely inside the JVM.

Every expression compiles to a string column that is never null: a null value is the text ``null``. So objects are
plain concatenations, stored JSON is spliced byte for byte, and keys keep the order of the request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.catalog import camel

NULL = "null"


def _or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(NULL))


def quoted(text: Column) -> Column:
    """A JSON string; control characters without a short form as \\u00 and two hex digits in lower case."""
    array = F.to_json(F.array(text))
    low = array
    for digit in "ABCDEF":  # after an even number of backslashes, so that the text of an escape stays as it is
        low = F.regexp_replace(low, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    exact = F.when(text.rlike(r"[\x0B\x0E\x0F\x1A-\x1F]"), low).otherwise(array)
    return F.when(text.isNotNull(), F.substring(exact, F.lit(2), F.length(exact) - 2))


#: The decimal exponents between which a float is written plainly.
PLAIN = (-5, 9)


def float_text(column: Column) -> Column:
    """A finite float: the shortest digits that give it back, plainly for exponents in ``PLAIN`` and as ``d.de-7`` beyond."""
    text = column.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    mantissa = F.ltrim(F.substring_index(text, "E", 1), F.lit("-"))
    exponent = F.substring_index(text, "E", -1).cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    filled = F.rpad(digits, F.greatest(F.length(digits), exponent + 2), F.lit("0"))
    large = F.concat(F.substring(filled, F.lit(1), exponent + 1), F.lit("."), F.substring(filled, exponent + 2, F.length(filled)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), F.rtrim(digits, F.lit("0")))
    far = F.concat(mantissa, F.lit("e"), exponent.cast("string"))
    moved = F.when(~exponent.between(*PLAIN), far).when(exponent < 0, small).otherwise(large)
    return F.when(text.contains("E"), F.concat(sign, moved)).otherwise(text)


def integer_of_time(column: Column, unit: str, kind: T.DataType) -> Column:
    """Seconds, milli- or microseconds since 1970; times without zone count as UTC, whatever the session's zone."""
    if not isinstance(kind, T.TimestampNTZType):
        return {"s": F.unix_seconds, "ms": F.unix_millis, "us": F.unix_micros}[unit](column)
    seconds = F.unix_date(F.to_date(column)) * F.lit(86_400).cast("long") + F.hour(column) * 3600 + F.minute(column) * 60
    micros = seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return micros if unit == "us" else F.floor(micros / F.lit({"s": 1_000_000, "ms": 1000}[unit]))


def render(column: Column, kind: T.DataType, unit: str = "ms") -> Column:
    """A value of any type as JSON text, null as ``null``."""
    if isinstance(kind, T.StringType):
        return _or_null(quoted(column))
    if isinstance(kind, T.BinaryType):
        return F.when(column.isNotNull(), F.concat(F.lit('"0x'), F.lower(F.hex(column)), F.lit('"'))).otherwise(NULL)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(column) & (F.abs(column) != float("inf"))
        return F.when(finite, float_text(column)).otherwise(NULL)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _or_null(integer_of_time(column, unit, kind).cast("string"))
    if isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda x: render(x, kind.elementType, unit))
        return F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(NULL)
    if isinstance(kind, T.StructType):
        parts = [(camel(f.name), render(column[f.name], f.dataType, unit)) for f in kind.fields]
        return F.when(column.isNotNull(), join_object(parts)).otherwise(NULL)
    return _or_null(column.cast("string"))


def join_object(parts: list[tuple[str, Column]]) -> Column:
    pieces: list[Column] = []
    for i, (name, text) in enumerate(parts):
        pieces += [F.lit(("," if i else "") + f'"{name}":'), text]
    return F.concat(F.lit("{"), *pieces, F.lit("}"))


Lookup = Callable[[str], tuple[Column, T.DataType] | None]
"""A column by name with its type; None for a declared default that the files lack."""


class Exp:
    def text(self, column: Column, kind: T.DataType) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Value(Exp):
    """By type; ``unit`` is that of stored times."""

    unit: str = "ms"

    def text(self, column: Column, kind: T.DataType) -> Column:
        return render(column, kind, self.unit)


@dataclass(frozen=True)
class Json(Exp):
    """Stored JSON, spliced as it is."""

    def text(self, column: Column, kind: T.DataType) -> Column:
        return _or_null(column.cast("string"))


@dataclass(frozen=True)
class BigNum(Exp):
    """A number as a quoted string."""

    def text(self, column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.DecimalType) and kind.scale:
            raise TypeError("only decimals of scale 0 are big numbers")
        return F.when(column.isNotNull(), F.concat(F.lit('"'), column.cast("string"), F.lit('"'))).otherwise(NULL)


@dataclass(frozen=True)
class HexNum(Exp):
    """An unsigned number as fixed-width hex."""

    size: int

    def text(self, column: Column, kind: T.DataType) -> Column:
        digits = F.lpad(F.lower(F.conv(column.cast("string"), 10, 16)), 2 * self.size, "0")
        return F.when(column.isNotNull(), F.concat(F.lit('"0x'), digits, F.lit('"'))).otherwise(NULL)


@dataclass(frozen=True)
class Version(Exp):
    """A transaction version: -1 is ``"legacy"``."""

    def text(self, column: Column, kind: T.DataType) -> Column:
        return F.when(column == -1, '"legacy"').otherwise(_or_null(column.cast("string")))


@dataclass(frozen=True)
class Time(Exp):
    """A time as an integer of the unit."""

    unit: str

    def text(self, column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return _or_null(integer_of_time(column, self.unit, kind).cast("string"))
        return _or_null(column.cast("string"))


@dataclass(frozen=True)
class ListOf(Exp):
    """Each element by an expression."""

    item: Exp

    def text(self, column: Column, kind: T.DataType) -> Column:
        items = F.transform(column, lambda x: self.item.text(x, kind.elementType))
        return F.when(column.isNotNull(), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(NULL)


@dataclass(frozen=True)
class Members(Exp):
    """A struct by (json name, member, expression)."""

    parts: tuple[tuple[str, str, Exp], ...]

    def text(self, column: Column, kind: T.DataType) -> Column:
        texts = [(name, e.text(column[member], kind[member].dataType)) for name, member, e in self.parts]
        return F.when(column.isNotNull(), join_object(texts)).otherwise(NULL)


# Row-level shapes ---------------------------------------------------------------------------------------------


class Shape:
    def columns(self) -> Iterator[str]:
        raise NotImplementedError

    def row(self, find: Lookup) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Prop(Shape):
    column: str
    exp: Exp = field(default_factory=Value)

    def columns(self) -> Iterator[str]:
        yield self.column

    def row(self, find: Lookup) -> Column:
        found = find(self.column)
        return F.lit(NULL) if found is None else self.exp.text(*found)


@dataclass(frozen=True)
class Roll(Shape):
    """Columns as one array that stops at the first null; a list column, last, is spread."""

    names: tuple[str, ...]
    exp: Exp = field(default_factory=Value)

    def columns(self) -> Iterator[str]:
        yield from self.names

    def row(self, find: Lookup) -> Column:
        found = [find(n) for n in self.names]
        found = found[: found.index(None)] if None in found else found
        spread = found.pop() if found and isinstance(found[-1][1], T.ArrayType) else None
        single = F.array(*[F.when(c.isNotNull(), self.exp.text(c, k)) for c, k in found]) if found else F.array().cast("array<string>")
        stop = F.array_position(F.transform(single, lambda x: x.isNull()), True)
        head = F.when(stop > 0, F.slice(single, F.lit(1), (stop - 1).cast("int"))).otherwise(single)
        if spread is not None:
            column, kind = spread
            tail = F.transform(column, lambda x: self.exp.text(x, kind.elementType))
            head = F.when((stop > 0) | column.isNull(), head).otherwise(F.concat(head, tail))
        return F.concat(F.lit("["), F.array_join(head, ","), F.lit("]"))


@dataclass(frozen=True)
class Object(Shape):
    parts: tuple[tuple[str, Shape], ...]

    def columns(self) -> Iterator[str]:
        for _, shape in self.parts:
            yield from shape.columns()

    def row(self, find: Lookup) -> Column:
        return join_object([(name, shape.row(find)) for name, shape in self.parts])


@dataclass(frozen=True)
class Enum(Shape):
    """One of several objects, by a string column; an unknown tag gives null."""

    tag: str
    variants: tuple[tuple[str, Object], ...]

    def columns(self) -> Iterator[str]:
        yield self.tag
        for _, shape in self.variants:
            yield from shape.columns()

    def row(self, find: Lookup) -> Column:
        found = find(self.tag)
        if found is None:
            return F.lit(NULL)
        out = None
        for name, shape in self.variants:
            out = (F if out is None else out).when(found[0] == name, shape.row(find))
        return out.otherwise(NULL)
