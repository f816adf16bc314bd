"""Query documents: what dialects declare, and parsing, validation and compilation of JSON queries by it."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from blockloom.catalog import Catalog, camel
from blockloom.errors import QueryError
from blockloom.functions.exp import Enum, Exp, Object, Prop, Roll, Shape, Value
from blockloom.operators.predicates import All, Bloom, Compare, ContainsAny, In, Predicate, discriminator, parse_hex
from blockloom.plans.plan import CHILDREN, PARENTS, Plan, PlanBuilder, Relation

MAX_REQUESTS = 100
Maker = Callable[[Any], "Predicate | None"]


@dataclass(frozen=True)
class Filter:
    """A request's field: the kind of its JSON value, and the predicate it makes."""

    kind: str
    make: Maker


def _lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def in_list(column: str) -> Filter:
    return Filter("strings", lambda v: In(column, tuple(v)))


def in_lower(column: str) -> Filter:
    return Filter("strings", lambda v: In(column, tuple(_lower(x) for x in v)))


def at_least(column: str) -> Filter:
    return Filter("integer", lambda v: Compare(column, low=v))


def at_most(column: str) -> Filter:
    return Filter("integer", lambda v: Compare(column, high=v))


def non_zero(column: str) -> Filter:
    """Hex strings in minimal form are compared as text."""
    return Filter("boolean", lambda v: Compare(column, low="0x1") if v else None)


def equals(column: str) -> Filter:
    return Filter("boolean", lambda v: In(column, (v,)))


def one_of(column: str, *values: str) -> Filter:
    def make(v: str) -> Predicate:
        if v not in values:
            raise QueryError(f"'{v}' is none of {', '.join(values)}")
        return In(column, (v,))

    return Filter("string", make)


def bloom(column: str) -> Filter:
    def make(v: Sequence[str]) -> Predicate:
        if len(v) > 10:
            raise QueryError(f"lists {len(v)} accounts; ten at most can be looked for")
        return Bloom(column, tuple(v))

    return Filter("strings", make)


def hex_number(column: str, size: int) -> Filter:
    def make(v: Sequence[str]) -> Predicate:
        return In(column, tuple(int.from_bytes(x, "big") for x in (parse_hex(t, size) for t in v) if x is not None))

    return Filter("strings", make)


def prefixes() -> Filter:
    def make(v: Sequence[str]) -> Predicate | None:
        for i, text in enumerate(v):
            if parse_hex(text) is None:
                raise QueryError(f"invalid discriminator [{i}]: not a hex string of even length")
            if len(text) > 34:
                raise QueryError(f"invalid discriminator [{i}]: longer than 16 bytes")
        return discriminator(v)

    return Filter("strings", make)


def contains_text(column: str) -> Filter:
    return Filter("strings", lambda v: ContainsAny(column, tuple(v)))


def contains_number(column: str) -> Filter:
    return Filter("integers", lambda v: ContainsAny(column, tuple(v)))


Link = Callable[[PlanBuilder, str], Relation]


def to(target: str, key: Sequence[str] = ("block_number", "transaction_index"), own: Sequence[str] | None = None) -> Link:
    """Rows of another table with the same key (``own`` where it is called otherwise here)."""
    return lambda b, source: b.join(source, target, key, own or key)


def tree(kind: str) -> Link:
    return lambda b, source: b.tree(kind, source)


def foreign(kind: str, target: str, key: Sequence[str], own: Sequence[str]) -> Link:
    return lambda b, source: b.foreign(kind, source, target, key, own)


SUB, UP = tree(CHILDREN), tree(PARENTS)


@dataclass(frozen=True)
class Request:
    """A list of item requests in a query: its table, filters, relation flags, and conditions that always hold."""

    table: str
    filters: dict[str, Filter] = field(default_factory=dict)
    links: dict[str, tuple[Link, ...] | Link] = field(default_factory=dict)
    always: tuple[Predicate, ...] = ()
    exclusive: tuple[str, ...] = ()


@dataclass(frozen=True)
class Field:
    """A field that can be selected: where it stands in the object, and how it is rendered."""

    name: str
    shape: Shape
    at: tuple[str, ...]


@dataclass(frozen=True)
class Item:
    """The selectable fields of a table. ``variants``: by the value of the tag column, which fields stand where."""

    table: str
    fields: tuple[Field, ...]
    tag: str | None = None
    variants: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def shape(self, wanted: set[str]) -> Shape:
        if self.tag is None:
            return _nest([f for f in self.fields if f.name in wanted])
        if not wanted:
            return Object(())
        shared = {f.name for f in self.fields} - {n for _, names in self.variants for n in names}
        return Enum(self.tag, tuple((value, _nest([f for f in self.fields if f.name in wanted and (f.name in shared or f.name in names)])) for value, names in self.variants))


def _nest(fields: Sequence[Field]) -> Object:
    top: dict[str, Any] = {}
    for f in fields:
        where = top
        for step in f.at[:-1]:
            where = where.setdefault(step, {})
        where[f.at[-1]] = f.shape
    build = lambda d: Object(tuple((k, build(v) if isinstance(v, dict) else v) for k, v in d.items()))
    return build(top)


def fields(names: str, **special: Exp | Shape) -> tuple[Field, ...]:
    """Fields that are called and stored by the names given; ``special`` says how some are rendered."""
    out = []
    for name in names.split():
        shape = special.get(name, Value())
        out.append(Field(camel(name), shape if isinstance(shape, Shape) else Prop(name, shape), (camel(name),)))
    return tuple(out)


def placed(prefix: str, path: str, names: str, **special: Exp) -> tuple[Field, ...]:
    """Fields ``prefix_name`` that stand at ``path.name`` (path may be empty)."""
    steps = tuple(path.split(".")) if path else ()
    return tuple(Field(camel(f"{prefix}_{n}"), Prop(f"{prefix}_{n}", special.get(n, Value())), (*steps, camel(n))) for n in names.split())


def topics() -> Roll:
    return Roll(("topic0", "topic1", "topic2", "topic3"))


@dataclass(frozen=True)
class Dialect:
    """A kind of chain: its tables, selectable fields, and the lists of requests a query may hold."""

    name: str
    catalog: Catalog
    items: dict[str, Item]
    requests: dict[str, Request]


def _no_repeats(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in pairs:
        if k in out:
            raise QueryError(f"repeated property '{k}'")
        out[k] = v
    return out


def _integer(value: Any, where: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise QueryError(f"'{where}' must be a non-negative integer")
    return value


_KINDS: dict[str, Callable[[Any], bool]] = {
    "strings": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
    "integers": lambda v: isinstance(v, list) and all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in v),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= 0,
    "boolean": lambda v: isinstance(v, bool),
    "string": lambda v: isinstance(v, str),
}


@dataclass(frozen=True)
class Query:
    """A parsed and validated query."""

    dialect: Dialect
    body: dict[str, Any]

    @property
    def first_block(self) -> int:
        return self.body.get("fromBlock", 0)

    @property
    def last_block(self) -> int | None:
        return self.body.get("toBlock")

    def compile(self) -> Plan:
        d = self.dialect
        builder = PlanBuilder(d.catalog)
        chosen = self.body.get("fields", {})
        for key, item in d.items.items():
            builder.show(item.table, item.shape({n for n, on in chosen.get(key, {}).items() if on}))
        for name, request in d.requests.items():
            for one in self.body.get(name, []):
                made = [f.make(one[k]) for k, f in request.filters.items() if one.get(k) is not None]
                parts = (*request.always, *(p for p in made if p is not None))
                links = [link for k, v in request.links.items() if one.get(k) for link in (v if isinstance(v, tuple) else (v,))]
                builder.request(request.table, All(parts) if parts else None, [link(builder, request.table) for link in links])
        return builder.build(self.first_block, self.last_block, self.body.get("parentBlockHash"), self.body.get("includeAllBlocks", False))


def validate(dialect: Dialect, body: dict[str, Any]) -> Query:
    common = {"type", "fromBlock", "toBlock", "parentBlockHash", "fields", "includeAllBlocks"}
    for k in body:
        if k not in common and k not in dialect.requests:
            raise QueryError(f"unknown field '{k}'")
    first = _integer(body.get("fromBlock", 0), "fromBlock")
    if body.get("toBlock") is not None and _integer(body["toBlock"], "toBlock") < first:
        raise QueryError("the range is empty: 'toBlock' lies below 'fromBlock'")
    if not isinstance(body.get("includeAllBlocks", False), bool):
        raise QueryError("'includeAllBlocks' must be a boolean")
    if not isinstance(body.get("parentBlockHash"), (str, type(None))):
        raise QueryError("'parentBlockHash' must be a string")
    chosen = body.get("fields", {})
    if not isinstance(chosen, dict):
        raise QueryError("'fields' must be an object")
    for item, names in chosen.items():
        if item not in dialect.items:
            raise QueryError(f"unknown field 'fields.{item}'")
        if not isinstance(names, dict):
            raise QueryError(f"'fields.{item}' must be an object")
        known = {f.name for f in dialect.items[item].fields}
        for n, on in names.items():
            if n not in known:
                raise QueryError(f"unknown field 'fields.{item}.{n}'")
            if not isinstance(on, bool):
                raise QueryError(f"'fields.{item}.{n}' must be a boolean")
    count = 0
    for name, request in dialect.requests.items():
        listed = body.get(name, [])
        if not isinstance(listed, list) or not all(isinstance(x, dict) for x in listed):
            raise QueryError(f"'{name}' must be a list of objects")
        count += len(listed)
        for i, one in enumerate(listed):
            for k, v in one.items():
                if k in request.filters:
                    if v is not None and not _KINDS[request.filters[k].kind](v):
                        raise QueryError(f"'{name}[{i}].{k}' must be of kind {request.filters[k].kind}")
                    if v is not None:
                        try:
                            request.filters[k].make(v)
                        except QueryError as e:
                            raise QueryError(f"'.{name}[{i}].{k}' {e}") from None
                elif k in request.links:
                    if not isinstance(v, bool):
                        raise QueryError(f"'{name}[{i}].{k}' must be a boolean")
                else:
                    raise QueryError(f"unknown field '{name}[{i}].{k}'")
            both = [k for k in request.exclusive if one.get(k) is not None]
            if len(both) > 1:
                raise QueryError(f"'{name}[{i}]' asks for both '{both[0]}' and '{both[1]}', which are alternatives")
    if count > MAX_REQUESTS:
        raise QueryError(f"{count} requests for items in one query; the limit is {MAX_REQUESTS}")
    return Query(dialect, body)


def parse(text: str | bytes | dict[str, Any]) -> Query:
    """A JSON query document of any dialect."""
    from blockloom.dialects import DIALECTS

    if isinstance(text, dict):
        body = text
    else:
        try:
            body = json.loads(text, object_pairs_hook=_no_repeats)
        except ValueError as e:
            raise e if isinstance(e, QueryError) else QueryError(f"not JSON: {e}") from None
    if not isinstance(body, dict):
        raise QueryError("a query is an object")
    if body.get("type") not in DIALECTS:
        raise QueryError(f"unknown query type '{body.get('type')}'")
    return validate(DIALECTS[body["type"]], body)
