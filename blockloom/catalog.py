"""Tables of a dataset kind: keys, links, row weights, item names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

DEFAULT_WEIGHT = 32


def camel(name: str) -> str:
    """snake_case to camelCase; digits stay with their word."""
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def snake(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


@dataclass(frozen=True)
class TableDef:
    """A table: its key (block number first), complete child links, weights and defaults.

    ``weights`` gives a column's weight as a number, or the name of the column that stores it. ``children`` are tables
    whose every row has a parent here, by the columns named. ``defaults`` are columns that read as null, with the type given,
    where a file lacks them.
    """

    name: str
    key: tuple[str, ...]
    children: dict[str, tuple[str, ...]] = field(default_factory=dict)
    weights: dict[str, int | str] = field(default_factory=dict)
    item: str | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    @property
    def block(self) -> str:
        return self.key[0]

    @property
    def item_name(self) -> str:
        return self.item or camel(self.name)

    def weight(self, columns: Sequence[str]) -> tuple[int, list[str]]:
        """The fixed part and the stored columns of the weight of a row with these columns."""
        chosen = [self.weights.get(c, DEFAULT_WEIGHT) for c in dict.fromkeys([*self.key, *columns])]
        return sum(w for w in chosen if isinstance(w, int)), [w for w in chosen if isinstance(w, str)]


class Catalog:
    """The header table first; every other key begins with the block number."""

    def __init__(self, tables: Sequence[TableDef]) -> None:
        if not tables or len(tables[0].key) != 1:
            raise ValueError("the first table must be the header, with a key of one column")
        self.tables = {t.name: t for t in tables}
        if len(self.tables) != len(tables):
            raise ValueError("table names must differ")
        for t in tables[1:]:
            if len(t.key) < 2:
                raise ValueError(f"the key of '{t.name}' must be the block number and more")
        for t in tables:
            for child, key in t.children.items():
                if child not in self.tables or len(key) != len(t.key):
                    raise ValueError(f"'{t.name}' links to '{child}' by a key that doesn't fit")

    @property
    def header(self) -> TableDef:
        return next(iter(self.tables.values()))

    def __getitem__(self, name: str) -> TableDef:
        return self.tables[name]

    def __iter__(self):
        return iter(self.tables.values())
