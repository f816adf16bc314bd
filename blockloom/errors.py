"""Errors of queries and of the chunk store."""

from __future__ import annotations


class QueryError(ValueError):
    """The query document is malformed or breaks a rule."""


class TableMissing(LookupError):
    def __init__(self, table: str) -> None:
        super().__init__(f"table '{table}' does not exist")
        self.table = table


class ColumnMissing(LookupError):
    def __init__(self, table: str, column: str) -> None:
        super().__init__(f"column '{column}' is not found in '{table}'")
        self.table, self.column = table, column


class ItemUnavailable(LookupError):
    """A chunk of the asked range doesn't carry the table."""

    def __init__(self, table: str, first_block: int) -> None:
        super().__init__(f"'{table}' is not available from block {first_block}")
        self.table, self.first_block = table, first_block


class UnexpectedBaseBlock(RuntimeError):
    """The block before the range has another hash than the query asserts."""

    def __init__(self, expected: str, previous: list[tuple[int, str]]) -> None:
        super().__init__(f"expected base block hash {expected}, but the chain has {previous[-1] if previous else None}")
        self.expected, self.previous = expected, previous


class RangeUnavailable(LookupError):
    """The store doesn't hold the first block of the range."""


class StoreConflict(RuntimeError):
    """A change doesn't fit the committed chain, or another writer came first."""
