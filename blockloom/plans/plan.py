"""Logical plans: scans feed outputs and relations, relations feed outputs.

``simplify`` works on facts Catalyst doesn't have: a table that some request takes whole needs no other condition;
where all rows of a parent table ask for a child table it links to completely, that is whole too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from blockloom.catalog import Catalog
from blockloom.functions.exp import Object, Shape
from blockloom.operators.predicates import Predicate

JOIN, CHILDREN, PARENTS, FOREIGN_CHILDREN, FOREIGN_PARENTS = "join", "children", "parents", "foreign_children", "foreign_parents"


@dataclass(frozen=True)
class Relation:
    kind: str
    source: str
    source_key: tuple[str, ...]
    target: str
    target_key: tuple[str, ...]

    def passes_all(self, catalog: Catalog) -> bool:
        """Whether a whole source makes a whole target."""
        if self.kind == JOIN:
            parent = catalog[self.source]
            return self.source_key == parent.key and parent.children.get(self.target) == self.target_key
        return self.kind in (CHILDREN, PARENTS)


@dataclass(frozen=True)
class Scan:
    """Rows of a table: all of them without a predicate. ``shown``: they belong to the output."""

    table: str
    predicate: Predicate | None = None
    relations: tuple[Relation, ...] = ()
    shown: bool = True


@dataclass(frozen=True)
class Output:
    """What is rendered of a table's rows: a shape, and the columns it needs beyond the key."""

    table: str
    shape: Shape

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(self.shape.columns()))


@dataclass(frozen=True)
class Plan:
    catalog: Catalog
    scans: tuple[Scan, ...]
    outputs: dict[str, Output]
    first_block: int = 0
    last_block: int | None = None
    parent_hash: str | None = None
    all_blocks: bool = False

    def relations_into(self, table: str) -> list[tuple[Relation, list[Scan]]]:
        """Relations that select rows of the table, with the scans that feed them; equal ones are one."""
        found: dict[Relation, list[Scan]] = {}
        for scan in self.scans:
            for rel in scan.relations:
                if rel.target == table:
                    found.setdefault(rel, []).append(scan)
        return list(found.items())

    def check(self) -> None:
        """Every relation is fed by scans of its source table, and every scan has a use."""
        for scan in self.scans:
            for rel in scan.relations:
                if rel.source != scan.table:
                    raise AssertionError(f"a scan of '{scan.table}' feeds a relation of '{rel.source}'")
            if not scan.shown and not scan.relations:
                raise AssertionError(f"a scan of '{scan.table}' has no use")


def whole_tables(catalog: Catalog, scans: Sequence[Scan]) -> set[str]:
    """Tables whose every row is in the output: requested whole, or linked to completely from rows that are."""
    whole = set()
    for s in scans:
        if s.predicate is None:
            whole |= {r.target for r in s.relations if r.passes_all(catalog)}
            if s.shown:
                whole.add(s.table)
    return whole


def simplify(plan: Plan) -> Plan:
    """Drop what whole tables make needless; what remains selects the same rows."""
    whole = whole_tables(plan.catalog, plan.scans)
    fed_by_all = {r for s in plan.scans if s.predicate is None for r in s.relations}
    scans: list[Scan] = []
    for s in plan.scans:
        keep = tuple(dict.fromkeys(r for r in s.relations if r.target not in whole and (s.predicate is None or r not in fed_by_all)))
        shown = s.shown and s.table not in whole
        if keep or shown:
            scans.append(replace(s, relations=keep, shown=shown))
    scans += [Scan(t) for t in sorted(whole)]
    # Scans of a table without a predicate are one.
    merged: dict[str, Scan] = {}
    rest: list[Scan] = []
    for s in scans:
        if s.predicate is not None:
            rest.append(s)
        elif s.table in merged:
            was = merged[s.table]
            merged[s.table] = replace(was, relations=tuple(dict.fromkeys(was.relations + s.relations)), shown=was.shown or s.shown)
        else:
            merged[s.table] = s
    out = replace(plan, scans=tuple(dict.fromkeys([*rest, *merged.values()])))
    out.check()
    return out


@dataclass
class PlanBuilder:
    """Collects requests; a request whose predicate never holds leaves nothing."""

    catalog: Catalog
    scans: list[Scan] = field(default_factory=list)
    outputs: dict[str, Output] = field(default_factory=dict)

    def request(self, table: str, predicate: Predicate | None, relations: Sequence[Relation] = ()) -> None:
        if predicate is not None and predicate.is_never():
            return
        self.scans.append(Scan(table, predicate, tuple(dict.fromkeys(relations))))

    def show(self, table: str, shape: Shape) -> None:
        self.outputs[table] = Output(table, shape)

    def join(self, source: str, target: str, target_key: Sequence[str], source_key: Sequence[str]) -> Relation:
        return Relation(JOIN, source, tuple(source_key), target, tuple(target_key))

    def tree(self, kind: str, table: str) -> Relation:
        key = self.catalog[table].key
        return Relation(kind, table, key, table, key)

    def foreign(self, kind: str, source: str, target: str, target_key: Sequence[str], source_key: Sequence[str]) -> Relation:
        return Relation(kind, source, tuple(source_key), target, tuple(target_key))

    def build(self, first_block: int = 0, last_block: int | None = None, parent_hash: str | None = None, all_blocks: bool = False) -> Plan:
        for t in self.catalog:
            self.outputs.setdefault(t.name, Output(t.name, Object(())))
        return simplify(Plan(self.catalog, tuple(self.scans), dict(self.outputs), first_block, last_block, parent_hash, all_blocks))
