"""Plans to DataFrames: selection by existence, weights, the output budget, nested JSON per block.

Selections stay lazy. Before output, the keys of each relation and the weights of the chosen blocks are written once and read
from then on, so that no relation is evaluated twice; the budget then is one small action that gives three numbers. The block range goes into every scan: all keys begin
with the block number, so related rows lie in the same block. Weights are summed per block before anything else; the running
total has two levels (blocks within ranges, and ranges), so no task sorts all blocks.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.catalog import TableDef
from blockloom.errors import ColumnMissing, TableMissing, UnexpectedBaseBlock
from blockloom.operators import relations as rel
from blockloom.plans.plan import CHILDREN, FOREIGN_CHILDREN, FOREIGN_PARENTS, JOIN, PARENTS, Output, Plan, Relation, Scan
from blockloom.session import materialize

BUDGET = 20 * 1024 * 1024
RANGE = 1 << 13
#: Blocks below the range whose headers are read for the check of the parent.
NEAR = 1000


class Tables:
    """The tables of a dataset, by name."""

    def __init__(self, frames: Mapping[str, DataFrame]) -> None:
        self.frames = dict(frames)

    def get(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise TableMissing(name)
        return self.frames[name]


@dataclass
class Execution:
    plan: Plan
    tables: Tables
    budget: int = BUDGET
    _chosen: dict[str, DataFrame | None] = field(default_factory=dict)
    _bounds: tuple[int, int, int] | None = None
    _within: Execution | None = None
    _written: dict[Relation, DataFrame] = field(default_factory=dict)
    _weights: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        """The table within the block range, block numbers as longs, undeclared names as they are stored."""
        definition = self.plan.catalog[name]
        df = self.tables.get(name)
        for wanted, stored in definition.aliases.items():
            if wanted not in df.columns and stored in df.columns:
                df = df.withColumnRenamed(stored, wanted)
        missing = [c for c in definition.defaults if c not in df.columns]
        if missing:
            df = df.select("*", *[F.lit(None).cast(definition.defaults[c]).alias(c) for c in missing])
        block = definition.block
        self.require(name, df, [block])
        if not isinstance(df.schema[block].dataType, T.LongType):
            df = df.withColumn(block, F.col(block).cast("long"))
        conditions = [F.col(block) >= self.plan.first_block] if self.plan.first_block else []
        if self.plan.last_block is not None:
            conditions.append(F.col(block) <= self.plan.last_block)
        return df.where(functools.reduce(operator.and_, conditions)) if conditions else df

    @staticmethod
    def require(name: str, df: DataFrame, columns: Sequence[str]) -> None:
        for c in columns:
            if c not in df.columns:
                raise ColumnMissing(name, c)

    def scanned(self, scans: Sequence[Scan]) -> DataFrame:
        """The rows that any of some scans of one table selects."""
        name = scans[0].table
        df = self.table(name)
        if any(s.predicate is None for s in scans):
            return df
        return df.where(self._predicate(name, df, scans))

    def _predicate(self, name: str, df: DataFrame, scans: Sequence[Scan]) -> Column:
        for s in scans:
            self.require(name, df, sorted(s.predicate.columns()))
        return functools.reduce(operator.or_, [s.predicate.on(df) for s in scans])

    def selected(self, name: str) -> DataFrame | None:
        """The output rows of an item table, all columns; None where nothing asks for them."""
        if name in self._chosen:
            return self._chosen[name]
        shown = [s for s in self.plan.scans if s.table == name and s.shown]
        related = self.plan.relations_into(name)
        out: DataFrame | None = None
        if shown or related:
            df = self.table(name)
            if any(s.predicate is None for s in shown):
                out = df
            else:
                keys = [(r.target_key, self._keys(r, scans, df)) for r, scans in related]
                out = rel.select_rows(df, self._predicate(name, df, shown) if shown else None, keys)
        self._chosen[name] = out
        return out

    def _keys(self, r: Relation, scans: Sequence[Scan], target: DataFrame) -> DataFrame:
        if r in self._written:
            return self._written[r]
        source = self.scanned(scans)
        self.require(r.source, source, r.source_key)
        self.require(r.target, target, r.target_key)
        if r.kind == JOIN:
            return rel.join(source, r.source_key, r.target_key)
        if r.kind == PARENTS:
            return rel.parents(source, r.source_key, r.target_key)
        if r.kind == CHILDREN:
            return rel.children(source, target, r.target_key)
        if r.kind == FOREIGN_CHILDREN:
            return rel.foreign_children(source, r.source_key, target, r.target_key)
        if r.kind == FOREIGN_PARENTS:
            return rel.foreign_parents(source, r.source_key, target, r.target_key)
        raise AssertionError(r.kind)

    def write_keys(self) -> None:
        """Evaluate each relation that output needs once, all at the same time, and keep its keys."""
        asked = {}
        for t in self.plan.catalog:
            if not any(s.table == t.name and s.shown and s.predicate is None for s in self.plan.scans):
                for r, scans in self.plan.relations_into(t.name):
                    if r not in self._written:
                        asked[r] = self._keys(r, scans, self.table(t.name))
        if asked:
            with ThreadPoolExecutor(len(asked)) as pool:
                done = dict(zip(asked, pool.map(lambda keys: materialize(keys)[0], asked.values())))
            self._written.update(done)
            self._chosen.clear()

    def weight(self, definition: TableDef, output: Output, df: DataFrame) -> Column:
        """A row's weight; a null size counts nothing."""
        fixed, stored = definition.weight([c for c in output.columns if c in df.columns])
        self.require(definition.name, df, stored)
        return functools.reduce(operator.add, [F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in stored], F.lit(fixed).cast("long"))

    def item_tables(self) -> list[TableDef]:
        return [t for t in self.plan.catalog if t is not self.plan.catalog.header and self.selected(t.name) is not None]

    def block_weights(self) -> DataFrame:
        """number, weight of every block that may be emitted."""
        header = self.plan.catalog.header
        blocks = self.table(header.name)
        own = blocks.select(F.col(header.block).alias("number"), self.weight(header, self.plan.outputs[header.name], blocks).alias("w"))
        parts = [self.selected(t.name).select(F.col(t.block).alias("number"), self.weight(t, self.plan.outputs[t.name], self.selected(t.name)).alias("w")) for t in self.item_tables()]
        items = functools.reduce(DataFrame.unionByName, parts) if parts else None
        if self.plan.all_blocks:
            every = own.unionByName(items) if items is not None else own
            return every.groupBy("number").agg(F.sum("w").alias("weight"))
        # The first and last block of the range are always emitted.
        ends = own.agg(F.array(F.min("number"), F.max("number")).alias("_ends")).select(F.explode(F.array_distinct("_ends")).alias("number")).where("number is not null").withColumn("w", F.lit(0).cast("long"))
        summed = (items.unionByName(ends) if items is not None else ends).groupBy("number").agg(F.sum("w").alias("items"))
        per_block = own.groupBy("number").agg(F.max("w").alias("w"))
        return per_block.join(summed, "number").select("number", (F.col("w") + F.col("items")).alias("weight"))

    def running(self) -> DataFrame:
        """number, weight, running: the cumulative weight in block order, in two levels."""
        weights = (self._weights if self._weights is not None else self.block_weights()).withColumn("_range", F.floor(F.col("number") / RANGE))
        ranges = weights.groupBy("_range").agg(F.sum("weight").alias("_w"))
        before = ranges.select("_range", F.coalesce(F.sum("_w").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        within = F.sum("weight").over(W.partitionBy("_range").orderBy("number").rowsBetween(W.unboundedPreceding, 0))
        return weights.withColumn("_within", within).join(before, "_range").select("number", "weight", (F.col("_before") + F.col("_within")).alias("running"))

    def kept(self) -> DataFrame:
        """One row, last_block: the last block within the budget, at least the first one."""
        r = self.running()
        return r.agg(F.coalesce(F.max(F.when(F.col("running") <= self.budget, F.col("number"))), F.min("number")).alias("last_block"))

    def bounds(self) -> tuple[int, int, int] | None:
        """(first block, last block, last block within the budget) of what may be emitted: the one action before
        output, three numbers. None where the range has no block."""
        if self._bounds is None:
            self.write_keys()
            if self._weights is None:
                self._weights = materialize(self.block_weights())[0]
            r = self.running()
            row = r.agg(F.min("number").alias("first"), F.max("number").alias("end"), F.max(F.when(F.col("running") <= self.budget, F.col("number"))).alias("fit")).first()
            if row["first"] is None:
                return None
            self._bounds = (row["first"], row["end"], row["first"] if row["fit"] is None else row["fit"])
        return self._bounds

    def within(self) -> Execution:
        """The same plan up to the last block within the budget; as a literal, that bound reaches every scan."""
        if self._within is None:
            bounds = self.bounds()
            self._within = Execution(replace(self.plan, last_block=-1 if bounds is None else bounds[2]), self.tables, self.budget, _written=self._written)
        return self._within

    def check_parent(self) -> None:
        """The block below the range must have the asserted hash: as the range's first block names its parent, else as the
        highest block below is stored, however far below."""
        if self.plan.parent_hash is None:
            return
        header, first = self.plan.catalog.header, self.plan.first_block
        df = self.tables.get(header.name)
        self.require(header.name, df, ["parent_hash"])
        own = F.col(header.block).cast("long")
        above = F.col("parent_number").cast("long") if "parent_number" in df.columns else own - 1
        named = df.where(own == first).select(above.alias("number"), F.col("parent_hash").alias("hash"))

        def below(lowest: int | None) -> list:
            refs = named
            if "hash" in df.columns:
                near = (own < first) if lowest is None else own.between(lowest, first - 1)
                refs = refs.unionByName(df.where(near).select(own.alias("number"), "hash"))
            return refs.select("number", F.coalesce("hash", F.lit("")).alias("hash")).distinct().orderBy(F.desc("number")).limit(100).collect()

        # All headers below the range are looked at only where those right below it are missing.
        found = below(first - NEAR) or below(None)
        previous = [(r["number"], r["hash"]) for r in reversed(found)]
        if not previous or previous[-1][1] != self.plan.parent_hash:
            raise UnexpectedBaseBlock(self.plan.parent_hash, previous)

    # Results ---------------------------------------------------------------------------------------------------

    def _find(self, name: str, df: DataFrame):
        definition = self.plan.catalog[name]

        def find(column: str):
            if column in df.columns:
                return F.col(column), df.schema[column].dataType
            if column in definition.defaults:
                return None
            raise ColumnMissing(name, column)

        return find

    def rendered(self, name: str, df: DataFrame) -> Column:
        return self.plan.outputs[name].shape.row(self._find(name, df))

    def items(self, name: str) -> DataFrame:
        """All columns of an item table's rows that lie within the budget."""
        return self.within().selected(name)

    def headers(self) -> DataFrame:
        """Headers of blocks with items, and of the range's first and last block; of all blocks where those are asked for."""
        header, inner = self.plan.catalog.header, self.within()
        df = inner.table(header.name)
        if self.plan.all_blocks or self.bounds() is None:
            return df
        return rel.select_rows(df, None, [([header.block], self._weights.select(F.col("number").alias(header.block)))])

    def blocks(self) -> DataFrame:
        """number, json: one nested record per block, in block order; collections without items are left out."""
        self.check_parent()
        header = self.plan.catalog.header
        chosen = self.headers()
        out = chosen.select(F.col(header.block).alias("number"), self.rendered(header.name, chosen).alias("_header"))
        for i, t in enumerate(self.item_tables()):
            df = self.items(t.name)
            self.require(t.name, df, t.key)
            rows = df.select(F.col(t.block).alias("number"), F.struct(*[F.col(k).alias(f"k{j}") for j, k in enumerate(t.key[1:])], self.rendered(t.name, df).alias("json")).alias("_row"))
            lists = rows.groupBy("number").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["json"]), ",").alias(f"_items{i}"))
            out = out.join(lists, "number", "left")
        parts = [F.concat(F.lit('{"header":'), F.col("_header"))]
        for i, t in enumerate(self.item_tables()):
            parts.append(F.coalesce(F.concat(F.lit(f',"{t.item_name}":['), F.col(f"_items{i}"), F.lit("]")), F.lit("")))
        # The budget bounds all records together, so one task orders them; a range partitioning would make them twice, to sample them first.
        return out.select("number", F.concat(*parts, F.lit("}")).alias("json")).repartition(1).sortWithinPartitions("number")

    def json_lines(self) -> list[str]:
        """The records as text; bounded by the budget."""
        return [r["json"] for r in self.blocks().toLocalIterator()]

    def json_array(self) -> str:
        return "[" + ",".join(self.json_lines()) + "]"
