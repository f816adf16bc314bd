"""Ingest of block streams into a store: micro-batches, continuity, forks, finality, retention.

``Ingest.step`` pulls from a block source; ``start`` runs the same rules on a Structured Streaming query
whose batches are JSON lines. Either way a batch becomes chunks of at most ``max_rows`` rows (a single block may have more) and one commit, finality and retention
included; all state is in the manifest, so a lost driver or a repeated batch changes nothing. Blocks come to the driver only from a source that yields them one
by one, and then ``max_rows`` rows at a time; those of a table or a stream stay distributed: their links are checked where they are written, and what comes are
the ends of each chunk.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from blockloom.catalog import camel
from blockloom.errors import StoreConflict
from blockloom.plans.execute import RANGE
from blockloom.session import drop, materialize
from blockloom.sources.blocks import Block, Fork, Lines, Source
from blockloom.sources.store import BlockRef, Manifest, Store, extend, replace_fork, rollback_point, settled

MAX_ROWS = 200_000


def batch_tables(spark: SparkSession, store: Store, lines: DataFrame, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """The tables of a batch of JSON lines (column ``line``); ``schemas``: stored columns by table, names in snake case."""
    header = store.catalog.header
    out = {}
    kinds = {name: T._parse_datatype_string(s) for name, s in schemas.items()}
    wire = lambda kind: T.StructType([T.StructField(camel(f.name), f.dataType) for f in kind.fields])
    body = T.StructType([T.StructField("header", wire(kinds[header.name]))] + [T.StructField(store.catalog[n].item_name, T.ArrayType(wire(k))) for n, k in kinds.items() if n != header.name])
    parsed = lines.select(F.from_json("line", body).alias("b"))
    for name, kind in kinds.items():
        definition = store.catalog[name]
        if name == header.name:
            rows, own = parsed.select("b.header.*"), kind.fields
            out[name] = rows.select(*[F.col(camel(f.name)).alias(f.name) for f in own])
        else:
            rows = parsed.select(F.col(f"b.header.{camel(header.block)}").alias("_number"), F.explode(f"b.{definition.item_name}").alias("r"))
            out[name] = rows.select(*[(F.col("_number") if f.name == definition.block else F.col("r")[camel(f.name)]).cast(f.dataType).alias(f.name) for f in kind.fields])
    return out


class Ingest:
    def __init__(self, store: Store, schemas: Mapping[str, str], max_rows: int = MAX_ROWS, keep: int | None = None) -> None:
        self.store, self.schemas, self.max_rows, self.keep = store, dict(schemas), max_rows, keep

    def apply(self, blocks: Sequence[Block]) -> Manifest:
        """Commit blocks that the driver holds."""
        return self.apply_lines(self._lines(blocks))

    def _lines(self, blocks: Sequence[Block]) -> DataFrame:
        return self.store.spark.createDataFrame([(json.dumps(b.body),) for b in blocks], "line string")

    def apply_lines(self, lines: DataFrame) -> Manifest:
        """Commit linked blocks after the head, or in place of what is there from their first block on. Blocks that are
        stored already are left out, so a repeated batch is harmless."""
        spark, header = self.store.spark, self.store.catalog.header
        of = lambda path: F.get_json_object("line", path)
        items = [self.store.catalog[t].item_name for t in self.schemas if t != header.name]
        rows = functools.reduce(operator.add, [F.coalesce(F.json_array_length(of(f"$.{i}")), F.lit(0)) for i in items], F.lit(1)).cast("long")
        # In the order of numbers, so that a chunk reads only its own part of the file. Lines are shuffled once, and only their number is read before that.
        placed = lines.select("line", of(f"$.header.{camel(header.block)}").cast("long").alias("n")).where("n is not null").repartitionByRange("n")
        read = placed.select("line", "n", of("$.header.hash").alias("hash"), F.coalesce(of("$.header.parentHash"), F.lit("")).alias("parent"), F.coalesce(of("$.final") == "true", F.lit(False)).alias("final"), rows.alias("rows"))
        staged, path = materialize(read.dropDuplicates(["n", "hash"]).sortWithinPartitions("n"))
        try:
            m = self.store.snapshot()
            head, found = m.head, self._ends(staged, m.head)
            if found["last"] is None:
                return m
            final = BlockRef(found["final"]["n"], found["final"]["hash"]) if found["final"] else None
            if head and found["last"]["n"] <= head.number and {c.last: c.last_hash for c in m.chunks}.get(found["last"]["n"]) == found["last"]["hash"]:
                return self.store.settle(final, self.keep)
            follows = head is not None and found["fresh"] is not None and found["fresh"]["parent"] == head.hash
            first = found["fresh"] if follows else found["first"]
            new, parent = m, first["parent"]
            for i, (low, high) in enumerate(self._cut(staged.where(F.col("n") >= first["n"]))):
                tables = batch_tables(spark, self.store, staged.where(F.col("n").between(low, high)), self.schemas)
                chunk = self.store.put(tables, parent)
                new = extend(new, chunk) if i or head is None or follows else replace_fork(new, chunk)
                parent = chunk.last_hash
            return self.store.commit(m, settled(new, final, self.keep))
        finally:
            drop(spark, path)

    @staticmethod
    def _ends(staged: DataFrame, head: BlockRef | None):
        """The first and last block, the first one after the head, and the last final one."""
        ref = F.struct("n", "hash", "parent")
        above = F.col("n") > F.lit(head.number if head else -1)
        return staged.agg(F.min(ref).alias("first"), F.max(ref).alias("last"), F.min(F.when(above, ref)).alias("fresh"), F.max(F.when(F.col("final"), ref)).alias("final")).first()

    def _cut(self, staged: DataFrame) -> list[tuple[int, int]]:
        """The first and last number of each chunk, by a running total in two levels; one row per chunk comes to the driver."""
        per_block = staged.groupBy("n").agg(F.sum("rows").alias("rows")).withColumn("_range", F.floor(F.col("n") / RANGE))
        ranges = per_block.groupBy("_range").agg(F.sum("rows").alias("_rows"))
        before = ranges.select("_range", F.coalesce(F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        within = F.coalesce(F.sum("rows").over(W.partitionBy("_range").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = per_block.withColumn("_within", within).join(before, "_range").select("n", F.floor((F.col("_before") + F.col("_within")) / self.max_rows).alias("_chunk"))
        return sorted((r["low"], r["high"]) for r in placed.groupBy("_chunk").agg(F.min("n").alias("low"), F.max("n").alias("high")).collect())

    def step(self, source: Source) -> str:
        """One round: ``grown``, ``rolled back`` (asks again from the common block) or ``idle``."""
        m = self.store.snapshot()
        got = self._pull(source, m.head)
        if isinstance(got, Fork):
            return self._roll_back(m, got, source)
        if got is None:
            return "idle"
        self.apply_lines(got)
        return "grown"

    def _pull(self, source: Source, at: BlockRef | None) -> Fork | DataFrame | None:
        """What a source has after a block: a fork, or lines (of ``max_rows`` rows, where it yields blocks one by one); None: nothing."""
        got: list[Block] = []
        rows = 0
        for x in source(at.number + 1 if at else 0, at.hash if at else None):
            if isinstance(x, Fork):
                return x
            if isinstance(x, Lines):
                return x.table
            got.append(x)
            rows += x.rows()
            if rows >= self.max_rows:
                break
        return self._lines(got) if got else None

    def _roll_back(self, m: Manifest, fork: Fork, source: Source) -> str:
        """Find the highest block in common, asking lower and lower, and replace what lies above it."""
        at = rollback_point(m, fork.previous)
        while isinstance(got := self._pull(source, at), Fork):
            below = Manifest(m.kind, m.version, tuple(c for c in m.chunks if at and c.last < at.number), m.finalized)
            at = rollback_point(below, got.previous)
        if got is None:
            return "idle"
        m = self.store.snapshot()
        if at is None:
            if m.finalized:
                raise StoreConflict("the other chain contradicts finality")
            self.store.reset()
        else:
            kept = tuple(c for c in m.chunks if c.last <= at.number)
            if m.finalized and m.finalized.number > at.number:
                raise StoreConflict(f"block {m.finalized.number} is final")
            if len(kept) < len(m.chunks):
                self.store.commit(m, replace(m, chunks=kept))
        self.apply_lines(got)
        return "rolled back"

    def handle(self, batch: DataFrame, _: int) -> None:
        """A micro-batch of lines; it stays distributed."""
        self.apply_lines(batch.select("line").where("line is not null and line != ''"))

    def start(self, lines: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = lines.writeStream.foreachBatch(self.handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
