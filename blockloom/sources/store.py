"""A versioned chunk store: Parquet chunks under one manifest that changes by atomic commits.

A manifest is a numbered JSON file; creating the next number is the commit, so of two writers one loses and gets
a conflict. A snapshot is a version: readers pin it, and what later versions drop stays on disk until ``vacuum``. Chunks
are linked by hash: every chunk knows its last block's hash and its first block's parent hash.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.catalog import Catalog
from blockloom.errors import ItemUnavailable, RangeUnavailable, StoreConflict
from blockloom.plans.execute import BUDGET, Execution, Tables
from blockloom.plans.request import Query
from blockloom.sources.files import Files
from blockloom.sources.layout import write_table
from blockloom.sources.physical import SORT_KEYS


@dataclass(frozen=True)
class BlockRef:
    number: int
    hash: str


@dataclass(frozen=True)
class StoredChunk:
    first: int
    last: int
    last_hash: str
    parent_hash: str
    tables: dict[str, str]
    rows: int
    schemas: dict[str, str] = field(default_factory=dict)

    @property
    def head(self) -> BlockRef:
        return BlockRef(self.last, self.last_hash)


@dataclass(frozen=True)
class Manifest:
    kind: str
    version: int = 0
    chunks: tuple[StoredChunk, ...] = ()
    finalized: BlockRef | None = None

    @property
    def head(self) -> BlockRef | None:
        return self.chunks[-1].head if self.chunks else None

    @property
    def first(self) -> int | None:
        return self.chunks[0].first if self.chunks else None

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Manifest:
        d = json.loads(text)
        chunks = tuple(StoredChunk(**c) for c in d["chunks"])
        return cls(d["kind"], d["version"], chunks, BlockRef(**d["finalized"]) if d["finalized"] else None)


# Pure changes of a manifest -----------------------------------------------------------------------------------


def extend(m: Manifest, chunk: StoredChunk) -> Manifest:
    """Add a chunk right after the head: it must link by hash and not overlap."""
    head = m.head
    if head and (chunk.first <= head.number or chunk.parent_hash != head.hash):
        raise StoreConflict(f"chunk {chunk.first}-{chunk.last} doesn't extend {head}")
    return replace(m, chunks=(*m.chunks, chunk))


def replace_fork(m: Manifest, chunk: StoredChunk) -> Manifest:
    """Put a chunk in place of all that begin at its first block or later; never below finality."""
    kept = tuple(c for c in m.chunks if c.first < chunk.first)
    if kept and kept[-1].last >= chunk.first:
        raise StoreConflict(f"chunk {chunk.first}-{chunk.last} begins inside {kept[-1].first}-{kept[-1].last}")
    below = kept[-1].head if kept else None
    if m.finalized and m.chunks:
        if m.finalized.number >= chunk.first and not (chunk.last >= m.finalized.number and len(kept) < len(m.chunks) and (chunk.last, chunk.last_hash) == (m.finalized.number, m.finalized.hash)):
            raise StoreConflict(f"block {m.finalized.number} is final")
    return extend(replace(m, chunks=kept), chunk) if below else replace(m, chunks=(chunk,))


def rollback_point(m: Manifest, previous: Sequence[BlockRef]) -> BlockRef | None:
    """The highest chunk head that the given chain has too; None: nothing in common above finality, start over."""
    known = {b.number: b.hash for b in previous}
    lowest = min(known, default=None)
    for c in reversed(m.chunks):
        if m.finalized and c.last < m.finalized.number:
            break
        if known.get(c.last) == c.last_hash:
            return c.head
        if lowest is not None and c.last < lowest:
            return c.head  # below all that is known of the other chain: to be tried
    if m.finalized:
        raise StoreConflict("the other chain contradicts finality")
    return None


def finalize(m: Manifest, block: BlockRef) -> Manifest:
    """Move finality forward, no further than the head; an older block changes nothing, another hash is a conflict."""
    head = m.head
    if head is None:
        return m
    target = block if block.number <= head.number else head
    if m.finalized and target.number <= m.finalized.number:
        if block.number == m.finalized.number and block.hash != m.finalized.hash:
            raise StoreConflict(f"block {block.number} is final with hash {m.finalized.hash}")
        return m
    for c in m.chunks:
        if c.last == block.number and c.last_hash != block.hash:
            raise StoreConflict(f"block {block.number} has hash {c.last_hash}")
    return replace(m, finalized=target)


def retain(m: Manifest, from_block: int | None = None, keep: int | None = None) -> Manifest:
    """Drop whole chunks below a block, or all but those that cover the last ``keep`` blocks."""
    if keep is not None and m.head:
        from_block = max(0, m.head.number - keep + 1)
    if from_block is None:
        return m
    kept = tuple(c for c in m.chunks if c.last >= from_block)
    finalized = m.finalized if kept and m.finalized and m.finalized.number >= kept[0].first else None
    return replace(m, chunks=kept, finalized=finalized)


def reset(m: Manifest) -> Manifest:
    return replace(m, chunks=(), finalized=None)


#: The side table of hashes that every chunk has.
HASHES = "_hashes"

#: Integer types from narrow to wide; schemas merge by widening only.
WIDTHS = ["tinyint", "smallint", "int", "bigint"]


def merged_schema(a: T.StructType, b: T.StructType) -> T.StructType | None:
    """The schema both fit into: equal names in order, equal types or integers of two widths; else None."""
    if a.names != b.names:
        return None
    fields = []
    for x, y in zip(a.fields, b.fields):
        kinds = [x.dataType.simpleString(), y.dataType.simpleString()]
        if kinds[0] != kinds[1]:
            if not set(kinds) <= set(WIDTHS):
                return None
            x = T.StructField(x.name, max((x.dataType, y.dataType), key=lambda t: WIDTHS.index(t.simpleString())))
        fields.append(x)
    return T.StructType(fields)


def _fits_behind(before: StoredChunk, c: StoredChunk) -> bool:
    """Whether two chunks could be one: linked, the same tables, schemas that merge."""
    if c.parent_hash != before.last_hash or set(c.tables) != set(before.tables):
        return False
    parsed = lambda x: T.StructType.fromJson(json.loads(x))
    return all(merged_schema(parsed(before.schemas[t]), parsed(c.schemas[t])) is not None for t in c.schemas if t in before.schemas)


#: Rows that end a chunk's growth, the least gain of a merge, chunks of a merge, chunks looked at.
TARGET, AMPLIFICATION, MOST, HORIZON = 200_000, 1.9, 50, 500


def compaction(m: Manifest, target: int = TARGET, amplification: float = AMPLIFICATION, most: int = MOST, horizon: int = HORIZON) -> tuple[int, int] | None:
    """The chunks [i, j) to merge next, or None.

    Chunks that could be one form runs; a chunk of ``target`` rows ends its run. A run that can't grow any more is merged piece by
    piece, as each of its rows is then rewritten once. In the last run, which grows, a merge must be worth it: its rows are at least
    ``amplification`` times those of its largest chunk; the longest such stretch is taken.
    """
    runs: list[list[int]] = []
    for i in range(max(0, len(m.chunks) - horizon), len(m.chunks)):
        c = m.chunks[i]
        last = m.chunks[runs[-1][-1]] if runs else None
        if last and last.rows < target and c.rows < target and _fits_behind(last, c):
            runs[-1].append(i)
        else:
            runs.append([i])
    for number, run in enumerate(runs):
        best: tuple[int, int] | None = None
        for at in range(len(run) - 1):
            rows = largest = m.chunks[run[at]].rows
            for end in range(at + 1, min(len(run), at + most)):
                size = m.chunks[run[end]].rows
                if rows + size > target:
                    break
                rows, largest = rows + size, max(largest, size)
                worth = number < len(runs) - 1 or rows >= amplification * largest
                if worth and (best is None or end + 1 - at > best[1] - best[0]):
                    best = (run[at], run[end] + 1)
        if best:
            return best
    return None


def settled(m: Manifest, final: BlockRef | None, keep: int | None) -> Manifest:
    """With finality moved on and old chunks dropped."""
    m = finalize(m, final) if final is not None else m
    return retain(m, keep=keep) if keep is not None else m


class Store:
    """A dataset on disk. All changes go through ``commit``."""

    def __init__(self, spark: SparkSession, root: str, catalog: Catalog, kind: str, sort_keys: Mapping[str, list[str]] | None = None) -> None:
        self.spark, self.files, self.catalog, self.kind = spark, Files(spark, root), catalog, kind
        self.sort_keys = dict(sort_keys or {t.name: list(SORT_KEYS.get(kind, {}).get(t.name, t.key)) for t in catalog})

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Manifest:
        if version is None:
            known = self.versions()
            if not known:
                return Manifest(self.kind)
            version = known[-1]
        m = Manifest.loads(self.files.read(f"manifest/{version:012}.json"))
        if m.kind != self.kind:
            raise StoreConflict(f"the store holds '{m.kind}', not '{self.kind}'")
        return m

    def commit(self, old: Manifest, new: Manifest) -> Manifest:
        if new is old:
            return old
        new = replace(new, version=old.version + 1)
        if not self.files.create(f"manifest/{new.version:012}.json", new.dumps()):
            raise StoreConflict(f"version {new.version} was committed by another writer")
        return new

    # Writing ----------------------------------------------------------------------------------------------------

    def put(self, tables: Mapping[str, DataFrame], parent_hash: str) -> StoredChunk:
        """Write a chunk's tables; it counts once a manifest names it. Blocks must link to each other."""
        header = tables[self.catalog.header.name]
        number = self.catalog.header.block
        place = f"data/{uuid.uuid4().hex}"
        paths = {name: f"{place}/{name}.parquet" for name in tables}

        def write_hashes() -> None:
            hashes = self._hashes(tables)
            path = f"{self.files.root}/{place}/{HASHES}.parquet"
            write_table(hashes, path, ["hash"], bloom=["hash"])

        def write(name: str) -> int:
            path = f"{self.files.root}/{paths[name]}"
            write_table(tables[name], path, [c for c in self.sort_keys.get(name, []) if c in tables[name].columns])
            return self.spark.read.parquet(path).count()  # from the footers

        def ends():
            listed = header.select(F.col(number).cast("long").alias("n"), "hash", "parent_hash")
            return listed.agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("parent_hash", "n").alias("parent"), F.max_by("hash", "n").alias("hash")).first()

        # Independent jobs; nothing counts before the commit, so the checks may run beside the writes.
        with ThreadPoolExecutor(len(tables) + 3) as pool:
            checks, broken = pool.submit(ends), pool.submit(lambda: not broken_links(header, number).isEmpty())
            index = pool.submit(write_hashes)
            counts = {name: pool.submit(write, name) for name in tables}
            found, rows = checks.result(), max(c.result() for c in counts.values())
            unlinked = broken.result()
            index.result()
        if found["first"] is None or found["parent"] != parent_hash or unlinked:
            self.files.delete(place)
            raise StoreConflict("a chunk needs a block" if found["first"] is None else "the chunk's blocks don't link")
        schemas = {name: df.schema.json() for name, df in tables.items()}
        return StoredChunk(found["first"], found["last"], found["hash"], parent_hash, paths, rows, schemas)

    def _hashes(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        """kind, hash, n, i: where a chunk's blocks and transactions are. Written with every chunk, sorted by hash and with a filter, so that a
        lookup opens no more than the few row groups that may hold the hash."""
        header = self.catalog.header
        out = tables[header.name].select(F.lit("block").alias("kind"), "hash", F.col(header.block).cast("long").alias("n"), F.lit(None).cast("long").alias("i"))
        t = tables.get("transactions")
        if t is not None and {"hash", "block_number", "transaction_index"} <= set(t.columns):
            out = out.unionByName(t.select(F.lit("transaction").alias("kind"), "hash", F.col("block_number").cast("long").alias("n"), F.col("transaction_index").cast("long").alias("i")))
        return out.where("hash is not null")

    def _find(self, kind: str, value: str):
        """The hash's row in the newest chunk that has it."""
        paths = [f"{self.files.root}/{next(iter(c.tables.values())).rsplit('/', 1)[0]}/{HASHES}.parquet" for c in self.snapshot().chunks]
        if not paths:
            return None
        found = self.spark.read.schema("kind string, hash string, n long, i long").parquet(*paths).where((F.col("hash") == value) & (F.col("kind") == kind))
        return found.orderBy(F.desc("n"), F.desc("i")).first()

    def append(self, tables: Mapping[str, DataFrame], parent_hash: str, final: BlockRef | None = None, keep: int | None = None) -> Manifest:
        """A chunk after the head. Finality and retention that come with it are part of the same commit."""
        m = self.snapshot()
        return self.commit(m, settled(extend(m, self.put(tables, parent_hash)), final, keep))

    def fork(self, tables: Mapping[str, DataFrame], parent_hash: str, final: BlockRef | None = None, keep: int | None = None) -> Manifest:
        """A chunk in place of all from its first block on; likewise."""
        m = self.snapshot()
        return self.commit(m, settled(replace_fork(m, self.put(tables, parent_hash)), final, keep))

    def settle(self, final: BlockRef | None = None, keep: int | None = None) -> Manifest:
        """Finality and retention without a chunk, in one commit."""
        m = self.snapshot()
        new = settled(m, final, keep)
        return m if new == m else self.commit(m, new)

    def finalize(self, block: BlockRef) -> Manifest:
        m = self.snapshot()
        return self.commit(m, finalize(m, block))

    def retain(self, from_block: int | None = None, keep: int | None = None) -> Manifest:
        m = self.snapshot()
        new = retain(m, from_block, keep)
        return m if new == m else self.commit(m, new)

    def reset(self) -> Manifest:
        m = self.snapshot()
        return self.commit(m, reset(m))

    def compact(self, **limits) -> Manifest:
        """Merge one run of small chunks into one; a commit in between by another writer is a conflict."""
        m = self.snapshot()
        span = compaction(m, **limits)
        if span is None:
            return m
        run = m.chunks[span[0] : span[1]]
        tables = {name: self._read(name, run) for name in run[0].tables}
        chunk = self.put(tables, run[0].parent_hash)
        return self.commit(m, replace(m, chunks=(*m.chunks[: span[0]], chunk, *m.chunks[span[1] :])))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data that none of the last versions names, and older manifests."""
        known = self.versions()
        kept = known[-keep_versions:]
        used = {p.split("/")[1] for v in kept for c in self.snapshot(v).chunks for p in c.tables.values()}
        gone = [d for d in self.files.names("data") if d not in used]
        for v in known[:-keep_versions]:
            self.files.delete(f"manifest/{v:012}.json")
        for d in gone:
            self.files.delete(f"data/{d}")
        return len(gone)

    # Reading ----------------------------------------------------------------------------------------------------

    def _read(self, name: str, chunks: Sequence[StoredChunk]) -> DataFrame:
        """A table over chunks, integers widened to what all fit into."""
        schema: T.StructType | None = None
        for c in chunks:
            own = T.StructType.fromJson(json.loads(c.schemas[name]))
            schema = own if schema is None else merged_schema(schema, own)
            if schema is None:
                raise StoreConflict(f"the chunks' schemas of '{name}' don't merge")
        parts: dict[str, list[str]] = {}
        for c in chunks:
            parts.setdefault(c.schemas[name], []).append(f"{self.files.root}/{c.tables[name]}")
        out = None
        for own, paths in parts.items():  # one scan per distinct schema, not per chunk
            df = self.spark.read.schema(T.StructType.fromJson(json.loads(own))).parquet(*paths)
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
            out = df if out is None else out.unionByName(df)
        return out

    def tables(self, m: Manifest | None = None, first: int = 0, last: int | None = None, needed: Sequence[str] = ()) -> Tables:
        """The tables of a snapshot over the chunks that touch the range."""
        m = m or self.snapshot()
        chunks = [c for c in m.chunks if c.last >= first and (last is None or c.first <= last)]
        for name in needed:
            for c in chunks:
                if name not in c.tables:
                    raise ItemUnavailable(name, c.first)
        names = {n for c in chunks for n in c.tables}
        return Tables({n: self._read(n, [c for c in chunks if n in c.tables]) for n in names})

    def query(self, query: Query, finalized_only: bool = False, budget: int = BUDGET, version: int | None = None) -> Execution | None:
        """An execution on one snapshot. None: no data yet. Errors: below the store's first block; a table not stored."""
        m = self.snapshot(version)
        plan = query.compile()
        last = plan.last_block
        if finalized_only:
            if m.finalized is None:
                return None
            last = m.finalized.number if last is None else min(last, m.finalized.number)
        if m.head is None or plan.first_block > m.head.number or (last is not None and last < plan.first_block):
            return None
        if plan.first_block < m.first:
            raise RangeUnavailable(f"blocks below {m.first} aren't stored")
        needed = {s.table for s in plan.scans} | {r.target for s in plan.scans for r in s.relations} | {self.catalog.header.name}
        plan = replace(plan, last_block=last)
        # The check of the parent may need the chunk below the range.
        below = [c.first for c in m.chunks if c.last < plan.first_block]
        first = below[-1] if below and plan.parent_hash is not None else plan.first_block
        tables = self.tables(m, first, last, sorted(needed))
        return Execution(plan, tables, budget)

    def stream(self, query: Query, finalized_only: bool = False, budget: int = BUDGET):
        """All records of a query, batch by batch: each within the budget, the next one from the block after the last."""
        version = (self.versions() or [None])[-1]
        body, check = dict(query.body), True
        while True:
            execution = self.query(Query(query.dialect, body), finalized_only, budget, version)
            if execution is None:
                return
            if not check:
                execution.plan = replace(execution.plan, parent_hash=None)
            bounds = execution.bounds()
            if bounds is None:
                return
            last = bounds[2]
            yield from execution.json_lines()
            body, check = {**body, "fromBlock": last + 1}, False
            if execution.plan.last_block is not None and last >= execution.plan.last_block:
                return

    def head(self) -> BlockRef | None:
        return self.snapshot().head

    def finalized_head(self) -> BlockRef | None:
        return self.snapshot().finalized

    def status(self) -> dict:
        m = self.snapshot()
        return {"kind": m.kind, "version": m.version, "firstBlock": m.first, "lastBlock": m.head and m.head.number, "lastBlockHash": m.head and m.head.hash, "finalized": m.finalized and asdict(m.finalized), "chunks": len(m.chunks), "rows": sum(c.rows for c in m.chunks)}

    def block_by_hash(self, block_hash: str) -> BlockRef | None:
        """A miss proves nothing about blocks that aren't stored."""
        row = self._find("block", block_hash)
        return BlockRef(row["n"], block_hash) if row else None

    def transaction_by_hash(self, transaction_hash: str) -> tuple[int, int] | None:
        """(block number, transaction index)."""
        row = self._find("transaction", transaction_hash)
        return (row["n"], row["i"]) if row else None


def broken_links(header: DataFrame, number: str) -> DataFrame:
    """Blocks that break the chain of a table: without their parent before them, a second child of one parent, or a
    second block of one number. The first block needs no parent. All by counts per key, combined before each shuffle, so a parent of very many
    blocks is one row; blocks without a parent join nothing."""
    own = header.select(F.col(number).cast("long").alias("n"), "hash", "parent_hash")
    as_parent = own.select(F.col("hash").alias("parent_hash"), F.col("n").alias("_number"), F.lit(0).alias("_child"))
    as_child = own.where("parent_hash is not null").select("parent_hash", F.lit(None).cast("long").alias("_number"), F.lit(1).alias("_child"))
    parents = as_parent.unionByName(as_child).groupBy("parent_hash").agg(F.max("_number").alias("parent_number"), F.sum("_child").alias("_siblings")).where("parent_number is not null")
    crowded = own.groupBy("n").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    first = own.agg(F.min("n").alias("_first"))
    linked = own.where("parent_hash is not null").join(parents, "parent_hash", "left").select("n", "hash", "parent_hash", "parent_number", "_siblings")
    orphans = own.where("parent_hash is null").select("n", "hash", "parent_hash", F.lit(None).cast("long").alias("parent_number"), F.lit(None).cast("long").alias("_siblings"))
    counted = linked.unionByName(orphans).join(crowded, "n", "left").join(F.broadcast(first))
    unlinked = (F.col("n") > F.col("_first")) & (F.col("parent_number").isNull() | (F.col("parent_number") >= F.col("n")))
    return counted.where(unlinked | F.col("_same").isNotNull() | (F.col("parent_number").isNotNull() & (F.col("_siblings") > 1))).select("n", "hash", "parent_hash")
