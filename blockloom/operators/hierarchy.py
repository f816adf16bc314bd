"""Problem 6: parent links to full hierarchies.

Method: bottom-up leaf peeling. A node whose children are all peeled is peeled and sends its subtree size to
its parent; what can't be peeled lies on cycles. In reverse order, parents give their children root, depth and
path, or the cycle they lead to and the number of links to it. Descendants come as rows (ancestor,
descendant, distance), one per entry of a path: a root may have a third of all nodes below it, and no task then
gathers them.

Peeling one level per Spark job would take as many jobs as the deepest chain is long. So nodes lie in buckets of bounded size, ranges of
their order column (parents are mostly near), and are peeled in three steps, whatever the depth and the order:

1. Each bucket peels its own nodes, so that every node knows the top of its tree within the bucket, or the cycle within it.
2. Tops whose parent lies in another bucket are contracted: such a top hangs below the top of its parent. This smaller graph is peeled in one
   task where it fits into a bucket; where it doesn't (an order column that says nothing), pointers are doubled on it, in logarithmically many steps.
   Nodes that lead to a cycle across buckets are settled in the same way among themselves.
3. Each bucket is peeled once more with the sizes of the trees that hang on it from outside, and gives sizes and paths.

Defined results: identifiers are compared without outer blanks and case; rows without an identifier are no
nodes; a parent that is null, blank or no node makes a root; repeated rows are one node (with several distinct
parents, the least one holds); a node that is its own parent is a cycle of one; nodes on or behind a cycle have no root,
depth or path; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.session import drop, materialize
from blockloom.sources.tables import is_value, normal

BUCKET = 20_000
_PATH_BATCH = 150_000


class Peeled:
    """A graph of parent links, peeled: ``up`` holds each node's parent by place, -1 for none; places are in the order of identifiers."""

    def __init__(self, up: np.ndarray, weight: np.ndarray, step: np.ndarray | None = None) -> None:
        n = len(up)
        self.up, self.size = up, weight.astype(np.int64)
        step = np.ones(n, dtype=np.int64) if step is None else step
        pending = np.bincount(up[up >= 0], minlength=n)
        ring = np.ones(n, dtype=bool)
        self.levels: list[np.ndarray] = []
        front = np.flatnonzero(pending == 0)
        while len(front):
            self.levels.append(front)
            ring[front] = False
            hung = front[up[front] >= 0]
            above = up[hung]
            np.add.at(self.size, above, self.size[hung])
            np.subtract.at(pending, above, 1)
            above = np.unique(above)
            front = above[pending[above] == 0]
        self.ring = ring
        #: The root that a node leads to, or the least node of its cycle, and the links to the root or to the first node on the cycle.
        self.head, self.far = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for i in np.flatnonzero(ring).tolist():
            if self.head[i] < 0:
                members, at = [i], int(up[i])
                while at != i:
                    members.append(at)
                    at = int(up[at])
                self.head[members] = min(members)
        for front in reversed(self.levels):
            own = up[front] < 0
            self.head[front[own]] = front[own]
            hung = front[~own]
            self.head[hung], self.far[hung] = self.head[up[hung]], self.far[up[hung]] + step[hung]
        self.caught = ring[self.head] if n else ring

    def down(self) -> Iterator[int]:
        """Nodes that lead to a root, parents first."""
        for front in reversed(self.levels):
            yield from front[~self.caught[front]].tolist()


def _by_place(table: pa.Table, parent: str) -> tuple[pa.Table, np.ndarray]:
    """The table in the order of ``id``, and each row's parent by place."""
    table = table.take(pc.sort_indices(table["id"])).combine_chunks()
    ids, parents = table["id"].combine_chunks(), table[parent].combine_chunks()
    found = pc.index_in(parents, value_set=ids, skip_nulls=True)
    return table, found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


Work = Callable[[pa.Table], Iterator[pa.RecordBatch]]


def _per_bucket(df: DataFrame, work: Work, schema: str) -> DataFrame:
    """``work`` on all rows of each bucket (the first column); its output streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            while batch.num_rows:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                if held and ids[0] != now:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                now = ids[0]
                end = int(ids.searchsorted(now, side="right"))
                held.append(batch.slice(0, end))
                batch = batch.slice(end)
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _in_one(df: DataFrame, work: Work, schema: str) -> DataFrame:
    """``work`` on all rows of a table that fits into a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.coalesce(1).mapInArrow(run, schema)


def _first_pass(found: DataFrame, parts: int) -> DataFrame:
    """bucket, id, parent, top, steps, cycle, size: what each bucket knows of its own nodes. A range is a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, up = _by_place(pa.Table.from_batches(held), "parent")
        p = Peeled(up, np.ones(len(up), dtype=np.int64))
        ids = table["id"].combine_chunks()
        head = ids.take(pa.array(p.head))
        none = pa.nulls(len(ids), pa.string())
        columns = [pa.array(np.full(len(ids), TaskContext.get().partitionId(), dtype=np.int32)), ids, table["parent"].combine_chunks(), pc.if_else(pa.array(p.caught), none, head), pa.array(p.far), pc.if_else(pa.array(p.caught), head, none), pa.array(p.size)]
        yield from pa.Table.from_arrays(columns, names=["bucket", "id", "parent", "top", "steps", "cycle", "size"]).to_batches(max_chunksize=50_000)

    placed = found.repartitionByRange(parts, F.col("place").asc_nulls_first(), "id")
    return placed.select("id", "parent").mapInArrow(run, "bucket int, id string, parent string, top string, steps long, cycle string, size long")


_SOLVED = "id string, head string, far long, size long, cycle string, chain array<string>"


def _solved(graph: DataFrame, bucket: int, with_chains: bool) -> DataFrame:
    """id, head, far, size, cycle, chain of a graph (id, next, step, weight): the node where the links end with the sum of steps up to it, or
    the least node of the cycle with the links to it; the weights of the subtree; the nodes from the head down."""
    if graph.limit(bucket + 1).count() > bucket:
        return _doubled(graph, with_chains)

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        table, up = _by_place(rows, "next")
        p = Peeled(up, table["weight"].to_numpy(), table["step"].to_numpy())
        ids = table["id"].combine_chunks()
        names, chains = ids.to_pylist() if with_chains else [], [None] * len(ids)
        if with_chains:
            for i in p.down():
                chains[i] = [*(chains[up[i]] if up[i] >= 0 else ()), names[i]]
        head, none = ids.take(pa.array(p.head)), pa.nulls(len(ids), pa.string())
        columns = [ids, pc.if_else(pa.array(p.caught), none, head), pa.array(p.far), pa.array(p.size), pc.if_else(pa.array(p.caught), head, none), pa.array(chains, pa.list_(pa.string()))]
        yield from pa.Table.from_arrays(columns, names=["id", "head", "far", "size", "cycle", "chain"]).to_batches(max_chunksize=20_000)

    return materialize(_in_one(graph.select("id", "next", "step", "weight"), work, _SOLVED))[0]


def _doubled(graph: DataFrame, with_chains: bool) -> DataFrame:
    """The same by doubling pointers: after k steps a node knows its chain for 2^k links, and the weights that near below it."""
    spark = graph.sparkSession
    known = graph.select(F.col("id").alias("next"), F.lit(True).alias("_known"))
    chain = F.array("id") if with_chains else F.lit(None).cast("array<string>")
    start = graph.join(known, "next", "left").select("id", F.when(F.col("_known"), F.col("next")).alias("ptr"), F.col("id").alias("head"), F.when(F.col("_known"), F.col("step")).otherwise(0).cast("long").alias("far"), F.col("weight").alias("size"), chain.alias("chain"))
    state, path = materialize(start)
    alive = state.where("ptr is not null").count()
    images = -1
    while alive:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("head").alias("_head"), F.col("far").alias("_far"), F.col("chain").alias("_chain"))
        below = state.where("ptr is not null").groupBy(F.col("ptr").alias("id")).agg(F.sum("size").alias("_more"))
        joined = state.join(ahead, "ptr", "left").join(below, "id", "left")
        longer = F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.concat("_chain", "chain")) if with_chains else F.col("chain")
        after, after_path = materialize(joined.select("id", F.col("_ptr").alias("ptr"), F.coalesce("_head", "head").alias("head"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"), longer.alias("chain")))
        drop(spark, path)
        state, path, before = after, after_path, (alive, images)
        alive, images = state.where("ptr is not null").agg(F.count(F.lit(1)), F.count_distinct("ptr")).first()
        # No node's links have ended, so all that are left lead to cycles; and no pointer has left a tail, so all pointers are on cycles.
        if (alive, images) == before:
            break
    free = state.where("ptr is null").select("id", "head", "far", "size", F.lit(None).cast("string").alias("cycle"), "chain")
    if not alive:
        return free
    ring, _ = materialize(state.where("ptr is not null").select(F.col("ptr").alias("id")).distinct())
    least, least_path = materialize(ring.join(graph.select("id", "next"), "id").select("id", "next", F.col("id").alias("least")))
    while True:
        ahead = least.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"))
        after, after_path = materialize(least.join(ahead, "next").select("id", F.col("_next").alias("next"), F.least("least", "_least").alias("least"), (F.col("_least") < F.col("least")).alias("changed")))
        drop(spark, least_path)
        stable = after.where("changed").isEmpty()
        least, least_path = after.select("id", "next", "least"), after_path
        if stable:
            break
    # Tails are trees below the cycles' nodes.
    ringed = ring.withColumn("_ring", F.lit(True))
    tails = state.where("ptr is not null").select("id").join(graph, "id").join(ringed, "id", "left").select("id", F.when(F.col("_ring").isNull(), F.col("next")).alias("next"), "step", "weight")
    hung = _doubled(tails, False).join(least.select(F.col("id").alias("head"), F.col("least").alias("label")), "head")
    caught = hung.select("id", F.lit(None).cast("string").alias("head"), "far", "size", F.col("label").alias("cycle"), F.lit(None).cast("array<string>").alias("chain"))
    return free.unionByName(caught)


def _segments(inner: DataFrame, entries: DataFrame) -> DataFrame:
    """id, segment: the way from its top to each of some nodes, within the bucket."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        table, up = _by_place(rows, "parent")
        ids = table["id"].to_pylist()
        out, size = ([], []), 0
        for i in np.flatnonzero(table["asked"].to_numpy(zero_copy_only=False)).tolist():
            way, at = [ids[i]], int(up[i])
            while at >= 0:
                way.append(ids[at])
                at = int(up[at])
            out[0].append(ids[i])
            out[1].append(way[::-1])
            size += len(way)
            if size > _PATH_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.list_(pa.string()))], names=["id", "segment"])
                out, size = ([], []), 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.list_(pa.string()))], names=["id", "segment"])

    asked = inner.where("cycle is null").join(entries.select("id", F.lit(True).alias("asked")), "id", "left")
    return _per_bucket(asked.select("bucket", "id", "parent", F.coalesce("asked", F.lit(False)).alias("asked")), work, "id string, segment array<string>")


_OUT = "id string, parent string, root string, depth long, path array<string>, descendants long, cycle string, hops long"


def _last_pass(rows: DataFrame, with_paths: bool) -> DataFrame:
    """Sizes with what hangs on each node from other buckets, and paths; everything else goes through."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table, up = _by_place(table, "parent")
        p = Peeled(up, 1 + table["more"].to_numpy())
        size = pa.array(np.where(table["settled"].to_numpy() >= 0, table["settled"].to_numpy(), p.size) - 1)
        n = len(up)

        def batch(at: np.ndarray, paths: list) -> pa.RecordBatch:
            some = table.take(pa.array(at)).combine_chunks()
            column = lambda c: some[c].combine_chunks()
            arrays = [column("id"), column("shown"), column("root"), column("depth"), pa.array(paths, pa.list_(pa.string())), size.take(pa.array(at)), column("cycle"), column("hops")]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "parent", "root", "depth", "path", "descendants", "cycle", "hops"])

        if not with_paths:
            for a in range(0, n, 50_000):
                at = np.arange(a, min(n, a + 50_000))
                yield batch(at, [None] * len(at))
            return
        ids, prefix, free = table["id"].to_pylist(), table["prefix"].to_pylist(), table["cycle"].is_null().to_numpy()
        held: list[int] = []
        paths: list[list[str] | None] = []
        entries = 0
        for i in range(n):
            path = None
            if free[i]:
                path, at = [ids[i]], i
                while up[at] >= 0:
                    at = int(up[at])
                    path.append(ids[at])
                path = [*(prefix[at] or ()), *reversed(path)]
                entries += len(path)
            held.append(i)
            paths.append(path)
            if entries > _PATH_BATCH or len(held) >= 50_000:
                yield batch(np.array(held), paths)
                held, paths, entries = [], [], 0
        if held:
            yield batch(np.array(held), paths)

    columns = ["bucket", "id", "parent", "shown", "root", "depth", "cycle", "hops", "more", "settled", *(["prefix"] if with_paths else [])]
    return _per_bucket(rows.select(*columns), work, _OUT)


def nodes(df: DataFrame, identifier: Column | str, parent: Column | str, order: Column | str) -> DataFrame:
    """id, parent (null for roots), place: one row per node."""
    place = F.col(order) if isinstance(order, str) else order
    p = normal(parent)
    rows = df.select(normal(identifier).alias("id"), F.when(is_value(p), p).alias("parent"), place.cast("double").alias("place")).where(is_value(F.col("id")))
    return rows.groupBy("id").agg(F.min("parent").alias("parent"), F.min("place").alias("place"))


def hierarchy(df: DataFrame, identifier: Column | str, parent: Column | str, order: Column | str, with_paths: bool = True, bucket: int = BUCKET) -> DataFrame:
    """id, parent, root, depth, path (root first), descendants, cycle, hops.

    ``order`` only places nodes in buckets; any column gives the same result, one in which parents are near their children the
    least work.
    """
    spark = df.sparkSession
    found, found_path = materialize(nodes(df, identifier, parent, order))
    inner, _ = materialize(_first_pass(found, max(1, -(-found.count() // bucket))))
    drop(spark, found_path)

    # Tops below a node of another bucket, with the top or the cycle that this node leads to.
    above = inner.select(F.col("id").alias("parent"), F.col("top").alias("next"), (F.col("steps") + 1).alias("step"), F.col("cycle").alias("ring"))
    border, _ = materialize(inner.where("top = id and parent is not null").select("id", "parent", F.col("size").alias("weight")).join(above, "parent"))
    solved = _solved(border.select("id", "next", "step", "weight"), bucket, with_paths)
    # Their chains end at a root's or a cycle's own bucket, one more step on.
    ends = border.select(F.col("id").alias("head"), F.col("next").alias("last"), F.col("step").alias("on"), "ring")
    tops, _ = materialize(
        solved.join(ends, "head", "left").select(
            F.col("id").alias("top"), F.col("last").alias("top_root"), (F.col("far") + F.col("on")).alias("top_far"), F.col("ring").alias("top_cycle"), F.col("size").alias("top_size"), F.col("cycle").isNotNull().alias("open"), "chain"
        )
    )
    # Nodes that lead to a cycle across buckets.
    caught = inner.join(tops.where("open").select("top"), "top").select("id", F.col("parent").alias("next"), F.lit(1).cast("long").alias("step"), F.lit(1).cast("long").alias("weight"))
    rings, _ = materialize(_solved(materialize(caught)[0], bucket, False).select("id", F.col("cycle").alias("far_cycle"), F.col("far").alias("far_hops"), F.col("size").alias("settled")))

    hung = border.join(tops.where("not open").select(F.col("top").alias("id"), "top_size"), "id").groupBy(F.col("parent").alias("id")).agg(F.sum("top_size").alias("more"))
    # A top whose parent is no node is a root.
    linked = border.select("id", F.lit(True).alias("linked"))
    rows = inner.join(tops.drop("chain"), "top", "left").join(hung, "id", "left").join(rings, "id", "left").join(linked, "id", "left")
    cycle = F.coalesce("cycle", "far_cycle", "top_cycle")
    hops = F.when(F.col("cycle").isNotNull(), F.col("steps")).when(F.col("far_cycle").isNotNull(), F.col("far_hops")).otherwise(F.col("top_far") + F.col("steps"))
    depth = F.coalesce("top_far", F.lit(0)) + F.col("steps")
    shown = F.when((F.col("top").isNull()) | (F.col("top") != F.col("id")) | F.col("linked"), F.col("parent"))
    rows = rows.select(
        "bucket", "id", "parent", shown.alias("shown"), F.when(cycle.isNull(), F.coalesce("top_root", "top")).alias("root"), F.when(cycle.isNull(), depth).alias("depth"), cycle.alias("_cycle"),
        F.when(cycle.isNotNull(), hops).alias("hops"), F.coalesce("more", F.lit(0)).cast("long").alias("more"), F.coalesce("settled", F.lit(-1)).cast("long").alias("settled"),
    ).withColumnRenamed("_cycle", "cycle")
    if with_paths:
        entries = border.select(F.col("parent").alias("id")).distinct()
        segments, _ = materialize(_segments(inner, entries))
        ways = border.select(F.col("id").alias("x"), F.col("parent").alias("id")).join(segments, "id").select("x", "segment")
        chained = tops.where("not open and top_cycle is null").select(F.col("top").alias("id"), F.posexplode("chain").alias("at", "x")).join(ways, "x")
        prefix = chained.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment"))), lambda s: s["segment"])).alias("prefix"))
        rows = rows.join(prefix, "id", "left")
    return _last_pass(rows, with_paths)


def descendants(tree: DataFrame) -> DataFrame:
    """ancestor, descendant, distance (1 and more) of all nodes that have a path."""
    entries = tree.where(F.col("depth") > 0).select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return entries.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
