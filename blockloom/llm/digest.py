"""Problem 7: percentiles of very large numeric columns with mergeable dyadic digests.

Method: a double is quantised to its upper 32 bits in numeric order (sign, exponent, 20 bits of
mantissa: relative step 2^-20). Counts live on the nodes of the dyadic tree over these 2^32 cells (heap
numbers: root 1, children 2v and 2v + 1). Compression moves two siblings into their parent wherever the
three together hold no more than n / k. Digests merge by adding the counts of equal nodes. Every
inner node of any merge of digests holds at most n / k, so a percentile's rank is off by at most 32 n / k,
deterministically: ``error`` fixes k = 32 / error.

Partial digests are built in the map tasks (Arrow batches, numpy over all groups at once), so a group that
holds a third of all rows reaches the shuffle as bounded digests. Node counts are added with a map-side
combine; compression first runs by subtree (sign, exponent and two bits), then over what is left, so no task
gets an unbounded group.

Defined results: null and NaN are missing; infinities are values; -0.0 equals 0.0; null group values form
a group; a group or table without values gives no rows; rows count as stored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.session import materialize

DEPTH = 32
SUBTREE = 14
ERROR = 0.01
_BUFFER = 400_000


def quantise(values: np.ndarray) -> np.ndarray:
    """Cell numbers in [0, 2^32), in the order of the values."""
    bits = (np.asarray(values, dtype=np.float64) + 0.0).view(np.int64)
    ordered = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return (ordered >> 32) + np.int64(1 << 31)


def cell_value(cells: np.ndarray) -> np.ndarray:
    """The value of a cell with the least magnitude for positive numbers: exact where 20 bits of mantissa suffice."""
    ordered = (np.asarray(cells, dtype=np.int64) - np.int64(1 << 31)) << 32
    bits = np.where(ordered < 0, (ordered | np.int64(0xFFFFFFFF)) ^ np.int64(0x7FFFFFFFFFFFFFFF), ordered)
    return bits.view(np.float64)


def add(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal nodes of a group become one; sorted by group and node."""
    if not len(node):
        return group, node, count
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (node[1:] != node[:-1])])
    return group[first], node[first], np.add.reduceat(count, first)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray, top: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bottom-up compression of all groups at once; ``limit``: n / k rounded down, by group number.
    Nodes at depth ``top`` and above stay where they are."""
    group, node, count = add(group, node, count)
    depth = np.frexp(node.astype(np.float64))[1] - 1
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(group[depth <= top], node[depth <= top], count[depth <= top])]
    rising = (group[:0], node[:0], count[:0])
    for level in range(DEPTH, top, -1):
        here = depth == level
        g, v, c = add(*(np.concatenate(x) for x in zip((group[here], node[here], count[here]), rising)))
        above = depth == level - 1
        pg, pv, pc = group[above], node[above], count[above]
        parent = v >> 1
        if not len(v):
            rising = (g, v, c)
            continue
        # Sums of siblings, then the parent's own count, found by searching the sorted parents of this level.
        first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (parent[1:] != parent[:-1])])
        sums = np.add.reduceat(c, first)
        own = np.zeros(len(first), dtype=np.int64)
        if len(pv):
            key, wanted = pg * (np.int64(1) << 33) + pv, g[first] * (np.int64(1) << 33) + parent[first]
            at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            own = np.where(key[at] == wanted, pc[at], 0)
        small = sums + own <= limit[g[first]]
        size = np.diff(np.r_[first, len(v)])
        stays = np.repeat(~small, size)
        kept.append((g[stays], v[stays], c[stays]))
        rising = (g[first][small], parent[first][small], sums[small])
    kept.append(rising)
    return add(*(np.concatenate(x) for x in zip(*kept)))


class _Groups:
    """Numbers for the combinations of key values met in a partition."""

    def __init__(self, width: int) -> None:
        self.width, self.numbers, self.values = width, {}, []

    def of(self, batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
        codes, tables = np.zeros(batch.num_rows, dtype=np.int64), []
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k)).dictionary_encode()
            values = [*column.dictionary.to_pylist(), None]
            index = column.indices.fill_null(len(values) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = codes * len(values) + index
            tables.append(values)
        found, inverse = np.unique(codes, return_inverse=True)
        numbers = np.empty(len(found), dtype=np.int64)
        for i, code in enumerate(found.tolist()):
            parts = []
            for values in reversed(tables):
                code, at = divmod(code, len(values))
                parts.append(values[at])
            key = tuple(reversed(parts))
            if key not in self.numbers:
                self.numbers[key] = len(self.values)
                self.values.append(key)
            numbers[i] = self.numbers[key]
        return numbers[inverse]


def _emit(groups: _Groups, schema: pa.Schema, keys: Sequence[str], group: np.ndarray, node: np.ndarray, count: np.ndarray, step: int = 50_000) -> Iterator[pa.RecordBatch]:
    values = [pa.array([v[j] for v in groups.values], type=schema.field(k).type) for j, k in enumerate(keys)]
    for at in range(0, len(node), step):
        g = pa.array(group[at : at + step])
        columns = [v.take(g) for v in values]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(node[at : at + step]), pa.array(count[at : at + step])], schema=schema)


def _arrow_schema(df: DataFrame, keys: Sequence[str]) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])
    return kind, to_arrow_schema(kind)


def partial_digests(df: DataFrame, keys: Sequence[str], fields: Sequence[str], error: float = ERROR) -> DataFrame:
    """keys, field, node, n: digests of the rows that each map task saw."""
    wide = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in fields])
    spark_kind, arrow_kind = _arrow_schema(wide.withColumn("field", F.lit("")), [*keys, "field"])
    k = int(np.ceil(DEPTH / error))
    keys, fields, names = list(keys), list(fields), [*keys, "field"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = _Groups(len(names)), []
        size = 0

        def pressed():
            g, v, c = add(*(np.concatenate(x) for x in zip(*held)))
            n = np.bincount(g, weights=c, minlength=len(groups.values)).astype(np.int64)
            return compress(g, v, c, n // k)

        for batch in batches:
            base = groups_of(batch)
            for f, field in enumerate(fields):
                values = batch.column(batch.schema.get_field_index(field)).to_numpy(zero_copy_only=False)
                real = ~np.isnan(values.astype(np.float64))
                if not real.any():
                    continue
                local, at = np.unique(base[0][real], return_inverse=True)
                numbers = np.array([number_of(groups, (*base[1][i], field)) for i in local.tolist()], dtype=np.int64)
                g = numbers[at]
                node = quantise(values[real]) + np.int64(1 << DEPTH)
                held.append(add(g, node, np.ones(len(g), dtype=np.int64)))
                size += len(held[-1][1])
            if size > _BUFFER:
                held = [pressed()]
                size = len(held[0][1])
                if size > _BUFFER // 2:  # very many groups: pass their digests on rather than hold them
                    yield from _emit(groups, arrow_kind, names, *held[0])
                    groups, held, size = _Groups(len(names)), [], 0
        if held:
            yield from _emit(groups, arrow_kind, names, *pressed())

    def groups_of(batch: pa.RecordBatch):
        own = _Groups(len(keys))
        if not keys:
            return np.zeros(batch.num_rows, dtype=np.int64), [()]
        return own.of(batch, keys), own.values

    def number_of(groups: _Groups, key: tuple) -> int:
        if key not in groups.numbers:
            groups.numbers[key] = len(groups.values)
            groups.values.append(key)
        return groups.numbers[key]

    return wide.mapInArrow(run, spark_kind)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the keys, cut only between groups: as many groups at a time as fill the buffer, or a single larger one."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size > _BUFFER:
            rows = joined()
            numbers = _Groups(len(keys)).of(rows, keys)
            cut = int(np.flatnonzero(numbers == numbers[-1])[0])
            if cut:
                yield rows.slice(0, cut)
            held = [rows.slice(cut)]
            size = rows.num_rows - cut
    if held:
        yield joined()


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False).astype(np.int64)


def _compressed(nodes: DataFrame, names: list[str], k: int, top: int, parts: Sequence[str] = ()) -> DataFrame:
    """Compression of whole groups (or of their ``parts``, where only nodes below depth ``top`` move); ``total`` is the group's n. A task
    holds one group at a time, or as many small ones as fill its buffer."""
    spark_kind, arrow_kind = _arrow_schema(nodes, names)
    keys = [*names, *parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, keys):
            groups = _Groups(len(names))
            g = groups.of(batch, names)
            first, at = np.unique(g, return_index=True)
            limit = np.zeros(len(groups.values), dtype=np.int64)
            limit[first] = _numbers(batch, "total")[at] // k
            yield from _emit(groups, arrow_kind, names, *compress(g, _numbers(batch, "node"), _numbers(batch, "n"), limit, top))

    return nodes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, spark_kind)


def merge(parts: DataFrame, keys: Sequence[str], error: float = ERROR) -> DataFrame:
    """Digests of the groups of ``keys`` from any union of partial digests: keys, field, node, n."""
    names, k = [*keys, "field"], int(np.ceil(DEPTH / error))
    nodes, _ = materialize(parts.groupBy(*names, "node").agg(F.sum("n").alias("n")))  # read twice; map tasks with Python aren't reused
    totals = nodes.groupBy(*names).agg(F.sum("n").alias("total"))

    def with_total(df: DataFrame) -> DataFrame:
        renamed = totals.select(*[F.col(c).alias(f"_{c}") for c in names], "total")
        on = [df[c].eqNullSafe(renamed[f"_{c}"]) for c in names]
        return df.join(renamed, on).drop(*[f"_{c}" for c in names])

    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    # log2 of a 33-bit integer is exact enough except right at powers of two, where either side is a fine subtree.
    subtree = F.when(level > SUBTREE, F.expr(f"shiftright(node, greatest(0, cast(floor(log2(cast(node as double))) as int) - {SUBTREE}))")).otherwise(F.lit(0))
    fine = _compressed(with_total(nodes).withColumn("_subtree", subtree), names, k, SUBTREE, ["_subtree"])
    return _compressed(with_total(fine), names, k, 0)


def percentiles(digests: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """keys, field, n and a column per wanted share (0.5 gives p50). A digest is small, and a task holds some whole ones at a time."""
    names = [*keys, "field"]
    labels = ["p" + f"{100 * q:g}".replace(".", "_") for q in at]
    wanted = np.array(at, dtype=np.float64)
    fields = [*[digests.schema[c] for c in names], T.StructField("n", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in labels]]
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_kind = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow_kind = to_arrow_schema(spark_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, names):
            groups = _Groups(len(names))
            g, v, c = groups.of(batch, names), _numbers(batch, "node"), _numbers(batch, "n")
            down = DEPTH + 1 - np.frexp(v.astype(np.float64))[1]
            last = ((v + 1) << down) - 1 - (np.int64(1) << DEPTH)  # a node's last cell
            order = np.lexsort((down, last, g))
            g, c, last = g[order], c[order], last[order]
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            ends = np.r_[starts[1:], len(g)]
            rows, totals, results = [], [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                total = np.cumsum(c[s:e])
                pick = np.searchsorted(total, np.maximum(1, np.ceil(wanted * total[-1])))
                rows.append(int(g[s]))
                totals.append(int(total[-1]))
                results.append(cell_value(last[s:e][np.minimum(pick, e - s - 1)]))
            keyed = [pa.array([groups.values[i][j] for i in rows], type=arrow_kind.field(x).type) for j, x in enumerate(names)]
            columns = [pa.array([float(r[i]) for r in results]) for i in range(len(labels))]
            yield pa.RecordBatch.from_arrays([*keyed, pa.array(totals, type=pa.int64()), *columns], schema=arrow_kind)

    return digests.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, spark_kind)
