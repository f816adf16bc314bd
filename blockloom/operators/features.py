"""Problem 5: one row per entity with count, latest time and total of each of hundreds of event types.

Method: types are encoded as indices of a sorted list. An entity's state is a sparse vector: for each
type index it has, the count, total and latest time. Vectors merge entry by entry (counts and totals add, the
later time stays), so partial tables of files or days combine. They are built by one aggregation per (entity, type), which
combines on the map side and splits a hot entity over its types; only sparse entries, never events, are gathered per
entity, at most one per type. Columns are made from the vectors at the very end, in Arrow batches, each cell by its place.

The number of columns is bounded by an error (``most``), as a table can't have any number of them; ``entries_by_name`` gives the same
content in rows, for any number of types.

Defined results: null and blank entities have no row; null and blank types are the type ``none``; types equal
but for case, outer blanks and runs of blanks, hyphens or underscores are one; null and NaN values are missing: they count as events
but add nothing, and a total without any value is null; a type an entity lacks has count 0 and null time and total; exact copies of an
event (same key and content) count once where ``key`` is given; an empty table gives no rows. Where ``types`` is given, events of other
types are left out, and an entity that has no other events has no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.session import materialize

MAX_TYPES = 5000
#: Cells of the table that a task makes at a time.
_CELLS = 2_000_000


def type_name(column: Column | str) -> Column:
    """The type that a spelling stands for."""
    raw = F.col(column) if isinstance(column, str) else column
    name = F.lower(F.trim(F.regexp_replace(raw, r"[\s_\-]+", " ")))
    return F.when(name.isNull() | (name == ""), "none").otherwise(name)


def events(df: DataFrame, entity: Column, kind: Column, time: Column, value: Column, key: Sequence[str] = ()) -> DataFrame:
    """entity, kind, time, value; copies once where there is a key."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    rows = df.select(*own, entity.alias("entity"), kind.alias("kind"), time.alias("time"), F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("value"))
    rows = rows.where(F.col("entity").isNotNull() & (F.col("entity") != ""))
    return (rows.distinct() if key else rows).select("entity", "kind", "time", "value")


def _bounded(kinds: DataFrame, most: int) -> list[str]:
    names = [r[0] for r in kinds.distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} types; raise the bound, map them to fewer, or take entries_by_name")
    return sorted(names)


def type_list(df: DataFrame, kind: Column, most: int = MAX_TYPES) -> list[str]:
    """The sorted type names; the driver holds them, so their number is bounded by an error, not by dropping any."""
    return _bounded(df.select(kind.alias("kind")), most)


def entries_by_name(rows: DataFrame) -> DataFrame:
    """entity, kind, n, total, last: the sparse vectors in rows, by type name."""
    return rows.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("time").alias("last"))


def numbered(named: DataFrame, types: Sequence[str]) -> DataFrame:
    """entity, type_no, n, total, last, of the types in the list alone. The list is bounded, so it may be broadcast."""
    numbers = named.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.lit(list(types)).cast("array<string>")).alias("type_no", "kind"))
    return named.join(F.broadcast(numbers), "kind").select("entity", "type_no", "n", "total", "last")


def entries(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """The sparse vectors in rows: entity, type_no, n, total, last."""
    return numbered(entries_by_name(rows), types)


def merge(parts: DataFrame) -> DataFrame:
    """Entries of any union of partial tables that share a type list."""
    return parts.groupBy("entity", "type_no").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("last").alias("last"))


def vectors(parts: DataFrame) -> DataFrame:
    """entity, vector: the entries (type_no, n, total, last) of each entity."""
    return parts.groupBy("entity").agg(F.collect_list(F.struct("type_no", "n", "total", "last")).alias("vector"))


def expand(vectored: DataFrame, types: Sequence[str], digits: int = 6) -> DataFrame:
    """entity and three columns per type: ``<type>_n``, ``<type>_total``, ``<type>_last``."""
    last = vectored.schema["vector"].dataType.elementType["last"].dataType
    fields = [vectored.schema["entity"]]
    for name in types:
        fields += [T.StructField(f"{name}_n", T.LongType()), T.StructField(f"{name}_total", T.DoubleType()), T.StructField(f"{name}_last", last)]
    width, names = len(types), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, _CELLS // max(1, width))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                rows, vector = batch.num_rows, batch.column(1)
                offsets = vector.offsets.to_numpy()
                kind, *values = vector.values.slice(offsets[0], offsets[-1] - offsets[0]).flatten()
                # The entry of each (type, entity), -1 where there is none.
                entry = np.full(width * rows, -1, dtype=np.int64)
                entry[kind.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(rows), np.diff(offsets))] = np.arange(len(kind))
                columns = [batch.column(0)]
                for own in entry.reshape(width, rows):
                    at = pa.array(own, mask=own < 0)
                    n, total, time = (v.take(at) for v in values)
                    columns += [n.fill_null(0), total, time]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    total = F.transform("vector", lambda x: F.struct(x["type_no"].alias("type_no"), x["n"].alias("n"), F.round(x["total"], digits).alias("total"), x["last"].alias("last")))
    return vectored.select("entity", total.alias("vector")).mapInArrow(run, T.StructType(fields))


def feature_table(df: DataFrame, entity: Column, kind: Column, time: Column, value: Column, key: Sequence[str] = (), types: Sequence[str] | None = None, most: int = MAX_TYPES) -> DataFrame:
    """The whole of it; ``types`` fixes the columns, otherwise they are those that occur among events of an entity."""
    named = entries_by_name(events(df, entity, kind, time, value, key))
    if types is None:
        named, _ = materialize(named)  # read for the types and for the table
        types = _bounded(named.select("kind"), most)
    types = list(dict.fromkeys(types))
    return expand(vectors(numbered(named, types)), types)
