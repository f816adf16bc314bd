"""Relations: from a set of rows of one table to rows of another (or the same).

Each relation becomes a set of keys of the output table; rows are chosen by existence, never by row numbers. Trees
are encoded as address lists, grouped by the key's other columns. Ancestors of an address are its prefixes, so
both directions are equi-joins on (group, prefix): no pairs within a group are compared, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_of(df: DataFrame, columns: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Distinct keys without nulls; they combine before the shuffle."""
    out = df.select(*[F.col(c).alias(n) for c, n in zip(columns, names or columns)])
    return out.dropna(subset=out.columns).distinct()


def _prefixes(address: Column, strict: bool) -> Column:
    """All prefixes of an address: proper ones (the empty one too), or with the address itself."""
    last = F.size(address) - 1 if strict else F.size(address)
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda n: F.slice(address, F.lit(1), n))


def join(source: DataFrame, source_key: Sequence[str], target_key: Sequence[str]) -> DataFrame:
    """Keys of the output rows that equal a key of the input rows."""
    return keys_of(source, source_key, target_key)


def parents(source: DataFrame, source_key: Sequence[str], target_key: Sequence[str]) -> DataFrame:
    """Keys of ancestors and self of the input rows."""
    given = keys_of(source, source_key, target_key)
    *group, address = target_key
    return given.select(*group, F.explode(_prefixes(F.col(address), strict=False)).alias(address)).distinct()


def _below(target: DataFrame, target_key: Sequence[str], anchors: DataFrame, strict: bool) -> DataFrame:
    *group, address = target_key
    # Most groups have no anchor; only the rest are spread by their prefixes.
    near = keys_of(target, target_key).join(anchors.select(*group).distinct(), group, "left_semi") if group else keys_of(target, target_key)
    placed = near.withColumn("_prefix", F.explode(_prefixes(F.col(address), strict)))
    above = anchors.withColumnRenamed(address, "_prefix")
    return placed.join(above, [*group, "_prefix"], "left_semi").select(*target_key).distinct()


def children(source: DataFrame, target: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of rows strictly below an input row."""
    return _below(target, key, keys_of(source, key), strict=True)


def _anchors(source: DataFrame, source_key: Sequence[str], target: DataFrame, target_key: Sequence[str]) -> DataFrame:
    """Input addresses that occur in the output table exactly."""
    return keys_of(source, source_key, target_key).join(keys_of(target, target_key), list(target_key), "left_semi")


def foreign_children(source: DataFrame, source_key: Sequence[str], target: DataFrame, target_key: Sequence[str]) -> DataFrame:
    """Keys of output rows at or below an input address that the output table has."""
    return _below(target, target_key, _anchors(source, source_key, target, target_key), strict=False)


def foreign_parents(source: DataFrame, source_key: Sequence[str], target: DataFrame, target_key: Sequence[str]) -> DataFrame:
    """Keys of output rows at or above an input address that the output table has."""
    return parents(_anchors(source, source_key, target, target_key), target_key, target_key)


def select_rows(table: DataFrame, predicate: Column | None, key_sets: Sequence[tuple[Sequence[str], DataFrame]]) -> DataFrame:
    """Rows that fulfil the predicate or whose key is in one of the sets: one filter, rows keep their multiplicity.

    A lone key set is a semi-join. Otherwise each set is a left join against distinct keys whose
    mark goes into the filter, which is what an existence join does.
    """
    by_key: dict[tuple[str, ...], DataFrame] = {}
    for key, found in key_sets:
        by_key[tuple(key)] = by_key[tuple(key)].unionByName(found) if tuple(key) in by_key else found
    if predicate is None and len(by_key) == 1:
        key, found = next(iter(by_key.items()))
        return table.join(found, list(key), "left_semi").select(*table.columns)
    out, chosen = table, predicate if predicate is not None else F.lit(False)
    for i, (key, found) in enumerate(by_key.items()):
        names = [f"_rel{i}_{j}" for j in range(len(key))]
        marked = found.select(*[F.col(k).alias(n) for k, n in zip(key, names)]).distinct().withColumn(f"_rel{i}", F.lit(True))
        on = [out[k] == marked[n] for k, n in zip(key, names)]
        out = out.join(marked, on, "left")
        chosen = chosen | F.col(f"_rel{i}").isNotNull()
    return out.where(chosen).select(*[table[c] for c in table.columns])
