"""The archive layout: one directory per chunk, named by its block range, below a top directory.

``{top:010}/{first:010}-{last:010}-{hash}``: ranges are read off the names, so a query's range prunes directories
before any file is opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.errors import TableMissing
from blockloom.plans.execute import Tables
from blockloom.session import materialize
from blockloom.sources.files import Files

_NAME = re.compile(r"^(\d{10,})-(\d{10,})-([0-9A-Za-z]{1,8})$")


@dataclass(frozen=True, order=True)
class Chunk:
    first: int
    last: int
    hash: str
    top: int

    @property
    def path(self) -> str:
        return f"{self.top:010}/{self.first:010}-{self.last:010}-{self.hash}"

    @classmethod
    def parse(cls, top: str, name: str) -> Chunk | None:
        """None where the name isn't the canonical one of a chunk."""
        m = _NAME.match(name)
        if not m or not top.isdigit():
            return None
        chunk = cls(int(m[1]), int(m[2]), m[3], int(top))
        return chunk if chunk.first <= chunk.last and chunk.top <= chunk.first and chunk.path == f"{top}/{name}" else None


def short_hash(block_hash: str) -> str:
    """The part of a block's hash that chunk names carry."""
    plain = block_hash[2:] if block_hash.startswith("0x") else block_hash
    return plain[:8]


class Archive:
    """Chunks below a root directory."""

    def __init__(self, spark: SparkSession, root: str, per_top: int = 500) -> None:
        self.spark, self.files, self.per_top = spark, Files(spark, root), per_top

    def chunks(self, first: int = 0, last: int | None = None, reverse: bool = False) -> Iterator[Chunk]:
        """Chunks that touch the range, in order; top directories outside it aren't listed."""
        tops = [t for t in self.files.names() if t.isdigit()]
        keep = [t for i, t in enumerate(tops) if (last is None or int(t) <= last) and (i + 1 == len(tops) or int(tops[i + 1]) > first)]
        for top in reversed(keep) if reverse else keep:
            found = sorted(c for c in (Chunk.parse(top, n) for n in self.files.names(top)) if c and c.last >= first and (last is None or c.first <= last))
            yield from reversed(found) if reverse else found

    def next_top(self, first: int) -> int:
        tops = [t for t in self.files.names() if t.isdigit()]
        below = [t for t in tops if int(t) <= first]
        return int(below[-1]) if below and len(self.files.names(below[-1])) < self.per_top else first

    def write(self, tables: Mapping[str, DataFrame], first: int, last: int, block_hash: str, sort_keys: Mapping[str, list[str]] | None = None, index: bool = False) -> Chunk:
        """Write a chunk; it appears under its name only when all tables are there, blocks last."""
        chunk = Chunk(first, last, short_hash(block_hash), self.next_top(first))
        temporary = f"temp-{chunk.first}-{chunk.last}-{chunk.hash}"
        self.files.delete(temporary)
        for name in sorted(tables, key=lambda n: n == "blocks"):
            write_table(tables[name], f"{self.files.root}/{temporary}/{name}.parquet", (sort_keys or {}).get(name, []), index and name != "blocks")
        self.files.fs.mkdirs(self.files.path(f"{chunk.top:010}"))
        if self.files.exists(chunk.path) or not self.files.rename(temporary, chunk.path):
            self.files.delete(temporary)
            raise OSError(f"chunk {chunk.path} can't be put in place")
        return chunk

    def tables(self, names: list[str], first: int = 0, last: int | None = None) -> Tables:
        """The tables over all chunks of a range; a table that no chunk has is missing, an absent one in some chunk is empty there."""
        chunks = list(self.chunks(first, last))
        frames = {}
        for name in names:
            paths = [f"{self.files.root}/{c.path}/{name}.parquet" for c in chunks if self.files.exists(f"{c.path}/{name}.parquet")]
            if paths:
                frames[name] = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        if not frames:
            raise TableMissing(names[0])
        return Tables(frames)


def write_table(
    df: DataFrame,
    path: str,
    sort_key: list[str],
    index: bool = False,
    partitions: int | None = None,
    group_rows: int | None = None,
    plain: Sequence[str] = (),
    bloom: Sequence[str] = (),
    level: int | None = None,
) -> None:
    """Parquet with zstd, sorted by the key with nulls last: range-partitioned first, so files are disjoint in the key
    and its statistics prune; ``index`` adds the row's position in that order.

    ``group_rows``: the most rows of a row group, so that statistics prune inside files too. ``plain``: columns without a dictionary;
    ``bloom``: columns with a Bloom filter. ``level``: of compression."""
    if sort_key:
        order = [F.col(c).asc_nulls_last() for c in sort_key]
        df = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
        if index:
            df = _positions(df, order)
    options = {"compression": "zstd"}
    if group_rows is not None:
        options |= {"parquet.block.row.count.limit": str(group_rows), "parquet.page.size.row.check.min": str(min(group_rows, 100))}
    if level is not None:
        options["parquet.compression.codec.zstd.level"] = str(level)
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in plain}
    options |= {f"parquet.bloom.filter.enabled#{c}": "true" for c in bloom}
    df.write.options(**options).parquet(path)


def _positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """``_idx``: the position in the order. Ranges are written with their number once, as another run might cut them
    differently; then rows are numbered within ranges and shifted by the sizes of the ranges before."""
    placed, _ = materialize(df.withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    shifts = sizes.select("_p", before.alias("_before"))
    within = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    numbered = placed.withColumn("_within", within).join(F.broadcast(shifts), "_p")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_within") - 1).cast("int").alias("_idx"))
