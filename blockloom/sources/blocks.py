"""Where new blocks come from: JSON lines in files, in memory or in a table, HTTP endpoints, several of them at once.

A source is asked for the blocks from a number on, with the hash the block before must have. It yields blocks, or a table of
them, or says that its chain forks off and names blocks of its own below.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from blockloom.sources.store import BlockRef

#: Waits in seconds after the first, second, ... failure in a row.
BACKOFF = (0.0, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)


@dataclass(frozen=True)
class Block:
    """A block: its header values and its items by table."""

    body: dict[str, Any]

    @property
    def number(self) -> int:
        return self.body["header"]["number"]

    @property
    def ref(self) -> BlockRef:
        return BlockRef(self.number, self.body["header"]["hash"])

    @property
    def parent_hash(self) -> str:
        return self.body["header"]["parentHash"]

    @property
    def final(self) -> bool:
        return bool(self.body.get("final"))

    def rows(self) -> int:
        return 1 + sum(len(v) for v in self.body.values() if isinstance(v, list))


@dataclass(frozen=True)
class Fork:
    """The source's chain is another one; blocks of it, ascending, below the asked one."""

    previous: tuple[BlockRef, ...]


@dataclass(frozen=True)
class Lines:
    """All blocks from the asked one on as JSON lines (column ``line``), which stay distributed."""

    table: DataFrame


Source = Callable[[int, "str | None"], Iterator["Block | Lines | Fork"]]

#: Fixed value: blocks that a fork names, the highest ones below the asked one.
NAMED = 100


def from_lines(lines: Iterable[str]) -> Source:
    """A source over JSON lines, one block each, in any order; later lines of a number hold."""
    blocks = {b.number: b for b in (Block(json.loads(x)) for x in lines if x.strip())}
    numbers = sorted(blocks)

    def read(first: int, parent: str | None) -> Iterator[Block | Fork]:
        ahead = [n for n in numbers if n >= first]
        other_parent = ahead and blocks[ahead[0]].parent_hash != parent
        other_head = first - 1 in blocks and blocks[first - 1].ref.hash != parent
        if parent is not None and (other_parent or other_head):
            yield Fork(tuple(blocks[n].ref for n in numbers if n < first)[-NAMED:])
            return
        yield from (blocks[n] for n in ahead)

    return read


def from_table(blocks: DataFrame) -> Source:
    """A source over a table of blocks: number, hash, parent_hash and the block as JSON (``line``), a row for each number. Whether its chain forks
    off takes one row on the driver, and a fork the refs that it names; blocks never come there, however many are asked for."""
    refs = blocks.select("number", "hash", "parent_hash")

    def read(first: int, parent: str | None) -> Iterator[Lines | Fork]:
        ahead = F.min(F.when(F.col("number") >= first, F.struct("number", "parent_hash")))
        found = refs.agg(ahead.alias("ahead"), F.max(F.when(F.col("number") == first - 1, F.col("hash"))).alias("below")).first()
        other_parent = found["ahead"] is not None and found["ahead"]["parent_hash"] != parent
        other_head = found["below"] is not None and found["below"] != parent
        if parent is not None and (other_parent or other_head):
            previous = refs.where(F.col("number") < first).orderBy(F.desc("number")).limit(NAMED).collect()
            yield Fork(tuple(BlockRef(r["number"], r["hash"]) for r in reversed(previous)))
        elif found["ahead"] is not None:
            yield Lines(blocks.where(F.col("number") >= first).select("line"))

    return read


def from_http(url: str, timeout: float = 30.0) -> Source:
    """POST <url>/stream with the first block and the parent's hash: 200 lines of blocks, 204 nothing yet, 409 fork."""

    def read(first: int, parent: str | None) -> Iterator[Block | Fork]:
        body = json.dumps({"fromBlock": first, **({"parentBlockHash": parent} if parent else {})}).encode()
        request = urllib.request.Request(f"{url.rstrip('/')}/stream", body, {"content-type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                if answer.status == 204:
                    return
                for line in answer:
                    if line.strip():
                        yield Block(json.loads(line))
        except urllib.error.HTTPError as e:
            if e.code != 409:
                raise
            refs = json.loads(e.read()).get("previousBlocks", [])
            yield Fork(tuple(BlockRef(r["number"], r["hash"]) for r in refs))

    return read


def mapped(source: Source, change: Callable[[Block], Block]) -> Source:
    """Another source with its blocks changed; it must yield them one by one."""

    def read(first: int, parent: str | None) -> Iterator[Block | Fork]:
        for x in source(first, parent):
            if isinstance(x, Lines):
                raise TypeError("blocks of a table can't be changed one by one")
            yield change(x) if isinstance(x, Block) else x

    return read


def linked(source: Source) -> Source:
    """Blocks as long as each links to the one before it and goes up; what doesn't is left out with all after it. The source must yield them one by one."""

    def read(first: int, parent: str | None) -> Iterator[Block | Fork]:
        at, expected = first - 1, parent
        for x in source(first, parent):
            if isinstance(x, Fork):
                yield x
                return
            if isinstance(x, Lines):
                raise TypeError("blocks of a table can't be followed one by one")
            if x.number <= at:
                continue  # repeated
            if expected is not None and x.parent_hash != expected:
                return
            yield x
            at, expected = x.number, x.ref.hash

    return read


#: Fixed value: seconds after which a fork counts that not most sources report, if none has the next block.
PATIENCE = 2.0


def arbitrate(sources: Sequence[Source], pause: Callable[[float], None] = time.sleep, rounds: int = 1, clock: Callable[[], float] = time.monotonic) -> Source:
    """Several sources as one. In fixed order, the first that has the next blocks gives them; a fork counts when most of
    those that answer say so, or some have said so for ``PATIENCE`` while none had the next block; a source that fails waits longer each time."""
    failures: Counter = Counter()
    disputed: dict[tuple[int, str | None], float] = {}

    def read(first: int, parent: str | None) -> Iterator[Block | Fork]:
        at, expected = first, parent
        for _ in range(rounds):
            forks: list[Fork] = []
            active = 0
            for i, source in enumerate(sources):
                try:
                    for x in linked(source)(at, expected):
                        if isinstance(x, Fork):
                            forks.append(x)
                            break
                        at, expected = x.number + 1, x.ref.hash
                        yield x
                    failures[i] = 0
                    active += 1
                except (OSError, ValueError):
                    failures[i] += 1
                    pause(BACKOFF[min(failures[i], len(BACKOFF)) - 1])
            if at == first and forks:
                since = disputed.setdefault((first, parent), clock())
                if 2 * len(forks) > active or clock() - since >= PATIENCE:
                    disputed.clear()
                    yield max(forks, key=lambda f: len(f.previous))
                    return
            else:
                disputed.clear()

    return read


class BlockLines(DataSource):
    """Streaming source ``blocklines``: the lines of JSON-lines files in a folder that all executors share.

    The offset is the bytes read of each file, up to its last whole line, so files may grow, new ones may appear, and a restarted query goes on where its
    checkpoint says. Each file is a partition of its own; the driver only lists the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "blocklines"

    def schema(self) -> str:
        return "line string"

    def streamReader(self, schema):  # noqa: N802
        return _LineReader(self.options)


@dataclass
class _Piece(InputPartition):
    path: str
    start: int
    end: int


class _LineReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]

    @staticmethod
    def _whole_lines(path: str) -> int:
        """The bytes up to the last line end."""
        with open(path, "rb") as file:
            at = file.seek(0, 2)
            while at > 0:
                step = min(at, 1 << 16)
                file.seek(at - step)
                found = file.read(step).rfind(b"\n")
                if found >= 0:
                    return at - step + found + 1
                at -= step
        return 0

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return {p.name: self._whole_lines(str(p)) for p in sorted(Path(self.folder).glob("*.jsonl"))}

    def partitions(self, start, end):
        return [_Piece(str(Path(self.folder) / name), start.get(name, 0), size) for name, size in sorted(end.items()) if size > start.get(name, 0)] or [_Piece("", 0, 0)]

    def read(self, partition):
        if partition.end > partition.start:
            with open(partition.path, "rb") as file:
                file.seek(partition.start)
                at = partition.start
                for line in file:
                    if at >= partition.end:
                        return
                    at += len(line)
                    yield (line.rstrip(b"\r\n").decode(),)

    def commit(self, end) -> None:
        pass
