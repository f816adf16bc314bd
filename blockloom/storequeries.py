"""Registered queries of the chunk store and of ingest: whole tables go in by chunks, forks and streams, and come out of a snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.catalog import Catalog, TableDef
from blockloom.dialects import DIALECTS
from blockloom.errors import ColumnMissing, TableMissing
from blockloom.operators.predicates import Eq
from blockloom.plans.execute import Execution, Tables
from blockloom.plans.plan import PlanBuilder
from blockloom.plans.request import parse
from blockloom.session import drop, materialize, shared_folder
from blockloom.sources.blocks import from_table
from blockloom.sources.layout import Archive
from blockloom.sources.sinks import flat_rows, write_lines
from blockloom.sources.store import BlockRef, Store
from blockloom.sources.tables import load
from blockloom.streaming.ingest import Ingest
from blockloom.streaming.retention import Follower

_LOGS = ("block_number", "log_index", "transaction_index", "address", "topic0")
_SCHEMAS = {"blocks": "number long, hash string, parent_hash string", "logs": "block_number long, log_index int, transaction_index int, address string, topic0 string"}


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/blockloom-{what}-{uuid.uuid4().hex}"


def _store(spark: SparkSession) -> Store:
    return Store(spark, _folder(spark, "store"), DIALECTS["evm"].catalog, "evm")


def _logs(spark: SparkSession, root: str) -> tuple[DataFrame, int, int, int]:
    """Distinct logs with the first, middle and last block."""
    logs = load(spark, root, "evm_logs").select(*_LOGS)
    lo, hi = logs.agg(F.min("block_number"), F.max("block_number")).first()
    return logs.distinct(), lo, None if lo is None else lo + (hi - lo) // 2, hi


def _header(n: Column, fork_at: int | None = None) -> list[Column]:
    """A block's number, hash and parent's hash, made from its number; from ``fork_at`` on they are of another chain."""
    name = lambda n: F.concat(F.lit("h") if fork_at is None else F.when(n >= fork_at, "g").otherwise("h"), n.cast("string"))
    return [n.alias("number"), name(n).alias("hash"), name(n - 1).alias("parent_hash")]


def _chunk(spark: SparkSession, logs: DataFrame, first: int, last: int, fork_at: int | None = None) -> dict[str, DataFrame]:
    """All blocks of a range, linked by hashes made from their numbers; from ``fork_at`` on they are of another chain."""
    blocks = spark.range(first, last + 1).select(*_header(F.col("id"), fork_at))
    return {"blocks": blocks, "logs": logs.where(F.col("block_number").between(first, last))}


def store_fork_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Two chunks; the first becomes final, the second is replaced by a fork that lacks logs without topic0."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs.withColumn("snapshot", F.lit("now"))
    store = _store(spark)
    store.append(_chunk(spark, logs, lo, mid - 1), f"h{lo - 1}")
    old = store.append(_chunk(spark, logs, mid, hi), f"h{mid - 1}")
    store.finalize(BlockRef(mid - 1, f"h{mid - 1}"))
    store.fork(_chunk(spark, logs.where("topic0 is not null"), mid, hi, mid), f"h{mid - 1}")
    kept = store.tables().get("logs").select(*_LOGS, F.lit("now").alias("snapshot"))
    return kept.unionByName(store.tables(store.snapshot(old.version)).get("logs").select(*_LOGS, F.lit("before").alias("snapshot")))


def _append_merged(spark: SparkSession, store: Store, logs: DataFrame, first: int, last: int) -> None:
    """A range of blocks appended as four chunks or, where it is shorter, as many as it has blocks; then these are merged."""
    step = max(1, (last + 1 - first) // 4)
    edges = list(range(first, last + 1, step))[:4]
    for at, after in zip(edges, [*edges[1:], last + 1]):
        store.append(_chunk(spark, logs, at, after - 1), f"h{at - 1}")
    if edges:
        store.compact(target=1 << 40, amplification=1, horizon=len(edges))  # all of them, however uneven


def store_compaction(spark: SparkSession, root: str) -> DataFrame:
    """Four chunks of each half of the blocks merged into one, then all trimmed to the later half: blocks with their number of logs."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs.groupBy("block_number").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("chunks"))
    store = _store(spark)
    for first, last in ((lo, mid - 1), (mid, hi)):
        _append_merged(spark, store, logs, first, last)
    store.retain(from_block=mid)
    store.vacuum()
    return store.tables().get("logs").groupBy("block_number").agg(F.count(F.lit(1)).alias("n"), F.lit(len(store.snapshot().chunks)).alias("chunks"))


def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Blocks as JSON lines in two deliveries, the second with the first one's last block again, by Structured Streaming into a store."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs
    store, folder = _store(spark), _folder(spark, "lines")
    ingest = Ingest(store, _SCHEMAS)
    item = F.struct(F.col("log_index").alias("logIndex"), F.col("transaction_index").alias("transactionIndex"), "address", "topic0")
    per_block = logs.groupBy("block_number").agg(F.collect_list(item).alias("logs"))
    for first, last in ((lo, mid), (mid, hi)):
        blocks = _chunk(spark, logs, first, last)["blocks"]
        header = F.struct("number", "hash", F.col("parent_hash").alias("parentHash")).alias("header")
        rows = blocks.join(per_block, blocks["number"] == per_block["block_number"], "left")
        rows.select(F.to_json(F.struct(header, F.array_sort(F.coalesce("logs", F.array().cast(per_block.schema["logs"].dataType))).alias("logs"))).alias("value")).write.mode("append").text(f"{folder}/in")
        lines = spark.readStream.text(f"{folder}/in").withColumnRenamed("value", "line")
        ingest.start(lines, f"{folder}/check").awaitTermination()
    return store.tables().get("logs").select(*_LOGS)


def transaction_by_hash(spark: SparkSession, root: str) -> DataFrame:
    """All transactions stored in two chunks; the greatest and the least hash looked up by the chunks' side tables of hashes."""
    kept = load(spark, root, "evm_transactions").select("block_number", "transaction_index", "hash").distinct()
    lo, hi, least, greatest = kept.agg(F.min("block_number"), F.max("block_number"), F.min("hash"), F.max("hash")).first()
    found = []
    if lo is not None:
        store, mid = _store(spark), lo + (hi - lo) // 2
        for first, last in ((lo, mid), (mid + 1, hi)):
            if first <= last:
                tables = {"blocks": _chunk(spark, kept, first, last)["blocks"], "transactions": kept.where(F.col("block_number").between(first, last))}
                store.append(tables, f"h{first - 1}")
        found = [(h, *store.transaction_by_hash(h)) for h in (least, greatest)]
    return spark.createDataFrame(found, "hash string, block_number long, transaction_index long")


#: The blocks that the fork below replaces.
FORKED = (700000400, 700000599)


def fork_replace_union(spark: SparkSession, root: str) -> DataFrame:
    """Fills per block after some blocks were replaced by a chunk without fills, and the blocks after them came again on top of it."""
    table = load(spark, root, "fills").select("block_number", "fill_index")
    lo, hi = table.agg(F.min("block_number"), F.max("block_number")).first()
    store = Store(spark, _folder(spark, "store"), DIALECTS["hyperliquidFills"].catalog, "hyperliquidFills")
    if lo is None:
        return table.groupBy("block_number").agg(F.count(F.lit(1)).alias("n"))

    def chunk(first: int, last: int, fork_at: int | None, kept: bool = True) -> dict[str, DataFrame]:
        return {"blocks": _chunk(spark, table, first, last, fork_at)["blocks"], "fills": table.where(F.col("block_number").between(first, last) & F.lit(kept))}

    before, forked, after = (lo, min(hi, FORKED[0] - 1)), (max(lo, FORKED[0]), min(hi, FORKED[1])), (max(lo, FORKED[1] + 1), hi)
    for first, last in (before, forked, after):
        if first <= last:
            store.append(chunk(first, last, None), f"h{first - 1}")
    if forked[0] <= forked[1]:
        store.fork(chunk(*forked, forked[0], kept=False), f"h{forked[0] - 1}")
        if after[0] <= after[1]:
            store.append(chunk(*after, forked[0]), f"g{after[0] - 1}")
    return store.tables().get("fills").groupBy("block_number").agg(F.count(F.lit(1)).alias("n"))


def store_stream(spark: SparkSession, root: str) -> DataFrame:
    """All final records of a query, batch by batch within a small budget, as a reader of the store gets them: blocks with their number of logs."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return spark.createDataFrame([], "number long, n long")
    store = _store(spark)
    store.append(_chunk(spark, logs, lo, mid - 1), f"h{lo - 1}") if lo < mid else None
    store.append(_chunk(spark, logs, mid, hi), f"h{mid - 1}", final=BlockRef(mid, f"h{mid}"))
    query = parse({"type": "evm", "fromBlock": lo, "fields": {"block": {"number": True}, "log": {"logIndex": True}}, "logs": [{}]})
    total = store.query(query, finalized_only=True).block_weights().agg(F.sum("weight")).first()[0]
    found = [json.loads(x) for x in store.stream(query, finalized_only=True, budget=max(1, total // 3))]
    return spark.createDataFrame([(x["header"]["number"], len(x.get("logs", []))) for x in found], "number long, n long")


def retention(spark: SparkSession, root: str) -> DataFrame:
    """Logs per block after a follower's height, then a number of blocks to keep, dropped old chunks."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs.groupBy("block_number").agg(F.count(F.lit(1)).alias("n"))
    store = _store(spark)
    edges = sorted({lo, *(lo + (hi + 1 - lo) * i // 4 for i in range(4)), hi + 1})
    for first, after in zip(edges, edges[1:]):
        store.append(_chunk(spark, logs, first, after - 1), f"h{first - 1}")
    Follower({"logs": store}, lambda: (10.0, {"logs": edges[1]}), lambda: 11.0).step()
    store.retain(keep=hi + 1 - mid)
    return store.tables().get("logs").where(F.col("block_number") >= mid).groupBy("block_number").agg(F.count(F.lit(1)).alias("n"))


def rolled_back_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Blocks pulled from a source whose chain then forks off in the middle: the common part stays, the rest is replaced."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs
    item = F.struct(F.col("log_index").alias("logIndex"), F.col("transaction_index").alias("transactionIndex"), "address", "topic0")
    # Copies go with the grouping, so that logs are shuffled once.
    per_block = load(spark, root, "evm_logs").groupBy("block_number").agg(F.array_sort(F.collect_set(item)).alias("logs"))
    every = spark.range(lo, hi + 1).join(per_block, F.col("id") == F.col("block_number"), "left")
    held, path = materialize(every.select(F.col("id").alias("number"), F.coalesce("logs", F.array().cast(per_block.schema["logs"].dataType)).alias("logs")))

    def source(fork_at: int | None):
        kept = F.col("logs")
        if fork_at is not None:  # the other chain lacks logs without a topic
            kept = F.when(F.col("number") < fork_at, kept).otherwise(F.filter(kept, lambda x: x["topic0"].isNotNull()))
        blocks = held.select(*_header(F.col("number"), fork_at), kept.alias("logs"))
        header = F.struct("number", "hash", F.col("parent_hash").alias("parentHash")).alias("header")
        return from_table(blocks.select("number", "hash", "parent_hash", F.to_json(F.struct(header, "logs")).alias("line")))

    try:
        store = _store(spark)
        ingest = Ingest(store, _SCHEMAS, max_rows=max(2, held.agg(F.sum(F.size("logs"))).first()[0] // 3))
        for chain in (source(None), source(mid)):
            while ingest.step(chain) != "idle":
                pass
    finally:
        drop(spark, path)
    return store.tables().get("logs").select(*_LOGS)


def schema_widening(spark: SparkSession, root: str) -> DataFrame:
    """Chunks whose index columns have two widths are merged into one of the wider type."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs
    store = _store(spark)
    narrow = logs.withColumn("log_index", F.col("log_index").cast("int"))
    wide = logs.withColumn("log_index", F.col("log_index").cast("long"))
    for first, last, df in ((lo, mid - 1, narrow), (mid, hi, wide)):
        if first <= last:
            store.append(_chunk(spark, df, first, last), f"h{first - 1}")
    store.compact(target=1 << 40, amplification=1)
    out = store.tables().get("logs")
    return out.select(*_LOGS, F.lit(len(store.snapshot().chunks)).alias("chunks"), F.lit(out.schema["log_index"].dataType.simpleString()).alias("kind"))


def archive_range(spark: SparkSession, root: str) -> DataFrame:
    """Logs written as four archive chunks in two directories, sorted with their position; a range that touches two chunks is read back."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return logs.withColumn("_idx", F.lit(0))
    archive = Archive(spark, _folder(spark, "archive"), per_top=2)
    edges = sorted({lo, *(lo + (hi + 1 - lo) * i // 4 for i in range(4)), hi + 1})
    for first, after in zip(edges, edges[1:]):
        archive.write(_chunk(spark, logs, first, after - 1), first, after - 1, f"0xabc{first}", {"logs": ["topic0", "block_number", "log_index"]}, index=True)
    first, last = edges[1], edges[min(3, len(edges) - 1)] - 1
    return archive.tables(["logs"], first, last).get("logs").select(*_LOGS, "_idx")


def json_lines_written(spark: SparkSession, root: str) -> DataFrame:
    """Records of a query as gzipped JSON lines, and each header as a flat row with explicit nulls; read back as counts per block."""
    logs, lo, mid, hi = _logs(spark, root)
    if lo is None:
        return spark.createDataFrame([], "number long, n long, header string")
    tables = _chunk(spark, logs, lo, hi)
    query = parse({"type": "evm", "fromBlock": lo, "fields": {"block": {"number": True}, "log": {"logIndex": True}}, "logs": [{}]})
    path = _folder(spark, "out")
    write_lines(Execution(query.compile(), Tables(tables)), path)
    n = F.get_json_object("value", "$.header.number").cast("long").alias("number")
    counted = spark.read.text(path).select(n, F.coalesce(F.json_array_length(F.get_json_object("value", "$.logs")), F.lit(0)).cast("long").alias("n"))
    flat = flat_rows(tables["blocks"].select("number", F.lit(None).cast("string").alias("none"))).select(F.get_json_object("json", "$.number").cast("long").alias("number"), F.col("json").alias("header"))
    return counted.join(flat, "number")


def missing_columns(spark: SparkSession, root: str) -> DataFrame:
    """A declared column that a file lacks reads as null; one that isn't declared is an error, and so is a missing table."""
    logs = load(spark, root, "evm_logs").select("block_number", "log_index", "address")
    catalog = Catalog([TableDef("blocks", ("number",)), TableDef("logs", ("block_number", "log_index"), defaults={"late": "string"}), TableDef("other", ("block_number", "i"))])
    builder = PlanBuilder(catalog)
    builder.request("logs", Eq("address", "none"), [])
    builder.request("logs", None, [])
    execution = Execution(builder.build(), Tables({"blocks": logs.select(F.col("block_number").alias("number")).distinct(), "logs": logs}))
    errors = []
    for ask in (lambda: execution.require("logs", logs, ["topic9"]), lambda: execution.table("other")):
        try:
            ask()
        except (ColumnMissing, TableMissing) as e:
            errors.append(str(e))
    return execution.selected("logs").select("block_number", "log_index", "late", F.lit("; ".join(errors)).alias("errors"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (store_fork_snapshot, store_compaction, stream_ingest, transaction_by_hash, fork_replace_union, store_stream, retention, rolled_back_ingest, schema_widening, archive_range, json_lines_written, missing_columns)}

_COLUMNS = ", ".join(_LOGS)
_ALL = f"WITH l AS (SELECT DISTINCT {_COLUMNS} FROM evm_logs), m AS (SELECT min(block_number) + (max(block_number) - min(block_number)) // 2 AS mid FROM l)"
SQL: dict[str, str] = {
    "store_fork_snapshot": f"{_ALL} SELECT {_COLUMNS}, 'before' AS snapshot FROM l UNION ALL SELECT {_COLUMNS}, 'now' FROM l, m WHERE block_number < mid OR topic0 IS NOT NULL",
    "store_compaction": f"{_ALL} SELECT block_number, count(*) AS n, 1 AS chunks FROM l, m WHERE block_number >= mid GROUP BY 1",
    "transaction_by_hash": "SELECT DISTINCT hash, block_number, CAST(transaction_index AS BIGINT) AS transaction_index FROM evm_transactions WHERE hash IN (SELECT min(hash) FROM evm_transactions UNION ALL SELECT max(hash) FROM evm_transactions)",
    "fork_replace_union": f"SELECT block_number, count(*) AS n FROM fills WHERE block_number NOT BETWEEN {FORKED[0]} AND {FORKED[1]} GROUP BY 1",
    "stream_ingest": f"{_ALL} SELECT {_COLUMNS} FROM l",
    "store_stream": f"{_ALL}, e AS (SELECT min(block_number) AS lo, max(mid) AS hi FROM l, m), c AS (SELECT block_number AS number, count(*) AS n FROM l, e WHERE block_number <= hi GROUP BY 1), b AS (SELECT lo AS number FROM e UNION SELECT hi FROM e UNION SELECT number FROM c) SELECT b.number, coalesce(n, 0) AS n FROM b LEFT JOIN c ON c.number = b.number",
    "retention": f"{_ALL} SELECT block_number, count(*) AS n FROM l, m WHERE block_number >= mid GROUP BY 1",
    "rolled_back_ingest": f"{_ALL} SELECT {_COLUMNS} FROM l, m WHERE block_number < mid OR topic0 IS NOT NULL",
    "schema_widening": f"{_ALL} SELECT {_COLUMNS}, 1 AS chunks, 'bigint' AS kind FROM l",
    "archive_range": f"""{_ALL}, e AS (SELECT min(block_number) AS lo, max(block_number) + 1 - min(block_number) AS w FROM l), c AS (SELECT l.*, CASE WHEN block_number >= lo + w * 3 // 4 THEN 3 WHEN block_number >= lo + w * 2 // 4 THEN 2 WHEN block_number >= lo + w // 4 THEN 1 ELSE 0 END AS chunk FROM l, e)
        SELECT {_COLUMNS}, CAST(row_number() OVER (PARTITION BY chunk ORDER BY topic0 NULLS LAST, block_number, log_index) - 1 AS INTEGER) AS _idx FROM c QUALIFY chunk IN (1, 2)""",
    "json_lines_written": f"""{_ALL}, e AS (SELECT min(block_number) AS lo, max(block_number) AS hi FROM l), c AS (SELECT block_number AS number, count(*) AS n FROM l GROUP BY 1) SELECT number, n, '{{"number":' || number || ',"none":null}}' AS header FROM c""",
    "missing_columns": "SELECT block_number, log_index, CAST(NULL AS VARCHAR) AS late, 'column ''topic9'' is not found in ''logs''; table ''other'' does not exist' AS errors FROM evm_logs",
}
