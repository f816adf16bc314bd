"""Queries do their whole job: nothing of the tables is cut before it."""

import json
from collections import Counter

from pyspark.sql import functions as F

from blockloom import blockqueries, storequeries
from blockloom.sources.store import Store


def test_compaction_stores_and_trims_the_whole_table(spark, root, monkeypatch):
    seen = {}

    class Watched(Store):
        def retain(self, *args, **kw):
            before = self.snapshot()
            seen["stored"], seen["before"] = self.tables(before).get("logs").count(), [(c.first, c.last) for c in before.chunks]
            after = super().retain(*args, **kw)
            seen["after"] = [(c.first, c.last) for c in after.chunks]
            return after

    monkeypatch.setattr(storequeries, "Store", Watched)
    logs, lo, mid, hi = storequeries._logs(spark, root)
    got = {r["block_number"]: (r["n"], r["chunks"]) for r in storequeries.store_compaction(spark, root).collect()}
    assert seen == {"stored": logs.count(), "before": [(lo, mid - 1), (mid, hi)], "after": [(mid, hi)]}
    wanted = logs.where(F.col("block_number") >= mid).groupBy("block_number").count().collect()
    assert got == {r["block_number"]: (r["count"], 1) for r in wanted}


def _broken(rows):
    """The definition spelled out over a list of distinct headers."""
    number = {}
    for n, h, _ in rows:
        number[h] = max(n, number.get(h, n))
    children, same, first = Counter(p for _, _, p in rows), Counter(n for n, _, _ in rows), min(n for n, _, _ in rows)
    unlinked = lambda n, p: n > first and not (p in number and number[p] < n)
    return sorted((n, h, p) for n, h, p in rows if unlinked(n, p) or same[n] > 1 or (p in number and children[p] > 1))


def test_continuity_looks_at_every_header(spark, root, tmp_path):
    rows = [(1, "a", "x"), (2, "b", "a"), (2, "c ", "A"), (2, "C", "a"), (3, "d", "c"), (4, "e", "d"), (5, "f", "gone")]
    spark.createDataFrame(rows, "number long, hash string, parent_hash string").withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).write.parquet(f"{tmp_path}/hl_blocks.parquet")
    spark.read.parquet(f"{root}/fills.parquet").limit(0).write.parquet(f"{tmp_path}/fills.parquet")
    got = sorted(tuple(r) for r in blockqueries.continuity_check(spark, str(tmp_path)).collect())
    assert got == [(2, "b", "a"), (2, "c", "a"), (5, "f", "gone")]
    table = spark.read.parquet(f"{root}/hl_blocks.parquet").where("number is not null")
    every = {(r[0], r[1] and r[1].strip(" ").lower(), r[2] and r[2].strip(" ").lower()) for r in table.select("number", "hash", "parent_hash").collect()}
    assert sorted(tuple(r) for r in blockqueries.continuity_check(spark, root).collect()) == _broken(every)


def test_solana_blocks_have_every_transaction(spark):
    """All of sf0.1 weighs less than the standard budget."""
    root = "/root/testdata/sf0.1"
    got = {r["number"]: len(json.loads(r["json"])["transactions"]) for r in blockqueries.solana_blocks(spark, root).collect()}
    stored = spark.read.parquet(f"{root}/sol_transactions.parquet").groupBy("block_number").count()
    assert got == {r["block_number"]: r["count"] for r in stored.collect()}


def test_flagship_and_companions_have_the_standard_budget(spark):
    """All that the flagship selects of sf0.1 weighs less than the standard budget; budget_cut still cuts."""
    root = "/root/testdata/sf0.1"
    e = blockqueries.run(spark, root, blockqueries.evm, blockqueries._BODY)
    numbers = lambda df: sorted(r["number"] for r in df.select("number").collect())
    picked = numbers(e.block_weights())
    got = {r["number"]: json.loads(r["json"]) for r in blockqueries.multi_request_budget(spark, root).collect()}
    assert sorted(got) == picked
    for name in ("transactions", "logs"):
        assert sum(len(x.get(name, [])) for x in got.values()) == e.selected(name).count()
    assert numbers(blockqueries.header_boundaries(spark, root)) == picked
    assert numbers(blockqueries.include_all_blocks(spark, root)) == numbers(e.table("blocks"))
    assert 0 < blockqueries.budget_cut(spark, root).count() < e.selected("logs").count()


def test_rolled_back_ingest_leaves_blocks_off_the_driver(spark, root, monkeypatch):
    """What comes to the driver are refs and ends of chunks, never the lines of blocks."""
    seen, kind = [], type(spark.range(1))
    for name in ("collect", "toLocalIterator"):

        def watched(self, *args, plain=getattr(kind, name), **kw):
            rows = list(plain(self, *args, **kw))
            seen.extend(rows)
            return rows

        monkeypatch.setattr(kind, name, watched)
    found = storequeries.rolled_back_ingest(spark, root)
    monkeypatch.undo()
    logs, lo, mid, hi = storequeries._logs(spark, root)
    wanted = logs.where((F.col("block_number") < mid) | F.col("topic0").isNotNull())
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
    assert seen and not [r for r in seen if "logIndex" in str(r)]
