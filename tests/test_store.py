import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.dialects import DIALECTS
from blockloom.errors import ItemUnavailable, RangeUnavailable, StoreConflict, TableMissing, UnexpectedBaseBlock
from blockloom.plans.request import parse
from blockloom.sources import store as st
from blockloom.sources.blocks import Block, BlockLines, Fork, arbitrate, from_lines, from_table, linked, mapped
from blockloom.sources.layout import Archive, Chunk
from blockloom.streaming.ingest import Ingest

EVM = DIALECTS["evm"]
SCHEMAS = {
    "blocks": "number long, hash string, parent_hash string",
    "transactions": "block_number long, transaction_index int, hash string, `from` string, `to` string, sighash string",
    "logs": "block_number long, log_index int, transaction_index int, address string, topic0 string, data_size long",
}


def block(n, chain="a", parent=None, final=False):
    txs = [{"transactionIndex": i, "hash": f"t{chain}{n}-{i}", "from": "f", "to": f"to{i}", "sighash": "0xaa"} for i in range(2)]
    logs = [{"logIndex": i, "transactionIndex": i % 2, "address": "x", "topic0": f"top{i}", "dataSize": 1} for i in range(3)]
    return {"header": {"number": n, "hash": f"{chain}{n}", "parentHash": parent if parent is not None else f"{chain}{n - 1}"}, "transactions": txs, "logs": logs, "final": final}


def lines(blocks):
    return [json.dumps(b) for b in blocks]


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/store", EVM.catalog, "evm")


def fill(store, *blocks):
    return Ingest(store, SCHEMAS).apply([Block(b) for b in blocks])


def numbers(store, body=None, **kw):
    query = parse({"type": "evm", "fields": {"block": {"number": True, "hash": True}}, "includeAllBlocks": True, **(body or {})})
    return [json.loads(x)["header"]["hash"] for x in store.stream(query, **kw)]


def test_extend_replace_finalize_retain(spark, store):
    fill(store, *[block(n, parent="" if n == 0 else None) for n in range(3)])
    fill(store, block(3), block(4))
    assert store.head() == st.BlockRef(4, "a4") and numbers(store) == ["a0", "a1", "a2", "a3", "a4"]
    before = store.snapshot()
    with pytest.raises(StoreConflict):
        store.append({"blocks": spark.createDataFrame([(7, "a7", "zz")], SCHEMAS["blocks"])}, "zz")
    fill(store, block(3, "b", "a2"), block(4, "b"), block(5, "b"))
    assert numbers(store) == ["a0", "a1", "a2", "b3", "b4", "b5"]
    # The old version is still whole.
    query = parse({"type": "evm", "fields": {"block": {"hash": True}}, "includeAllBlocks": True})
    assert "a4" in store.query(query, version=before.version).json_array()
    store.finalize(st.BlockRef(2, "a2"))
    assert store.finalized_head() == st.BlockRef(2, "a2") and numbers(store, finalized_only=True) == ["a0", "a1", "a2"]
    store.finalize(st.BlockRef(1, "a1"))
    assert store.finalized_head().number == 2  # never back
    with pytest.raises(StoreConflict):
        store.finalize(st.BlockRef(2, "other"))
    store.finalize(st.BlockRef(99, "later"))
    assert store.finalized_head() == st.BlockRef(5, "b5")  # clamped to the head
    with pytest.raises(StoreConflict):
        fill(store, block(3, "c", "a2"))
    store.retain(from_block=3)
    with pytest.raises(RangeUnavailable):
        store.query(query)
    assert numbers(store, {"fromBlock": 3}) == ["b3", "b4", "b5"]
    assert store.vacuum() > 0 and numbers(store, {"fromBlock": 4}) == ["b4", "b5"]
    assert store.status()["chunks"] == 1 and store.status()["firstBlock"] == 3
    store.reset()
    assert store.head() is None and store.query(query) is None


def test_two_writers(spark, store):
    fill(store, block(0, parent=""))
    m = store.snapshot()
    chunk = store.put({"blocks": spark.createDataFrame([(1, "a1", "a0")], SCHEMAS["blocks"])}, "a0")
    store.commit(m, st.extend(m, chunk))
    with pytest.raises(StoreConflict):
        store.commit(m, st.extend(m, chunk))


def test_chunks_must_link_inside(spark, store):
    with pytest.raises(StoreConflict):
        store.append({"blocks": spark.createDataFrame([(0, "a", ""), (1, "b", "x")], SCHEMAS["blocks"])}, "")
    with pytest.raises(StoreConflict):
        store.append({"blocks": spark.createDataFrame([(0, "a", ""), (1, "b", "a"), (1, "c", "a")], SCHEMAS["blocks"])}, "")
    with pytest.raises(StoreConflict):
        store.append({"blocks": spark.createDataFrame([], SCHEMAS["blocks"])}, "")


def test_compaction_keeps_the_data(spark, store):
    for n in range(5):
        fill(store, block(n, parent="" if n == 0 else None))
    before = numbers(store)
    store.compact()
    assert len(store.snapshot().chunks) == 1 and numbers(store) == before
    assert store.tables().get("logs").count() == 15
    store.compact()
    assert len(store.snapshot().chunks) == 1


def test_compaction_plans():
    chunk = lambda i, rows, kind="int": st.StoredChunk(i, i, f"h{i}", f"h{i - 1}", {"t": ""}, rows, {"t": T.StructType([T.StructField("x", {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}[kind])]).json()})
    plan = lambda *c, **kw: st.compaction(st.Manifest("k", 0, c), **kw)
    assert plan() is None and plan(chunk(1, 5)) is None
    assert plan(chunk(1, 5), chunk(2, 5), chunk(3, 5)) == (0, 3)
    assert plan(chunk(1, 190_000), chunk(2, 5)) is None  # too much work for little
    assert plan(chunk(1, 190_000), chunk(2, 5), chunk(4, 5)) == (0, 2)  # unless the run is over
    assert plan(chunk(1, 150_000), chunk(2, 150_000)) is None  # too large together
    assert plan(chunk(1, 5), chunk(3, 5), chunk(4, 5)) == (1, 3)  # a gap
    assert plan(chunk(1, 5), chunk(2, 6)) is None  # 11 rows are less than 1.9 times 6
    assert plan(chunk(1, 5, "int"), chunk(2, 5, "bigint")) == (0, 2) and plan(chunk(1, 5, "int"), chunk(2, 5, "string")) is None
    assert plan(*[chunk(i, 1) for i in range(80)], most=50) == (0, 50)


def test_schemas_widen(spark, store):
    a, b = T.StructType.fromDDL("x int, y string"), T.StructType.fromDDL("x bigint, y string")
    assert st.merged_schema(a, b) == b and st.merged_schema(a, T.StructType.fromDDL("x int")) is None and st.merged_schema(a, T.StructType.fromDDL("x string, y string")) is None
    store.append({"blocks": spark.createDataFrame([(0, "a0", "")], "number int, hash string, parent_hash string")}, "")
    store.append({"blocks": spark.createDataFrame([(1, "a1", "a0")], "number long, hash string, parent_hash string")}, "a0")
    assert store.tables().get("blocks").schema["number"].dataType == T.LongType() and numbers(store) == ["a0", "a1"]


def test_lookup_availability_and_parent(spark, store):
    fill(store, block(0, parent=""), block(1))
    store.append({"blocks": spark.createDataFrame([(2, "a2", "a1")], SCHEMAS["blocks"])}, "a1")
    assert store.block_by_hash("a1") == st.BlockRef(1, "a1") and store.block_by_hash("zz") is None
    assert store.transaction_by_hash("ta1-1") == (1, 1) and store.transaction_by_hash("zz") is None
    with pytest.raises(ItemUnavailable):
        store.query(parse({"type": "evm", "logs": [{}]}))
    assert store.query(parse({"type": "evm", "toBlock": 1, "logs": [{}]})).items("logs").count() == 6
    assert numbers(store, {"fromBlock": 1, "parentBlockHash": "a0"}) == ["a1", "a2"]
    with pytest.raises(UnexpectedBaseBlock):
        numbers(store, {"fromBlock": 1, "parentBlockHash": "b0"})


def test_streaming_in_batches_is_the_whole(store):
    fill(store, *[block(n, parent="" if n == 0 else None) for n in range(6)])
    body = {"logs": [{"topic0": ["top1"]}], "fields": {"block": {"number": True, "hash": True}, "log": {"topic0": True} if False else {"address": True}}}
    assert numbers(store, body, budget=200) == numbers(store, body) == [f"a{n}" for n in range(6)]


def _model_chain(rng):
    """A random script of growth and forks: what a source says, and the chain that must result."""
    chain, label, tallest = [block(0, "g", "")], 0, 0
    for _ in range(6):
        if rng.random() < 0.4 and len(chain) > 2:
            at = rng.randint(1, len(chain) - 1)
            label += 1
            chain = chain[:at]
            chain.append(block(at, f"f{label}-", chain[-1]["header"]["hash"]))
        tallest = max(tallest, chain[-1]["header"]["number"])
        while chain[-1]["header"]["number"] <= tallest:  # a source's fork is taken up once it is the longer chain
            head = chain[-1]["header"]
            chain.append(block(head["number"] + 1, f"f{label}-", head["hash"]))
        tallest = chain[-1]["header"]["number"]
        yield list(chain)


@pytest.mark.parametrize("seed", [1, 2])
def test_ingest_follows_the_source(store, seed):
    ingest = Ingest(store, SCHEMAS, max_rows=12)
    for chain in _model_chain(random.Random(seed)):
        source = from_lines(lines(chain))
        for _ in range(12):
            if ingest.step(source) == "idle":
                break
        assert numbers(store) == [b["header"]["hash"] for b in chain]


def test_ingest_final_and_retention(store):
    ingest = Ingest(store, SCHEMAS, max_rows=1, keep=3)
    chain = [block(n, parent="" if n == 0 else None, final=n < 3) for n in range(6)]
    while ingest.step(from_lines(lines(chain))) != "idle":
        pass
    assert store.snapshot().first == 3 and store.head().number == 5
    fork = [*chain[:2], block(2, "x", "a1"), block(3, "x"), block(4, "x"), block(5, "x"), block(6, "x")]
    ingest2 = Ingest(store, SCHEMAS)
    store.finalize(st.BlockRef(4, "a4"))
    with pytest.raises(StoreConflict):
        ingest2.step(from_lines(lines(fork)))


def test_structured_streaming(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    chain = [block(n, parent="" if n == 0 else None) for n in range(5)]
    (folder / "a.jsonl").write_text("\n".join(lines(chain[:3])) + "\n")
    spark.dataSource.register(BlockLines)
    ingest = Ingest(store, SCHEMAS)

    def go():
        stream = spark.readStream.format("blocklines").option("path", str(folder)).option("rows", 2).load()
        q = ingest.start(stream, f"file://{tmp_path}/check", available_now=False)
        q.processAllAvailable()
        q.stop()

    go()
    assert numbers(store) == ["a0", "a1", "a2"]
    (folder / "b.jsonl").write_text("\n".join(lines(chain[3:])) + "\n")
    go()
    assert numbers(store) == [f"a{n}" for n in range(5)]
    texts = spark.readStream.text(str(folder)).withColumnRenamed("value", "line")
    q = Ingest(store, SCHEMAS).start(texts, f"file://{tmp_path}/check2")
    q.awaitTermination()
    assert numbers(store) == [f"a{n}" for n in range(5)]  # a repeated delivery changes nothing


def test_a_large_batch_becomes_several_chunks_and_one_commit(store):
    chain = [block(n, parent="" if n == 0 else None, final=n < 7) for n in range(10)]
    before = len(store.versions())
    Ingest(store, SCHEMAS, max_rows=8).apply([Block(b) for b in chain])
    m = store.snapshot()
    assert len(store.versions()) == before + 1 and len(m.chunks) > 2 and m.finalized == st.BlockRef(6, "a6")
    assert [c.first for c in m.chunks[1:]] == [c.last + 1 for c in m.chunks[:-1]]
    assert numbers(store) == [f"a{n}" for n in range(10)]
    with pytest.raises(StoreConflict):  # a broken link anywhere commits nothing
        Ingest(store, SCHEMAS, max_rows=8).apply([Block(b) for b in [block(10), block(11), block(12, parent="zz"), block(13)]])
    assert store.snapshot() == m
    assert store.block_by_hash("a4") == st.BlockRef(4, "a4") and store.block_by_hash("a77") is None


def test_half_of_the_sources_report_a_fork():
    """Not most of them: it counts once they have said so for long enough."""
    chain = [block(n, parent="" if n == 0 else None) for n in range(3)]
    other = [*chain[:2], block(2, "x", "a1")]
    now = [0.0]
    both = arbitrate([from_lines(lines(chain)), from_lines(lines(other))], clock=lambda: now[0])
    assert list(both(3, "a2")) == []
    now[0] = 1.9
    assert list(both(3, "a2")) == []
    now[0] = 2.1
    assert isinstance(next(iter(both(3, "a2"))), Fork)


def test_sources():
    chain = [block(n, parent="" if n == 0 else None) for n in range(4)]
    good, short = from_lines(lines(chain)), from_lines(lines(chain[:2]))
    read = lambda s, first=0, parent=None: [x.number if isinstance(x, Block) else x for x in s(first, parent)]
    assert read(good, 2, "a1") == [2, 3] and isinstance(read(good, 2, "zz")[0], Fork)

    def broken(first, parent):
        raise OSError("down")

    waits: list[float] = []
    both = arbitrate([broken, short, good], waits.append, rounds=3)
    assert read(both) == [0, 1, 2, 3] and waits == [0.0, 0.1, 0.2]
    assert isinstance(read(arbitrate([good, good, short], waits.append), 2, "zz")[0], Fork)
    skipping = from_lines(lines([chain[0], chain[1], block(2, "q", "nowhere")]))
    assert read(linked(skipping)) == [0, 1]
    renamed = mapped(good, lambda b: Block({**b.body, "header": {**b.body["header"], "extra": 1}}))
    assert next(iter(renamed(0, None))).body["header"]["extra"] == 1


def as_table(spark, blocks):
    rows = [(b["header"]["number"], b["header"]["hash"], b["header"]["parentHash"], json.dumps(b)) for b in blocks]
    return from_table(spark.createDataFrame(rows, "number long, hash string, parent_hash string, line string"))


def test_a_table_answers_as_lines_do(spark):
    chain = [block(n, parent="" if n == 0 else None) for n in range(4)] + [block(6, parent="a3")]
    table, listed = as_table(spark, chain), from_lines(lines(chain))

    def read(source, *ask):
        found = list(source(*ask))
        return found if not found or isinstance(found[0], Fork) else [json.loads(r["line"]) for x in found for r in x.table.orderBy("line").collect()] if source is table else [x.body for x in found]

    for ask in [(0, None), (2, "a1"), (2, "zz"), (3, None), (5, "a3"), (5, "zz"), (7, "a6"), (7, "zz"), (9, "zz")]:
        assert read(table, *ask) == read(listed, *ask)
    for change in (linked(table), mapped(table, lambda b: b)):
        with pytest.raises(TypeError):
            list(change(0, None))


def test_ingest_follows_a_table(spark, store):
    ingest = Ingest(store, SCHEMAS, max_rows=12)
    chain = [block(n, parent="" if n == 0 else None) for n in range(6)]
    fork = [*chain[:3], block(3, "b", "a2"), block(4, "b"), block(5, "b")]
    steps = []
    for blocks in (chain, fork):
        source = as_table(spark, blocks)
        steps += [ingest.step(source), ingest.step(source)]
        assert numbers(store) == [b["header"]["hash"] for b in blocks]
    assert steps == ["grown", "idle", "rolled back", "idle"] and len(store.snapshot().chunks) > 2


def test_rollback_points():
    chunk = lambda a, b: st.StoredChunk(a, b, f"h{b}", f"h{a - 1}", {}, 1)
    m = st.Manifest("k", 0, (chunk(0, 4), chunk(5, 9), chunk(10, 14)))
    ref = st.BlockRef
    assert st.rollback_point(m, [ref(9, "h9"), ref(14, "x")]) == ref(9, "h9")
    assert st.rollback_point(m, [ref(9, "x"), ref(4, "h4")]) == ref(4, "h4")
    assert st.rollback_point(m, [ref(12, "x")]) == ref(9, "h9")  # unknown below: to be tried
    assert st.rollback_point(m, [ref(4, "x"), ref(0, "y")]) is None
    final = st.finalize(m, ref(9, "h9"))
    with pytest.raises(StoreConflict):
        st.rollback_point(final, [ref(9, "x"), ref(4, "h4")])


def test_archive(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/arc", per_top=2)
    tables = lambda a, b: {"blocks": spark.createDataFrame([(n, f"h{n}") for n in range(a, b)], "number long, hash string"), "logs": spark.createDataFrame([(n, 0, t) for n in range(a, b) for t in ("z", None, "b")], "block_number long, log_index int, topic0 string")}
    for a in (0, 10, 20):
        archive.write(tables(a, a + 10), a, a + 9, f"0xabcdef012{a}", {"logs": ["topic0", "block_number"]}, index=True)
    found = list(archive.chunks())
    assert [c.path for c in found] == ["0000000000/0000000000-0000000009-abcdef01", "0000000000/0000000010-0000000019-abcdef01", "0000000020/0000000020-0000000029-abcdef01"]
    assert [c.first for c in archive.chunks(12, 19)] == [10] and [c.first for c in archive.chunks(reverse=True)] == [20, 10, 0]
    assert Chunk.parse("0000000000", "0000000010-0000000009-ab") is None and Chunk.parse("0000000000", "12-13-ab") is None
    t = archive.tables(["blocks", "logs"], 10, 15)
    assert t.get("blocks").count() == 10
    first = archive.tables(["logs"], 0, 5).get("logs").orderBy("_idx").collect()
    assert [r["topic0"] for r in first] == ["b"] * 10 + ["z"] * 10 + [None] * 10 and [r["_idx"] for r in first] == list(range(30))
    assert archive.tables(["logs"], 0, 5).get("logs").where(F.col("topic0").isNull()).count() == 10
    with pytest.raises(TableMissing):
        archive.tables(["logs"], 99)
    with pytest.raises(OSError):
        archive.write(tables(0, 10), 0, 9, "0xabcdef0120")


def test_physical_options(spark, tmp_path):
    """Row groups by rows, columns without dictionary, filters: as asked, and the rows are the same."""
    import pyarrow.parquet as pq

    from blockloom.sources.layout import write_table

    df = spark.range(10_000).select("id", F.concat(F.lit("h"), F.col("id")).alias("hash"), (F.col("id") % 7).cast("string").alias("kind"))
    write_table(df, f"file://{tmp_path}/t", ["id"], partitions=1, group_rows=1000, plain=["hash"], bloom=["hash"], level=5)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert len(files) == 1 and max(g.num_rows for g in groups) <= 1000 and sum(g.num_rows for g in groups) == 10_000
    column = {groups[0].column(i).path_in_schema: groups[0].column(i) for i in range(3)}
    assert column["kind"].has_dictionary_page and not column["hash"].has_dictionary_page and column["id"].compression == "ZSTD"
    assert spark.read.parquet(f"file://{tmp_path}/t").where("hash = 'h77'").collect() == df.where("id = 77").collect()
