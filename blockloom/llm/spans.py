"""Problem 10: long exact spans that records share, verbatim and by code points.

Method: seed and extend. Texts are winnowed: of every window of ``window`` consecutive k-grams all places of the least
hash are anchors, with k + window - 1 = length; what is chosen inside a span depends on the span alone, so two texts that share
a span of the least length have an anchor at the same place of it. Texts are joined on anchors; anchors of two or more
different texts are extended both ways by what stands within window - 1 characters of them, which decides about the least length.

Extension is done for whole classes, never for pairs. All that a class (the texts round one anchor) has in common to the left and to
the right is what its least and greatest contexts have in common, so two minima and two maxima per class, combined on the map side,
give its maximal repeat. Texts that go on alike beyond it form smaller classes, told apart by the next character on either side;
those are extended in the same way, and what may still differ inside them is settled by the exact content of each span of the
least length. The result is a table of classes (equal content, two or more texts) and of members (class, text, start, end).

What keeps hot spans (boilerplate, templates) from growing quadratically: exact copies are one text from the start; a hot class is
a few minima and maxima and one row per text; coverage and repeats need no pairs. Where pairs are asked for, they come from one
class per set of texts (told by count, XOR and sum of text hashes); no class is capped.

Defined results: null, empty and short texts share nothing; copies of a text share all of it; a text that
repeats a span only within itself shares nothing; every text is read whole, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.session import drop, materialize

LENGTH, WINDOW = 200, 51
#: Code points hashed at a time; longer texts are cut into overlapping pieces with the same result.
_PIECE = 1 << 20
#: An odd multiplier of the polynomial hash, and of the mixing steps.
_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        chain = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)])
        _powers[:] = chain(_BASE), chain(pow(_BASE, -1, 1 << 64))
    return _powers[0][:n], _powers[1][:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram, of its content only."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(len(codes))
    total = np.r_[np.uint64(0), np.cumsum(_mixed(codes + np.uint64(_BASE)) * up, dtype=np.uint64)]
    return _mixed((total[k:] - total[:-k]) * down[:n])


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """min or max of each window, by doubling."""
    done, have = values, 1
    while have * 2 <= width:
        done, have = of(done[: len(done) - have], done[have:]), have * 2
    rest = width - have
    return of(done[: len(done) - rest], done[rest:]) if rest else done


def winnow(hashes: np.ndarray, window: int, whole: np.ndarray | None = None) -> np.ndarray:
    """Places of the least hash of any window. ``whole``: which windows (by first place) count, otherwise all."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(hashes, window, np.minimum)
    if whole is not None:
        least = np.where(whole, least, np.uint64(0))
    pad = np.zeros(window - 1, dtype=hashes.dtype)
    best = _sliding(np.r_[pad, least, pad], window, np.maximum)
    return np.flatnonzero((hashes == best) & (best > 0))


def _pieces(texts: Sequence[str], length: int) -> Iterator[list[tuple[int, int, str]]]:
    """Lists of (number of the text, offset, piece) of at most ``_PIECE`` code points; a piece overlaps the next by twice the length."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - 2 * length), _PIECE):
            piece = text[at : at + _PIECE + 2 * length]
            if held and size + len(piece) > _PIECE + 2 * length:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def anchors(texts: Sequence[str], length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, hash, place) of every anchor of some texts, each once, sorted by text, hash and place."""
    k = length - window + 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for held in _pieces([t if len(t) >= length else "" for t in texts], length):
        sizes = np.array([len(p) for _, _, p in held])
        hashes = gram_hashes(code_points("".join(p for _, _, p in held)), k)
        ends = np.cumsum(sizes)
        windows = max(0, len(hashes) - window + 1)
        # A window counts where it ends within the piece that it begins in.
        whole = np.zeros(windows + 1, dtype=np.int32)
        fits = sizes >= length
        np.add.at(whole, (ends - sizes)[fits], 1)
        np.add.at(whole, (ends - length + 1)[fits], -1)
        at = winnow(hashes, window, np.cumsum(whole)[:windows] > 0)
        piece = np.searchsorted(ends, at, side="right")
        place = at - (ends - sizes)[piece] + np.array([o for _, o, _ in held], dtype=np.int64)[piece]
        found.append((np.array([i for i, _, _ in held], dtype=np.int64)[piece], hashes[at], place))
    if not found:
        return (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    number, value, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, value, number))
    number, value, place = number[order], value[order], place[order]
    first = np.r_[True, (number[1:] != number[:-1]) | (value[1:] != value[:-1]) | (place[1:] != place[:-1])][: len(number)]
    return number[first], value[first], place[first]


def distinct_texts(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts of at least ``length`` code points: (rep, copies, text), one row per class, and
    (id, rep), one row per document. A copied text passes the shuffle once per map task."""
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.length("text") >= length)
    keyed = rows.withColumn("_key", F.concat(F.md5("text"), F.length("text").cast("string")))
    classes = keyed.groupBy("_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    stored, _ = materialize(classes)
    members, _ = materialize(keyed.select("id", "_key").join(stored.select("_key", "rep"), "_key").select("id", "rep"))
    return stored.drop("_key"), members


def _anchored(texts: DataFrame, length: int, window: int) -> DataFrame:
    """rep, anchor, ats: the anchors of each text with all their places, one row per text and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, value, place = anchors(batch.column(1).to_pylist(), length, window)
            first = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (value[1:] != value[:-1])][: len(number)])
            ats = pa.ListArray.from_arrays(pa.array(np.r_[first, len(number)].astype(np.int32)), pa.array(place.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(number[first])), pa.array(value[first].view(np.int64)), ats], names=["rep", "anchor", "ats"])

    return texts.select("rep", "text").mapInArrow(run, "rep long, anchor long, ats array<int>")


def _contexts(seeded: DataFrame, k: int, reach: int) -> DataFrame:
    """node, rep, copies, left (backwards), right, ats: what stands round the shared anchors of each text; ``node`` is a 128-bit hash of
    the anchor's content. Places with equal surroundings are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("node", pa.binary()), ("rep", pa.int64()), ("copies", pa.int64()), ("left", pa.string()), ("right", pa.string()), ("ats", pa.list_(pa.int32()))])
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for rep, copies, text, seeds in zip(*(batch.column(i).to_pylist() for i in range(4))):
                around: dict[tuple[str, str, str], list[int]] = {}
                for at in sorted(x for places in seeds for x in places):
                    left = text[max(0, at - reach) : at]
                    around.setdefault((text[at : at + k], left[::-1], text[at + k : at + k + reach]), []).append(at)
                for (anchor, left, right), ats in around.items():
                    node = hashlib.blake2b(anchor.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    for column, x in zip(out, (node, rep, copies, left, right, ats)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds)], schema=kinds)

    return seeded.select("rep", "copies", "text", "seeds").mapInArrow(run, "node binary, rep long, copies long, left string, right string, ats array<int>")


def _common(low: Column, high: Column, reach: int) -> Column:
    """The number of characters that the least and the greatest text of a set, and so all its texts, begin with."""
    same = F.filter(F.sequence(F.lit(1), F.lit(reach)), lambda i: F.substring(low, F.lit(1), i) == F.substring(high, F.lit(1), i))
    return F.least(F.size(same), F.length(low), F.length(high))


def _extended(rows: DataFrame, reach: int) -> DataFrame:
    """The rows of nodes with two or more texts, with ``l`` and ``r``: how far all of a node goes on alike, and ``rows``."""
    ends = [of(c).alias(f"_{of.__name__}_{c}") for c in ("rep", "left", "right") for of in (F.min, F.max)]
    nodes = rows.groupBy("node").agg(*ends, F.count(F.lit(1)).alias("rows")).where("_min_rep < _max_rep")
    nodes = nodes.select("node", "rows", *[_common(F.col(f"_min_{c}"), F.col(f"_max_{c}"), reach).alias(x) for c, x in (("left", "l"), ("right", "r"))])
    return rows.join(nodes, "node")


_MEMBER = ("class", "rep", "copies", "l", "r", "ats")


def _id(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def shared_spans(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """class, rep, copies, start, end, ats: classes of texts that hold the same span of at least ``length``; the span lies at
    [at - l, at + r) for each of ``ats``. Every span of the least length that two texts share lies within one of a class of both."""
    k, reach = length - window + 1, window - 1
    spark = texts.sparkSession
    found, found_path = materialize(_anchored(texts, length, window))
    # Written, so that their sizes are known when they are joined: where they are small, neither anchors nor texts are shuffled.
    shared, shared_path = materialize(found.groupBy("anchor").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo < _hi").select("anchor"))
    seeds, seeds_path = materialize(found.join(shared, "anchor").groupBy("rep").agg(F.collect_list("ats").alias("seeds")))
    contexts, contexts_path = materialize(_contexts(texts.join(seeds, "rep"), k, reach))
    for path in (found_path, shared_path, seeds_path):
        drop(spark, path)
    first, _ = materialize(_extended(contexts, reach))
    drop(spark, contexts_path)
    enough = F.col("l") + F.col("r") >= reach
    # What goes on alike beyond the common part differs from it in the next character on one side. Two rows have nothing beyond.
    more = first.where("rows > 2")
    node = F.hex("node")
    right = more.where("length(right) > r").withColumn("node", _id(node, F.lit("r"), F.substring("right", F.lit(1), F.col("r") + 1)))
    left = more.where("length(left) > l").withColumn("node", _id(node, F.lit("l"), F.substring("left", F.lit(1), F.col("l") + 1)))
    second, _ = materialize(_extended(right.unionByName(left).drop("l", "r", "rows"), reach))
    # What may still differ: each span of the least length round the anchor, by its content.
    at = F.explode(F.sequence(F.greatest(F.lit(0), F.lit(reach) - F.length("right")), F.least(F.lit(reach), F.length("left"))))
    rest = second.where("rows > 2").where(F.length("left") + F.length("right") >= reach).withColumn("_a", at)
    rest = rest.where((F.col("_a") > F.col("l")) | (F.lit(reach) - F.col("_a") > F.col("r")))
    rest = rest.select(_id(node, F.col("_a").cast("string"), F.lit(":"), F.substring("left", F.lit(1), F.col("_a")), F.lit("|"), F.substring("right", F.lit(1), F.lit(reach) - F.col("_a"))).alias("class"), "rep", "copies", F.col("_a").alias("l"), (F.lit(reach) - F.col("_a")).alias("r"), "ats")
    several = rest.groupBy("class").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo < _hi").select("class")
    out = rest.join(several, "class").select(*_MEMBER)
    for level in (first, second):
        out = out.unionByName(level.where(enough).withColumnRenamed("node", "class").select(*_MEMBER))
    return out.select("class", "rep", "copies", "l", (F.col("r") + k).alias("r"), "ats")


def text_sets(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, n_texts, n_documents, sign): one row per class of spans, ``sign`` telling its set of texts; and (class, rep), its texts."""
    held = spans.groupBy("class", "rep").agg(F.first("copies").alias("copies"))
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("rep", F.lit(1)), 24)).alias("s"))
    return held.groupBy("class").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("n_documents"), sign.alias("sign")), held.select("class", "rep")


def shared_pairs(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id_a < doc_id_b: all pairs of documents whose texts share a span of at least ``length`` code points."""
    texts, members = distinct_texts(df, id_column, text_column, length)
    spans, _ = materialize(shared_spans(texts, length, window).select("class", "rep", "copies"))
    classes, held = text_sets(spans)
    one_each = classes.groupBy("sign").agg(F.min("class").alias("class")).select("class")
    ends, _ = materialize(held.join(one_each, "class"))
    pairs = ends.select("class", F.col("rep").alias("rep_a")).join(ends.select("class", F.col("rep").alias("rep_b")), "class").where("rep_a < rep_b").select("rep_a", "rep_b").distinct()
    docs_a, docs_b = (members.select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    between = pairs.join(docs_a, "rep_a").join(docs_b, "rep_b").select("id_a", "id_b")
    copied = texts.where("copies > 1").select(F.col("rep").alias("rep_a"))
    inside = docs_a.join(copied, "rep_a", "left_semi").join(docs_b, F.col("rep_a") == F.col("rep_b")).where("id_a < id_b").select("id_a", "id_b")
    both = between.unionByName(inside)
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b"))


def _places(spans: DataFrame, *also: str) -> DataFrame:
    at = spans.select("rep", "l", "r", *also, F.explode("ats").alias("_at"))
    return at.select("rep", (F.col("_at") - F.col("l")).alias("start"), (F.col("_at") + F.col("r")).alias("end"), *also)


def covered_stretches(texts: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """rep, start, end: the maximal stretches of each text that are covered by spans found in another text."""
    places = _places(shared_spans(texts, length, window)).groupBy("rep", "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(W.partitionBy("rep").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    breaks = places.withColumn("_new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    numbered = breaks.withColumn("_no", F.sum("_new").over(W.partitionBy("rep").orderBy("start")))
    return numbered.groupBy("rep", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_no")


def coverage(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, shared_chars, n_spans, longest for every document, of its covered stretches; zeros where nothing is shared."""
    texts, members = distinct_texts(df, id_column, text_column, length)
    merged = covered_stretches(texts, length, window).groupBy("rep").agg(F.sum(F.col("end") - F.col("start")).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max(F.col("end") - F.col("start")).alias("_max"))
    size = F.length("text").cast("long")
    copied = F.col("copies") > 1
    per_text = texts.join(merged, "rep", "left").select(
        "rep",
        F.when(copied, size).otherwise(F.coalesce("_sum", F.lit(0))).cast("long").alias("shared_chars"),
        F.when(copied, 1).otherwise(F.coalesce("_n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, size).otherwise(F.coalesce("_max", F.lit(0))).cast("long").alias("longest"),
    )
    found = members.join(per_text, "rep").drop("rep")
    every = df.select(F.col(id_column).alias("id"), F.coalesce(F.length(text_column), F.lit(0)).cast("long").alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(found, "id", "left").select(F.col("id").alias("doc_id"), "n_chars", zero("shared_chars"), zero("n_spans"), zero("longest"))


def _runs(rows: DataFrame, length: int) -> DataFrame:
    """rep, start, end, n: stretches whose spans of the least length are all held by the same documents. A text's rows are as many as it has
    anchors at most times the ways they go on, so a task holds one text's."""

    def of(text: list[tuple[int, int, int, object]], size: int, copies: int) -> Iterator[tuple[int, int, int]]:
        best = np.full(size - length + 1, -1, dtype=np.int64)
        signs: dict[object, int] = {}
        counts: list[int] = []
        for start, end, n, sign in sorted(text, key=lambda x: x[2]):  # a span's own documents are those of its largest class
            if sign not in signs:
                signs[sign] = len(counts)
                counts.append(n)
            best[start : end - length + 1] = signs[sign]
        edges = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        for a, b in zip(edges.tolist(), np.r_[edges[1:], len(best)].tolist()):
            n = copies if best[a] < 0 else counts[best[a]]
            if n > 1:
                yield a, b - 1 + length, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "start", "end", "n"]
        now, held, about = None, [], (0, 0)
        out: list[tuple[int, int, int, int]] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=names)
        for batch in batches:
            for rep, size, copies, start, end, n, sign in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if rep != now:
                    if now is not None:
                        out += [(now, *x) for x in of(held, *about)]
                    now, held, about = rep, [], (size, copies)
                if start is not None:
                    held.append((start, end, n, tuple(sign.values())))
            if len(out) > 50_000:
                yield packed()
                out = []
        if now is not None:
            out += [(now, *x) for x in of(held, *about)]
        if out:
            yield packed()

    return rows.repartition("rep").sortWithinPartitions("rep").mapInArrow(run, "rep long, start int, end int, n long")


def repeats(df: DataFrame, id_column: str, text_column: str, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, start, end (code points, from 0), n_docs: the maximal repeats of each document, that is its longest stretches all of whose spans
    of ``length`` occur in the same n_docs documents, two or more."""
    texts, members = distinct_texts(df, id_column, text_column, length)
    spans, _ = materialize(shared_spans(texts, length, window))
    classes, _ = text_sets(spans)
    places = _places(spans.join(classes.select("class", F.col("n_documents").alias("n"), "sign"), "class"), "n", "sign").distinct()
    sized = texts.select("rep", F.length("text").alias("size"), "copies").join(places, "rep", "left").where("copies > 1 or start is not null")
    runs = _runs(sized.select("rep", "size", "copies", "start", "end", "n", "sign"), length)
    return members.join(runs, "rep").select(F.col("id").alias("doc_id"), "start", "end", F.col("n").alias("n_docs"))
