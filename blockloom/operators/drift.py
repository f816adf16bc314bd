"""Problem 4: schemas that drift between the files of a feed.

Method: similarity flooding. The schema of a file is a graph of names, types and nesting: an element per dotted
path, linked to its JSON type, to the object it lies in, and to the words of its name. For two consecutive files the
pairs of equally linked nodes form a propagation graph; scores start from the likeness of names and from the values of the records
that both files hold, and flow along it until they converge. From the scores one-to-one correspondences are selected
among the names that are gone and new and that no shared record contradicts: first those with agreeing values, then, where no record says
anything, pairs that are each other's best. A change is called a rename where values agree (the exact check of the
definition); the united table follows all correspondences. What is left over was removed or added.
Names that correspond within a feed form one canonical field; its values are cast to one type and all files unite in one table.

Scale: lines are parsed once, in Arrow batches. Per file only names and types are gathered, per pair of files only
counts of values (agreeing, and not null), both combined on the map side; so one file may hold a third of all rows. Flooding
runs per pair of files, spread over all tasks, on sizes that follow the schema, not the rows. What the driver holds is the list of names
that correspond, bounded by an error.

Defined results: lines that aren't one complete JSON object are ignored; a field that is null in a record counts as
absent there when values are compared, but as a name of the file; repeated records of a file count by their first line; file numbers may
have holes (the file before is the next smaller one); in the united table a record held by several files takes each field from the last file
that has a value, and values that can't be cast become null there and are listed by ``uncastable``; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.session import materialize

NAMES = 20_000


def json_type(value: object) -> str | None:
    """The JSON type of a value; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "fraction"
    return "list" if isinstance(value, list) else "string"


def leaves(record: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """(dotted path, value) of all values that are not objects."""
    for name, value in record.items():
        if isinstance(value, dict):
            yield from leaves(value, f"{prefix}{name}.")
        else:
            yield f"{prefix}{name}", value


def _no_json(word: str) -> None:
    raise ValueError(f"{word} is not JSON")


_canonical = json.JSONEncoder(ensure_ascii=False).encode
#: Kind and canonical JSON of a value by its type.
_WRITERS = {
    str: ("string", json.encoder.encode_basestring), bool: ("boolean", lambda v: "true" if v else "false"), int: ("integer", int.__repr__),
    float: ("fraction", _canonical), list: ("list", _canonical),
}


def parse(df: DataFrame, feed: str, file_no: str, line_no: str, payload: str, keys: Sequence[Sequence[str]]) -> DataFrame:
    """feed, file_no, line_no, rec, fields: one row per complete line.

    ``keys``: alternative lists of names that identify a record; ``rec`` is null for a record without one.
    ``fields``: name, kind (JSON type, null for null) and canonical JSON (null for null) of every value that is no object.
    """
    rows = df.select(F.col(feed).alias("feed"), F.col(file_no).alias("file_no"), F.col(line_no).cast("long").alias("line_no"), F.col(payload).alias("payload"))
    schema = "feed string, file_no int, line_no long, rec string, fields array<struct<name:string,kind:string,value:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(parse_constant=_no_json).decode
        for batch in batches:
            at, recs, ends = [], [], [0]
            names, kinds, values = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                try:
                    record = decode(text) if text else None
                except (ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                flat = dict(leaves(record))
                at.append(i)
                recs.append(next((json.dumps([flat[k] for k in key]) for key in keys if all(flat.get(k) is not None for k in key)), None))
                for name, value in flat.items():
                    kind, write = _WRITERS.get(type(value), (None, None))
                    names.append(name)
                    kinds.append(kind)
                    values.append(None if kind is None else write(value))
                ends.append(len(names))
            taken = [batch.column(c).take(pa.array(at, type=pa.int64())) for c in range(3)]
            fields = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (names, kinds, values)], names=["name", "kind", "value"])
            yield pa.RecordBatch.from_arrays([*taken, pa.array(recs, type=pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)], names=["feed", "file_no", "line_no", "rec", "fields"])

    return rows.mapInArrow(run, schema)


def exploded(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, name, kind, value: one row per value."""
    return lines.select(*keys, F.inline("fields"))


# Flooding -----------------------------------------------------------------------------------------------------


@functools.lru_cache(1 << 16)
def words(name: str) -> tuple[str, ...]:
    """The words of a dotted, camel-cased or underlined name."""
    return tuple(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name))


@functools.lru_cache(1 << 16)
def likeness(a: str, b: str) -> float:
    """Of two names, in [0, 1]: shared letter triples of their last parts and shared words."""
    triples = lambda x: {f"  {x} "[i : i + 3] for i in range(len(x) + 1)}
    x, y = triples("".join(words(a.rpartition(".")[2]))), triples("".join(words(b.rpartition(".")[2])))
    u, v = set(words(a)), set(words(b))
    return 0.5 * len(x & y) / max(1, len(x | y)) + 0.5 * len(u & v) / max(1, len(u | v))


def flood(old: dict[str, str | None], new: dict[str, str | None], evidence: dict[tuple[str, str], float], steps: int = 100, enough: float = 1e-4) -> dict[tuple[str, str], float]:
    """Scores of all pairs (old name, new name). ``old`` and ``new``: name to type; ``evidence``: share of agreeing values."""

    def graph(schema: dict[str, str | None]) -> tuple[list, list[tuple[str, int, int]]]:
        nodes: dict[tuple, int] = {}
        of = lambda *x: nodes.setdefault(x, len(nodes))
        edges = []
        for name, kind in schema.items():
            i = of("element", name)
            edges.append(("type", i, of("type", kind or "null")))
            edges += [("word", i, of("word", w)) for w in dict.fromkeys(words(name))]
            inner = name
            while "." in inner:
                outer = inner.rpartition(".")[0]
                edges.append(("inside", of("element", inner) if inner == name else of("object", inner), of("object", outer)))
                inner = outer
            edges.append(("inside", of("object", inner) if inner != name else i, of("object", "")))
        return list(nodes), list(dict.fromkeys(edges))

    (a_nodes, a_edges), (b_nodes, b_edges) = graph(old), graph(new)
    width = len(b_nodes)
    start = np.zeros(len(a_nodes) * width)
    for i, x in enumerate(a_nodes):
        for j, y in enumerate(b_nodes):
            if x[0] == y[0]:
                same = 1.0 if x[1] == y[1] else likeness(x[1], y[1]) if x[0] != "type" else 0.2
                start[i * width + j] = (0.5 * same + evidence.get((x[1], y[1]), 0.0)) if x[0] == "element" else 0.5 * same
    sources, targets, labels = [], [], []
    for label in ("type", "word", "inside"):
        a = np.array([e[1:] for e in a_edges if e[0] == label], dtype=np.int64).reshape(-1, 2)
        b = np.array([e[1:] for e in b_edges if e[0] == label], dtype=np.int64).reshape(-1, 2)
        s = (a[:, :1] * width + b[:, 0]).ravel()
        t = (a[:, 1:] * width + b[:, 1]).ravel()
        sources += [s, t]
        targets += [t, s]
        # A node hands its score on in equal shares to its neighbours of a label and direction.
        labels += [1.0 / np.bincount(s)[s], 1.0 / np.bincount(t)[t]] if len(s) else [s.astype(float)] * 2
    source, target, share = (np.concatenate(x) for x in (sources, targets, labels))
    now = start
    for _ in range(steps):
        base = start + now
        after = base + np.bincount(target, weights=base[source] * share, minlength=len(start))
        after /= after.max() or 1.0
        moved, now = np.abs(after - now).max(), after
        if moved < enough:
            break
    place_a = {x[1]: i for i, x in enumerate(a_nodes) if x[0] == "element"}
    place_b = {x[1]: i for i, x in enumerate(b_nodes) if x[0] == "element"}
    return {(x, y): float(now[i * width + j]) for x, i in place_a.items() for y, j in place_b.items()}


#: The least likeness of two names that correspond without any value that says so.
ALIKE = 0.2


def correspondences(old: dict[str, str | None], new: dict[str, str | None], agree: dict[tuple[str, str], int], filled: dict[tuple[str | None, str | None], int]) -> list[tuple[str, str, int]]:
    """(old name, new name, agreeing records): one to one among the names that are gone and new, best score first.

    ``filled`` counts the shared records with a value, for (name, None) of the old and (None, name) of the new file. Two names contradict
    each other unless each record with a value under one has the same under the other. Names that agree somewhere come first; names without any value in the
    records shared correspond if they are each other's best, alike, and not of different types.
    """
    gone, came = [x for x in old if x not in new], [y for y in new if y not in old]
    known = lambda x, y: agree.get((x, y), 0)
    fit = [(x, y) for x in gone for y in came if known(x, y) == filled.get((x, None), 0) == filled.get((None, y), 0)]
    if not fit:
        return []
    score = flood(old, new, {p: agree[p] / (agree[p] + 1) for p in fit if known(*p)})
    chosen: list[tuple[str, str, int]] = []
    used_old, used_new = set(), set()

    def take(x: str, y: str) -> None:
        chosen.append((x, y, known(x, y)))
        used_old.add(x)
        used_new.add(y)

    for x, y in sorted((p for p in fit if known(*p)), key=lambda p: (-score[p], p)):
        if x not in used_old and y not in used_new:
            take(x, y)
    alike = lambda x, y: likeness(x, y) >= ALIKE and (old[x] is None or new[y] is None or old[x] == new[y])
    rest = [(x, y) for x, y in fit if not known(x, y) and x not in used_old and y not in used_new and alike(x, y)]
    best_new = {x: max((p for p in rest if p[0] == x), key=lambda p: (score[p], p)) for x, _ in rest}
    best_old = {y: max((p for p in rest if p[1] == y), key=lambda p: (score[p], p)) for _, y in rest}
    for x, y in rest:
        if best_new[x] == best_old[y] == (x, y):
            take(x, y)
    return chosen


# Changes ------------------------------------------------------------------------------------------------------


def _names(lines: DataFrame, files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """feed, file_no, name, old_kinds, kinds, came, gone: the names of each file and of the one before it; and feed, file_no, before, after."""
    per_name = exploded(lines, "feed", "file_no").groupBy("feed", "file_no", "name").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    known = (lines if files is None else files).select("feed", "file_no").distinct()
    order = W.partitionBy("feed").orderBy("file_no")
    placed = known.select("feed", "file_no", F.lag("file_no").over(order).alias("before"), F.lead("file_no").over(order).alias("after"))
    # A name counts for its own file and, as an old one, for the file after; both sides meet in one aggregation.
    sided = per_name.join(placed, ["feed", "file_no"])
    new_side = sided.where("before is not null").select("feed", "file_no", "name", F.lit(None).cast("array<string>").alias("old"), F.col("kinds").alias("new"))
    old_side = sided.where("after is not null").select("feed", F.col("after").alias("file_no"), "name", F.col("kinds").alias("old"), F.lit(None).cast("array<string>").alias("new"))
    both = new_side.unionByName(old_side).groupBy("feed", "file_no", "name").agg(F.max("old").alias("old_kinds"), F.max("new").alias("kinds"))
    return materialize(both.select("*", F.col("old_kinds").isNull().alias("came"), F.col("kinds").isNull().alias("gone")))[0], placed


_COUNTS = "feed string, file_no int, old_name string, new_name string, n long"


def _agreement(shared: DataFrame) -> DataFrame:
    """feed, file_no, old_name, new_name, n: of shared records (feed, file_no, old, new: lists of name and value), how many have one value under both
    names; with one name null, how many have a value under the other. Only agreeing pairs are counted, never all pairs of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for feed, file_no, old, new in zip(*(batch.column(i).to_pylist() for i in range(4))):
                by_value: dict[str, list[str]] = {}
                for f in old:
                    if f["value"] is not None:
                        by_value.setdefault(f["value"], []).append(f["name"])
                        counts[feed, file_no, f["name"], None] += 1
                for f in new:
                    if f["value"] is not None:
                        counts[feed, file_no, None, f["name"]] += 1
                        counts.update((feed, file_no, x, f["name"]) for x in by_value.get(f["value"], ()))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
            columns = list(zip(*((*k, n) for k, n in counts.items()))) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["feed", "file_no", "old_name", "new_name", "n"])

    counted = shared.select("feed", "file_no", "old", "new").mapInArrow(run, _COUNTS)
    return counted.groupBy("feed", "file_no", "old_name", "new_name").agg(F.sum("n").alias("n"))


def _matched(lines: DataFrame, both: DataFrame, placed: DataFrame) -> DataFrame:
    """feed, file_no, old_name, new_name, agree: the correspondences between each file and the one before it."""
    spark = lines.sparkSession
    kind = lambda c: F.when(F.size(c) > 0, F.array_join(c, "+"))
    # Files that lose and gain names, with both lists: only there may something have been renamed.
    schemas = both.groupBy("feed", "file_no").agg(
        F.collect_list(F.when(F.col("gone"), F.col("name"))).alias("lost"),
        F.collect_list(F.when(F.col("came"), F.col("name"))).alias("won"),
        F.collect_list(F.when(~F.col("came"), F.struct("name", kind(F.col("old_kinds")).alias("kind")))).alias("old"),
        F.collect_list(F.when(~F.col("gone"), F.struct("name", kind(F.col("kinds")).alias("kind")))).alias("new"),
    )
    unsure, _ = materialize(schemas.where("size(lost) > 0 and size(won) > 0").join(placed.select("feed", "file_no", "before"), ["feed", "file_no"]))

    # Records that both files hold: what they have under names that are gone, beside names that are new; nothing else is shuffled.
    records = lines.where(F.col("rec").isNotNull())
    of = lambda names: F.transform(F.filter("fields", lambda f: F.array_contains(names, f["name"])), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))
    none = F.lit(None).cast("array<struct<name:string,value:string>>")
    old = records.withColumnRenamed("file_no", "before").join(unsure.select("feed", "before", "file_no", "lost"), ["feed", "before"]).select("feed", "file_no", "rec", "line_no", of("lost").alias("old"), none.alias("new"))
    new = records.join(unsure.select("feed", "file_no", "won"), ["feed", "file_no"]).select("feed", "file_no", "rec", "line_no", none.alias("old"), of("won").alias("new"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    shared = old.unionByName(new).groupBy("feed", "file_no", "rec").agg(first("old"), first("new")).where("old is not null and new is not null")
    facts = _agreement(shared).groupBy("feed", "file_no").agg(F.collect_list(F.struct("old_name", "new_name", "n")).alias("facts"))
    given = unsure.select("feed", "file_no", "old", "new").join(facts, ["feed", "file_no"], "left")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for row in batch.to_pylist():
                schema = lambda side: {x["name"]: x["kind"] for x in sorted(row[side], key=lambda x: x["name"])}  # noqa: B023, E731
                counts = {(x["old_name"], x["new_name"]): x["n"] for x in row["facts"] or ()}
                for x in correspondences(schema("old"), schema("new"), {k: n for k, n in counts.items() if None not in k}, {k: n for k, n in counts.items() if None in k}):
                    for column, v in zip(out, (row["feed"], row["file_no"], *x)):
                        column.append(v)
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["feed", "file_no", "old_name", "new_name", "agree"])

    # An explicit number of tasks: the rows are few, but each is a flooding.
    spread = given.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "feed", "file_no")
    return materialize(spread.mapInArrow(match, "feed string, file_no int, old_name string, new_name string, agree long"))[0]


def matches(lines: DataFrame) -> DataFrame:
    """feed, file_no, old_name, new_name, agree: all correspondences of a file's new names with names that the file before had;
    ``agree`` counts the records that show it, 0 where only the flooding says so."""
    return _matched(lines, *_names(lines, None))


def changes(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """feed, file_no, change, old_name, new_name: each difference of a file from the one before it in its feed.

    ``lines``: what ``parse`` gives, preferably written once, as it is read several times. ``files`` (feed, file_no) names
    all files; without it, a file that has no complete line isn't known.
    """
    both, placed = _names(lines, files)
    retyped = both.where("not came and not gone and size(kinds) > 0 and size(old_kinds) > 0 and kinds != old_kinds").select("feed", "file_no", F.lit("retyped").alias("change"), F.col("name").alias("old_name"), F.col("name").alias("new_name"))
    # The exact check: a rename is a correspondence with the same values.
    renamed = _matched(lines, both, placed).where("agree > 0").select("feed", "file_no", F.lit("renamed").alias("change"), "old_name", "new_name")
    # One row per name that is gone or new, so that renamed ones leave together with their partner.
    one_sided = both.where("gone or came").select("feed", "file_no", F.when(F.col("gone"), "removed").otherwise("added").alias("change"), "name")
    taken = renamed.select("feed", "file_no", F.explode(F.array(F.struct(F.lit("removed").alias("change"), F.col("old_name").alias("name")), F.struct(F.lit("added").alias("change"), F.col("new_name").alias("name")))).alias("x")).select("feed", "file_no", "x.change", "x.name")
    sides = one_sided.withColumn("_left", F.lit(0)).unionByName(taken.withColumn("_left", F.lit(1))).groupBy("feed", "file_no", "change", "name").agg(F.max("_left").alias("_left")).where("_left = 0")
    plain = sides.select("feed", "file_no", "change", F.when(F.col("change") == "removed", F.col("name")).otherwise("").alias("old_name"), F.when(F.col("change") == "added", F.col("name")).otherwise("").alias("new_name"))
    return plain.unionByName(renamed).unionByName(retyped)


# One table -----------------------------------------------------------------------------------------------------


#: The least likeness of a feed's name and a field of the target that it never has under the target's own name.
MEANT = 0.5


@functools.lru_cache(1 << 12)
def meant(names: tuple[str, ...], free: tuple[tuple[str, str], ...]) -> dict[str, str]:
    """Name to target field: flooding of the target's fields against a feed's other names; each other's best among the ``free`` pairs
    (target field, name), and alike."""
    fit = [(x, y) for x, y in free if likeness(x, y) >= MEANT]
    if not fit:
        return {}
    score = flood(dict.fromkeys(sorted({x for x, _ in free})), dict.fromkeys(names), {})
    best_name = {x: max((p for p in fit if p[0] == x), key=lambda p: (score[p], p)) for x, _ in fit}
    best_field = {y: max((p for p in fit if p[1] == y), key=lambda p: (score[p], p)) for _, y in fit}
    return {y: x for x, y in fit if best_name[x] == best_field[y] == (x, y)}


def lineages(pairs: Sequence[tuple[str, str, str]], names: Mapping[tuple[str, str], frozenset[int]], target: Sequence[str]) -> dict[tuple[str, str], str]:
    """(feed, name) to canonical field. ``pairs``: (feed, old name, new name), ``names``: the files of each (feed, name).

    Names that correspond within a feed are one field: the target's among them, else the least name. A field that has no name of the target takes
    the one that all other feeds give its names, if its own feed has no other field of that name, or else the one that flooding finds
    among those that no file has beside it. So a name that stands for two things in two feeds doesn't unite them.
    """
    above: dict[tuple[str, str], tuple[str, str]] = {}
    wanted = set(target)

    def top(x: tuple[str, str]) -> tuple[str, str]:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for feed, name in names:
        top((feed, name))
    for feed, a, b in pairs:
        x, y = top((feed, a)), top((feed, b))
        if x != y and not (x[1] in wanted and y[1] in wanted):  # two fields of the target stay two
            low, high = sorted((x, y), key=lambda n: (n[1] not in wanted, n[1]))
            above[high] = low
    field = {n: top(n)[1] for n in list(above)}
    elsewhere: dict[str, set[str]] = {}
    for (_, name), f in field.items():
        if f in wanted and name != f:
            elsewhere.setdefault(name, set()).add(f)
    known = set(field.items())
    has = {(feed, f) for (feed, _), f in known}
    borrowed: dict[tuple[str, str], set[str]] = {}
    for (feed, name), f in known:
        if f not in wanted:
            borrowed.setdefault((feed, f), set()).update(elsewhere.get(name, ()))
    for (feed, name), f in known:
        found = borrowed.get((feed, f), set())
        if len(found) == 1 and (feed, next(iter(found))) not in has:
            field[feed, name] = next(iter(found))
    by_feed: dict[str, dict[str, list[str]]] = {}
    for (feed, name), f in field.items():
        by_feed.setdefault(feed, {}).setdefault(f, []).append(name)
    for feed, own in by_feed.items():
        files = {f: frozenset().union(*(names.get((feed, n), frozenset()) for n in of)) for f, of in own.items()}
        left = {name: f for f, of in own.items() if f not in wanted for name in of}
        free = tuple((t, name) for t in target for name in sorted(left) if not files.get(t, frozenset()) & files[left[name]])
        for name, t in sorted(meant(tuple(sorted(left)), free).items()):
            if not files.get(t, frozenset()) & files[left[name]]:  # another one may have come in between
                files[t] = files.get(t, frozenset()) | files[left[name]]
                field.update({(feed, n): t for n in own[left[name]]})
    return field


def cast_json(value: Column, kind: str) -> Column:
    """A canonical JSON value as a Spark type: strings are unquoted, hex numbers read, one-element lists opened."""
    opened = F.when(value.rlike(r"^\[[^\[\],]*\]$") & F.lit(not kind.startswith("array")), F.regexp_extract(value, r"^\[(.*)\]$", 1)).otherwise(value)
    plain = F.when(opened.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), opened, F.lit("}")), "$.v")).otherwise(opened)
    if kind.startswith("array"):
        listed = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
        return F.from_json(listed, kind)
    if kind == "boolean":
        low = F.lower(F.trim(plain))
        return F.when(low.isin("true", "1", "1.0", "yes", "t", "y"), True).when(low.isin("false", "0", "0.0", "no", "f", "n"), False)
    if kind in ("long", "int", "bigint"):
        hexed = plain.rlike("^0[xX][0-9a-fA-F]{1,15}$")
        number = F.when(hexed, F.conv(F.substring(plain, 3, 15), 16, 10)).otherwise(plain)
        return F.coalesce(number.try_cast("long"), F.when(number.try_cast("double") == F.floor(number.try_cast("double")), number.try_cast("double").try_cast("long")))
    return plain.try_cast(kind)


def united(lines: DataFrame, renames: DataFrame, record_key: Sequence[str], target: dict[str, str], most: int = NAMES) -> tuple[DataFrame, list[str]]:
    """rec, field, value: every record's values by canonical field, as canonical JSON; and the fields, the target's first. ``renames``:
    feed, old_name, new_name, as ``matches`` and ``changes`` give them."""
    values = exploded(lines, "feed", "file_no", "line_no", "rec")
    kept = renames.where("change = 'renamed'") if "change" in renames.columns else renames
    pairs = [tuple(r) for r in kept.select("feed", "old_name", "new_name").distinct().limit(most + 1).collect()]
    names = {(r["feed"], r["name"]): frozenset(r["files"]) for r in values.groupBy("feed", "name").agg(F.collect_set("file_no").alias("files")).limit(most + 1).collect()}
    if len(pairs) > most or len(names) > most:
        raise ValueError(f"more than {most} names; raise the bound or split the feeds by kind")
    canonical = lineages(sorted(pairs), names, [*record_key, *target])
    fields = [*target, *sorted({canonical[n] for n in names} - set(target) - set(record_key))]
    mapping = lines.sparkSession.createDataFrame([(*n, canonical[n]) for n in names], "feed string, name string, field string")
    known = values.where(F.col("rec").isNotNull() & F.col("value").isNotNull()).join(F.broadcast(mapping), ["feed", "name"])  # bounded by most
    last = known.groupBy("rec", "field").agg(F.max_by("value", F.struct("file_no", "line_no", "name")).alias("value"))
    return last, fields


def unify(lines: DataFrame, renames: DataFrame, record_key: Sequence[str], target: dict[str, str], most: int = NAMES) -> DataFrame:
    """One table of all records of a kind: the target's fields first and typed as it says, then every other field as text."""
    last, fields = united(lines, renames, record_key, target, most)
    wide = last.groupBy("rec").pivot("field", fields).agg(F.first("value")) if fields else last.select("rec").distinct()
    key = F.from_json("rec", "array<long>")
    columns = [key[i].alias(k) for i, k in enumerate(record_key)]
    return wide.select(*columns, *[cast_json(F.col(f"`{f}`"), target.get(f, "string")).alias(f.replace(".", "_")) for f in fields])


def uncastable(lines: DataFrame, renames: DataFrame, record_key: Sequence[str], target: dict[str, str], most: int = NAMES) -> DataFrame:
    """rec, field, value: the values that ``unify`` can't cast to the type of their field."""
    last, _ = united(lines, renames, record_key, target, most)
    failed = F.lit(False)
    for field, kind in target.items():
        failed = F.when(F.col("field") == field, cast_json(F.col("value"), kind).isNull()).otherwise(failed)
    return last.where(failed)


#: The documented fields and types of the two kinds of record.
TRANSACTION_FIELDS = {"fee_payer": "string", "signatures": "array<string>", "compute_units_consumed": "long", "cost_units": "long", "fee": "long", "priority_fee": "long", "has_dropped_log_messages": "boolean"}
FILL_FIELDS = {"user": "string", "coin": "string", "px": "double", "crossed": "boolean", "closed_pnl": "double", "fee": "double", "builder_fee": "double", "cloid": "string", "twap_id": "long"}
TRANSACTION_KEY, FILL_KEY = ("block_number", "transaction_index"), ("block_number", "fill_index")
