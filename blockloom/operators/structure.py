"""Problem 2: deeply nested records to related flat tables, by vectorised structural indexing.

Method: a batch of JSON texts is one byte buffer. Bitmaps of quotes (escapes resolved), brackets and
delimiters are built with numpy over the whole buffer; the prefix sum of quotes tells inside from
outside of strings, the prefix sum of brackets gives the nesting depth. The structural characters that remain
delimit spans; their containers, names and places follow from sorts by depth, so every value becomes a
row that names its path, its place and the place of its parent element. No text is parsed value by value.

Nested Spark columns are brought into that form by ``to_json`` on the JVM side. Records are independent, so
there is no shuffle but the one that counts copies of a record once.

Defined results: a null or missing collection, and an empty one, gives no rows; null elements give none but
keep their places; copies of a record (same keys and same nested values) count once; records with null keys are kept apart
by their values; text that is not well-formed gives the rows up to where it breaks or none, never an error;
columns other than the named ones are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBJECT, LIST, STRING, NULL, OTHER = 0, 1, 2, 3, 4


@dataclass
class Index:
    """All values of a batch. ``parent`` is the number of the containing value or -1, ``place`` the place in the
    parent list or -1, ``name`` the number of the member's name in ``names`` or -1, ``kind`` see above;
    ``begin`` and ``end`` delimit the value's bytes (without the quotes of a string)."""

    row: np.ndarray
    parent: np.ndarray
    place: np.ndarray
    name: np.ndarray
    kind: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    names: list[str]
    buffer: np.ndarray

    def text(self, i: int) -> str:
        return decode(self.buffer[self.begin[i] : self.end[i]].tobytes(), self.kind[i] == STRING)


def decode(raw: bytes, quoted: bool) -> str:
    if quoted and b"\\" in raw:
        try:
            return json.loads(b'"' + raw + b'"')
        except ValueError:
            pass
    return raw.decode("utf-8", errors="replace")


def _row_of(at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, side="right") - 1


def structural(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of structural characters outside strings, and of real quotes."""
    quote = buffer == ord('"')
    slashes = buffer == ord("\\")
    if slashes.any():
        places = np.arange(len(buffer))
        last_plain = np.maximum.accumulate(np.where(slashes, -1, places))
        starts = np.zeros(len(buffer), dtype=np.int64)
        starts[offsets[:-1][offsets[:-1] < len(buffer)]] = offsets[:-1][offsets[:-1] < len(buffer)]
        floor = np.maximum.accumulate(starts) - 1  # a run of slashes ends at its own text
        before = np.r_[-1, np.maximum(last_plain, floor)[:-1]]
        quote &= (places - 1 - np.maximum(before, floor)) % 2 == 0
    count = np.cumsum(quote, dtype=np.int64)
    base = np.r_[0, count][offsets[:-1]]
    lengths = np.diff(offsets)
    inside = (count - np.repeat(base, lengths)) & 1  # one on an opening quote, zero on a closing one
    marks = np.zeros(256, dtype=bool)
    marks[[ord(c) for c in "{}[]:,"]] = True
    return np.flatnonzero(marks[buffer] & (inside == 0) & ~quote), np.flatnonzero(quote)


def _trim(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end = begin.copy(), end.copy()
    blank = np.zeros(257, dtype=bool)
    blank[[32, 9, 10, 13]] = True
    padded = np.r_[buffer.astype(np.int64), 256]
    while (hit := (begin < end) & blank[padded[begin]]).any():
        begin[hit] += 1
    while (hit := (begin < end) & blank[padded[np.maximum(end - 1, 0)]]).any():
        end[hit] -= 1
    return begin, end


def index(texts: pa.Array) -> Index:
    """The structural index of a batch; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    buffer = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    at, _ = structural(buffer, offsets)
    char, row = buffer[at], _row_of(at, offsets)
    opens, closes = (char == ord("{")) | (char == ord("[")), (char == ord("}")) | (char == ord("]"))
    level = np.cumsum(opens.astype(np.int64) - closes)
    first_of_row = np.searchsorted(row, np.arange(len(texts)))
    base = np.r_[0, level][first_of_row]
    level = level - base[row]
    # A delimiter lies at the depth of its container; an opening bracket at that of the container around it.
    depth = np.where(opens, level - 1, np.where(closes, level, level - 1))
    n = len(at)
    # Matching: at one depth of one row, brackets alternate between opening and closing.
    owner = np.full(n, -1, dtype=np.int64)  # the opening bracket of a mark's container (for brackets: of the one around)
    brackets = np.flatnonzero(opens | closes)
    match = np.full(n, -1, dtype=np.int64)
    by = brackets[np.lexsort((brackets, depth[brackets], row[brackets]))]
    a, b = by[:-1], by[1:]
    paired = opens[a] & closes[b] & (depth[a] == depth[b]) & (row[a] == row[b]) & (char[b] == char[a] + 2)
    match[a[paired]], match[b[paired]] = b[paired], a[paired]
    # The container at depth d - 1 of anything at depth d: the latest opening bracket of depth d - 1 before it.
    inner = np.where(opens, depth - 1, np.where(closes, depth - 1, depth))
    opening = np.flatnonzero(opens)
    who = np.concatenate([opening, np.arange(n)])
    key_depth = np.concatenate([depth[opening], inner])
    kind_of = np.concatenate([np.zeros(len(opening), dtype=np.int8), np.ones(n, dtype=np.int8)])
    order = np.lexsort((kind_of, who, key_depth, row[who]))
    sorted_who, sorted_kind = who[order], kind_of[order]
    latest = np.maximum.accumulate(np.where(sorted_kind == 0, np.arange(len(order)), -1))
    valid = latest >= 0
    found = np.where(valid, sorted_who[np.maximum(latest, 0)], -1)
    same = valid & (row[np.maximum(found, 0)] == row[sorted_who]) & (depth[np.maximum(found, 0)] == key_depth[order])
    is_mark = sorted_kind == 1
    owner[sorted_who[is_mark]] = np.where(same, found, -1)[is_mark]
    # Values: after "[" or "," of a list, after ":" of an object, and the whole text. A value ends at the next mark
    # of its container; for scalars that is simply the next mark.
    container_is_list = np.zeros(n, dtype=bool)
    container_is_list[owner >= 0] = char[owner[owner >= 0]] == ord("[")
    after = np.flatnonzero((char == ord(":")) | (char == ord("[")) | ((char == ord(",")) & container_is_list))
    row_end = offsets[1:][row] if n else np.zeros(0, dtype=np.int64)
    following = np.r_[at[1:], len(buffer)]
    following = np.minimum(following, row_end)
    start = at[after] + 1
    stop = following[after]
    begin, end = _trim(buffer, start, stop)
    next_mark = after + 1
    has_next = (next_mark < n) & (row[np.minimum(next_mark, n - 1)] == row[after]) if n else np.zeros(0, dtype=bool)
    nested = has_next & opens[np.minimum(next_mark, n - 1)] & (begin == end) if n else has_next
    empty = (begin == end) & ~nested  # "[]" has no value after its bracket
    after, begin, end, nested, next_mark = (x[~empty] for x in (after, begin, end, nested, next_mark))
    holder = np.where(char[after] == ord("["), after, owner[after])
    opened = np.where(nested, next_mark, -1)
    closed = np.where(nested, match[np.maximum(opened, 0)], -1)
    whole = ~nested | (closed >= 0)
    after, begin, end, nested, holder, opened, closed = (x[whole & (holder >= 0)] for x in (after, begin, end, nested, holder, opened, closed))
    # Roots: a bracket at depth 0 that is closed.
    roots = np.flatnonzero(opens & (depth == 0) & (match >= 0))
    roots = roots[np.r_[True, row[roots][1:] != row[roots][:-1]]] if len(roots) else roots
    node_open = np.concatenate([roots, opened])
    value_of = np.full(n + 1, -1, dtype=np.int64)  # opening bracket -> value number
    value_of[node_open[node_open >= 0]] = np.flatnonzero(node_open >= 0)
    parent = np.concatenate([np.full(len(roots), -1), value_of[holder]]).astype(np.int64)
    rows = np.concatenate([row[roots], row[after]])
    first_char = np.r_[buffer, 0][np.concatenate([at[roots], np.where(nested, at[np.maximum(opened, 0)], begin)])]
    kind = np.select([first_char == ord("{"), first_char == ord("["), first_char == ord('"'), first_char == ord("n")], [OBJECT, LIST, STRING, NULL], OTHER).astype(np.int8)
    begins = np.concatenate([at[roots], np.where(nested, at[np.maximum(opened, 0)], begin)])
    ends = np.concatenate([at[match[roots]] + 1, np.where(nested, at[np.maximum(closed, 0)] + 1, end)])
    quoted = kind == STRING
    begins, ends = begins + quoted, ends - quoted
    # Places: the number of commas of the list before the value.
    comma = np.flatnonzero((char == ord(",")) & container_is_list)
    in_list = char[holder] == ord("[")
    comma_keys = owner[comma] * np.int64(n + 1) + comma
    comma_keys.sort()
    place_of = np.searchsorted(comma_keys, holder * np.int64(n + 1) + after, side="right") - np.searchsorted(comma_keys, holder * np.int64(n + 1))
    place = np.concatenate([np.full(len(roots), -1), np.where(in_list, place_of, -1)]).astype(np.int64)
    # Names: the string before ":".
    colon = char[after] == ord(":")
    previous = np.r_[0, at[:-1] + 1] if n else np.zeros(0, dtype=np.int64)
    name_begin, name_end = _trim(buffer, previous[after[colon]], at[after[colon]])
    spelled = _gathered(buffer, np.minimum(name_begin + 1, name_end), np.maximum(name_end - 1, np.minimum(name_begin + 1, name_end)))[0].dictionary_encode()
    table = spelled.dictionary.to_pylist()
    member = np.full(len(after), -1, dtype=np.int64)
    member[colon] = spelled.indices.to_numpy()
    name = np.concatenate([np.full(len(roots), -1), member]).astype(np.int64)
    return Index(rows, parent, place, name, kind, begins, ends, [decode(x, True) for x in table], buffer)


def paths(ix: Index) -> tuple[np.ndarray, list[tuple[str | None, ...]]]:
    """For each value the number of its path; a path is a tuple of names, None standing for a list element."""
    number = np.full(len(ix.row), -1, dtype=np.int64)
    known: dict[tuple, int] = {(): 0}
    number[ix.parent < 0] = 0
    while True:
        ready = (number < 0) & (number[np.maximum(ix.parent, 0)] >= 0) & (ix.parent >= 0)
        if not ready.any():
            return number, list(known)
        listed = list(known)
        codes = number[ix.parent[ready]] * (len(ix.names) + 1) + ix.name[ready] + 1
        found, inverse = np.unique(codes, return_inverse=True)
        ids = []
        for code in found.tolist():
            p, name = divmod(code, len(ix.names) + 1)
            ids.append(known.setdefault((*listed[p], ix.names[name - 1] if name else None), len(known)))
        number[ready] = np.array(ids, dtype=np.int64)[inverse]


def _gathered(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The bytes between begins and ends, and which of them have a backslash; without a loop."""
    size = end - begin
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    data = buffer[np.arange(total) + np.repeat(begin - (ends - size), size)]
    slashes = np.r_[0, np.cumsum(data == ord("\\"))]
    offsets = np.r_[0, ends].astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return array, slashes[offsets[1:]] > slashes[offsets[:-1]]


def _strings(ix: Index, values: np.ndarray) -> pa.Array:
    """The texts of values; only those with escapes, or bytes that are no text, are decoded one by one."""
    raw, escaped = _gathered(ix.buffer, ix.begin[values], ix.end[values])
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([ix.text(i) for i in values.tolist()], type=pa.string())
    if not escaped.any():
        return texts
    return pc.replace_with_mask(texts, pa.array(escaped), pa.array([ix.text(i) for i in values[escaped].tolist()], type=pa.string()))


FLAT_FIELDS = "child string, parent_pos int, pos int, value string"


@dataclass(frozen=True)
class Child:
    """A flat table to be had: rows for the elements at ``path`` (None: every element of a list).
    For elements that are objects, ``value`` names the member whose text the row gets, empty if null."""

    child: str
    path: tuple[str | None, ...]
    value: str | None = None


def flatten(df: DataFrame, keys: Sequence[str], nested: Sequence[str], children: Sequence[Child]) -> DataFrame:
    """One row per non-null element of the children: keys, child, parent_pos, pos, value.

    ``parent_pos`` is the place of the list element around the element's list, -1 without one; ``pos`` is the place
    in the list, from 0.
    """
    # Inner names of our own, so that columns of any name can be keys.
    inner = [f"_k{i}" for i in range(len(keys))]
    text = F.to_json(F.struct(*nested), {"ignoreNullFields": "true"})
    records = df.select(*[F.col(k).alias(i) for k, i in zip(keys, inner)], text.alias("_json")).distinct()
    kind = T.StructType([*[records.schema[i] for i in inner], *T._parse_datatype_string(FLAT_FIELDS).fields])
    wanted = {c.path: c for c in children}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ix = index(batch.column(len(inner)))
            number, known = paths(ix)
            for n, path in enumerate(known):
                c = wanted.get(path)
                if c is None:
                    continue
                rows = np.flatnonzero((number == n) & (ix.kind != NULL))
                if c.value is not None:
                    rows = rows[ix.kind[rows] == OBJECT]
                if not len(rows):
                    continue
                if c.value is None:
                    values = _strings(ix, rows)
                else:
                    member = known.index((*path, c.value)) if (*path, c.value) in known else -1
                    inside = np.flatnonzero((number == member) & (ix.kind != NULL))
                    texts = np.full(len(ix.row), "", dtype=object)
                    texts[ix.parent[inside]] = _strings(ix, inside).to_pylist()
                    values = pa.array(texts[rows].tolist(), type=pa.string())
                # The enclosing element: up from the list to the nearest value that has a place.
                above = ix.parent[ix.parent[rows]]
                while (climb := (above >= 0) & (ix.place[above] < 0)).any():
                    above = np.where(climb, ix.parent[above], above)
                parent_pos = np.where(above >= 0, ix.place[above], -1)
                at = pa.array(ix.row[rows])
                columns = [batch.column(i).take(at) for i in range(len(inner))]
                columns += [pa.array([c.child]).take(pa.array(np.zeros(len(rows), dtype=np.int64))), pa.array(parent_pos.astype(np.int32)), pa.array(ix.place[rows].astype(np.int32)), values]
                yield pa.RecordBatch.from_arrays(columns, names=[*inner, "child", "parent_pos", "pos", "value"])

    flat = records.mapInArrow(run, kind)
    return flat.select(*[F.col(i).alias(k) for k, i in zip(keys, inner)], "child", "parent_pos", "pos", "value")


def related_tables(flat: DataFrame, children: Sequence[Child]) -> dict[str, DataFrame]:
    """The flat tables by name, each linked to its parents by keys, parent_pos and pos."""
    return {c.child: flat.where(F.col("child") == c.child).drop("child") for c in children}


TRANSACTION_CHILDREN = (
    Child("signature", ("signatures", None)),
    Child("lookup", ("address_table_lookups", None), "account_key"),
    Child("lookup_readonly", ("address_table_lookups", None, "readonly_indexes", None)),
    Child("lookup_writable", ("address_table_lookups", None, "writable_indexes", None)),
    Child("loaded_readonly", ("loaded_addresses", "readonly", None)),
    Child("loaded_writable", ("loaded_addresses", "writable", None)),
)
TRANSACTION_NESTED = ("signatures", "address_table_lookups", "loaded_addresses")
TRANSACTION_KEYS = ("block_number", "transaction_index")
