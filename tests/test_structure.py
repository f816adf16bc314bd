import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.operators import structure as s

LEAF = st.one_of(st.none(), st.booleans(), st.integers(-10**12, 10**12), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=12), st.sampled_from(['"', "\\", '\\"', "[{,:}]", "null", "", "ü🧵"]))
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=25)
ROOT = st.lists(VALUE, max_size=4) | st.dictionaries(st.text(max_size=5), VALUE, max_size=4)


def _walk(row, value, path=(), place=-1, out=None):
    out = [] if out is None else out
    kind = {dict: s.OBJECT, list: s.LIST, str: s.STRING, type(None): s.NULL}.get(type(value), s.OTHER)
    out.append((row, path, place, kind, None if kind in (s.OBJECT, s.LIST) else value))
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(row, v, (*path, k), -1, out)
    if isinstance(value, list):
        for i, v in enumerate(value):
            _walk(row, v, (*path, None), i, out)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(ROOT, max_size=5), st.booleans(), st.booleans())
def test_every_value_of_any_document(docs, spaced, ascii_only):
    texts = [json.dumps(d, separators=(" , ", " : ") if spaced else (",", ":"), ensure_ascii=ascii_only) for d in docs]
    ix = s.index(pa.array(texts, type=pa.string()))
    number, known = s.paths(ix)
    got = []
    for i in range(len(ix.row)):
        kind, text = int(ix.kind[i]), ix.text(i)
        value = text if kind == s.STRING else None if kind in (s.OBJECT, s.LIST) else json.loads(text)
        got.append((int(ix.row[i]), known[number[i]], int(ix.place[i]), kind, value))
    want = [x for r, d in enumerate(docs) for x in _walk(r, d)]
    key = lambda x: (x[0], repr(x))
    assert sorted(got, key=key) == sorted(want, key=key)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('{}[]:,"\\ a1', max_size=20), min_size=1, max_size=4), ROOT)
def test_broken_texts_do_no_harm(broken, doc):
    texts = [*broken, json.dumps(doc), None, ""]
    ix = s.index(pa.array(texts, type=pa.string()))
    number, known = s.paths(ix)
    mine = sum(int(r) == len(broken) for r in ix.row)
    assert mine == len(_walk(0, doc))


NESTED = "block_number long, transaction_index int, signatures array<string>, address_table_lookups array<struct<account_key:string,readonly_indexes:array<smallint>,writable_indexes:array<smallint>>>, loaded_addresses struct<readonly:array<string>,writable:array<string>>, child string, value int"


def test_nulls_at_every_level_copies_and_names(spark):
    rows = [
        (1, 0, ["a", None, 'q"\\['], [("k", [1, None], []), None, (None, None, [7])], (["r"], None), "x", 1),
        (1, 0, ["a", None, 'q"\\['], [("k", [1, None], []), None, (None, None, [7])], (["r"], None), "x", 1),
        (2, 0, None, None, None, "x", 1),
        (2, 1, [], [], ([], []), "x", 1),
        (None, None, ["n"], None, (None, [None, "w"]), "x", 1),
        (None, None, ["m"], None, None, "x", 1),
    ]
    df = spark.createDataFrame(rows, NESTED)
    got = sorted(map(str, map(tuple, s.flatten(df, s.TRANSACTION_KEYS, s.TRANSACTION_NESTED, s.TRANSACTION_CHILDREN).collect())))
    want = [
        (1, 0, "signature", -1, 0, "a"), (1, 0, "signature", -1, 2, 'q"\\['), (1, 0, "lookup", -1, 0, "k"), (1, 0, "lookup", -1, 2, ""),
        (1, 0, "lookup_readonly", 0, 0, "1"), (1, 0, "lookup_writable", 2, 0, "7"), (1, 0, "loaded_readonly", -1, 0, "r"),
        (None, None, "signature", -1, 0, "n"), (None, None, "signature", -1, 0, "m"), (None, None, "loaded_writable", -1, 1, "w"),
    ]
    assert got == sorted(map(str, want))
    assert s.flatten(df.limit(0), s.TRANSACTION_KEYS, s.TRANSACTION_NESTED, s.TRANSACTION_CHILDREN).count() == 0
    tables = s.related_tables(s.flatten(df, s.TRANSACTION_KEYS, s.TRANSACTION_NESTED, s.TRANSACTION_CHILDREN), s.TRANSACTION_CHILDREN)
    assert tables["signature"].count() == 4 and "child" not in tables["signature"].columns
