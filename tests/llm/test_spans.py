import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import queries, spans


def _brute(rows, length):
    grams: dict[str, set] = {}
    for i, t in rows:
        for j in range(len(t or "") - length + 1):
            grams.setdefault(t[j : j + length], set()).add(i)
    pairs, covered = set(), {i: set() for i, _ in rows}
    for g in grams.values():
        pairs |= {(a, b) for a in g for b in g if a < b}
    for i, t in rows:
        for j in range(len(t or "") - length + 1):
            if len(grams[t[j : j + length]]) > 1:
                covered[i] |= set(range(j, j + length))
    return pairs, {i: len(c) for i, c in covered.items()}


def _repeats(rows, length):
    """Stretches of starts whose spans occur in one and the same set of documents."""
    where: dict[str, set] = {}
    for i, t in rows:
        for j in range(len(t or "") - length + 1):
            where.setdefault(t[j : j + length], set()).add(i)
    out = []
    for i, t in rows:
        now = None
        for j in range(len(t or "") - length + 1):
            own = where[t[j : j + length]]
            if own == now:
                out[-1][2] += 1
            else:
                out.append([i, j, j + length, len(own)])
            now = own
    return sorted(tuple(x) for x in out if x[3] > 1)


@settings(max_examples=150, deadline=None)
@given(st.text("ab", min_size=0, max_size=300), st.text("abc", min_size=0, max_size=60), st.integers(2, 12), st.integers(3, 9))
def test_winnowing_guarantee(a, b, window, k):
    """Texts that share window + k - 1 characters share an anchor at the same place of them, also in runs of equal characters."""
    length = window + k - 1
    x, y = a + b, b + a[: len(a) // 2] + b
    number, value, place = spans.anchors([x, y, x[:5], ""], length, window)
    own = [{(v, p) for n, v, p in zip(number.tolist(), value.tolist(), place.tolist()) if n == i} for i in range(4)]
    for i in range(len(x) - length + 1):
        for j in range(len(y) - length + 1):
            if x[i : i + length] == y[j : j + length]:
                assert any((v, p - i + j) in own[1] for v, p in own[0] if i <= p < i + window)
    at = sorted(p for _, p in own[0])
    if len(x) >= length:
        assert np.diff(np.r_[-1, at, len(x) - k + 1]).max() <= window  # every window has an anchor
    assert not own[3] and (len(x[:5]) >= length or not own[2])


def test_ties_stay_sparse():
    """A run of equal characters has one anchor value, so it is one row, whatever the number of its places."""
    number, value, place = spans.anchors(["a" * 100_000, "b" * 7 + "a" * 1000], 200, 51)
    assert len(set(value[number == 0].tolist())) == 1 and len(place[number == 0]) == 100_000 - 149
    assert set(value[number == 0].tolist()) <= set(value[number == 1].tolist())


def test_pieces_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(n)) for n in (0, 199, 200, 3000, 5, 950, 401)] + ["a" * 900]
    whole = [x.tolist() for x in spans.anchors(texts, 200, 51)]
    monkeypatch.setattr(spans, "_PIECE", 64)
    assert [x.tolist() for x in spans.anchors(texts, 200, 51)] == whole


def test_hash_is_of_content_only():
    text = "The same text, 日本語 too, twice. " * 9
    h = spans.gram_hashes(spans.code_points(text), 20)
    by: dict[str, int] = {}
    for i in range(len(h)):
        assert by.setdefault(text[i : i + 20], int(h[i])) == int(h[i])
    assert len(set(by.values())) == len(by)


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh日ü🧵") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    plate, hot = text(60)[:260], text(40)[:199]
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 90))
        if i % 3 == 0:
            t = t[:50] + hot + t[50:]  # a span just too short, in a third of all texts
        if i % 7 == 0:
            t = t + plate[rng.randint(0, 60) :]
        if i % 11 == 0:
            t = plate[:200] + t
        rows.append((i * 3 + 1, t))
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, None), (1003, ""), (1004, "x" * 199), (1005, "x" * 200), (1006, "y" + "x" * 230), (1007, plate[:210] * 2), (1008, rows[3][1] + rows[5][1] + text(3000))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_coverage_against_brute_force(spark, seed):
    rows = _corpus(seed)
    pairs, covered = _brute(rows, 200)
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc_id long, text string, start int, rep string").repartition(4)
    got = [tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 50
    cover = {r["doc_id"]: r for r in spans.coverage(df, "doc_id", "text").collect()}
    assert {i: r["shared_chars"] for i, r in cover.items()} == covered
    assert all(r["n_chars"] == len(dict(rows)[i] or "") for i, r in cover.items())
    runs = [tuple(r) for r in spans.repeats(df, "doc_id", "text").select("doc_id", "start", "end", "n_docs").collect()]
    assert sorted(runs) == _repeats(rows, 200)


def test_periodic_texts(spark):
    """Ties everywhere: runs of equal characters and short periods, at different places of their texts."""
    period = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(1, "x" * 200), (2, "x" * 230), (3, "y" + "x" * 230), (4, "-" * 60 + "x" * 199), (5, period * 9), (6, "#" + period[7:] + period * 7), (7, (period * 9)[:199]), (8, "q" * 40 + period * 6), (9, "q" * 40 + (period * 9)[:160] + "z"), (10, "ab" * 300), (11, "ba" * 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs, covered = _brute(rows, 200)
    assert {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()} == pairs and pairs
    assert {r["doc_id"]: r["shared_chars"] for r in spans.coverage(df, "doc_id", "text").collect()} == covered
    assert sorted(tuple(r) for r in spans.repeats(df, "doc_id", "text").collect()) == _repeats(rows, 200)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spans.shared_pairs(df, "doc_id", "text").count() == 0
    assert spans.coverage(df, "doc_id", "text").count() == 0
    assert spans.repeats(df, "doc_id", "text").count() == 0


def test_documents(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.p10_found(spark, root).collect()} == _brute(rows, 200)[0]
