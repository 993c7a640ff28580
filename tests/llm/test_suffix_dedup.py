import hashlib
import random

import numpy as np

import pytest

from wavemill.llm import queries, suffix_dedup
from wavemill.llm.suffix_dedup import owned, remove_repeats, suffix_order


def brute(rows, length):
    first, out = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.setdefault(i, []).append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def _rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.choice([8, 12, 20, 80]))) for _ in range(12)]
    rows = []
    for i in rng.sample(range(500), 70):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(600, None), (601, ""), (602, "a" * 300), (603, "a" * 49), (604, "a" * 120 + "b" * 200), (605, rows[3][1]), (606, rows[3][1]), (606, rows[3][1]), (None, rows[3][1]), (607, passages[3] * 90), (608, passages[3] * 91), (609, "x" * 60), (609, "x" * 60)]
    shared = passages[5][:70]
    return rows + [(700 + i, word() + shared + word() * 3) for i in range(60)]  # one passage in many contexts


def _check(spark, rows, length, **limits):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(4)
    got: dict = {}
    for r in remove_repeats(df, length, **limits).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    want = brute(rows, length)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize("length", [20, 50, 120, 200])
def test_against_brute_force(spark, length):
    _check(spark, _rows(), length)


def test_fingerprints_with_very_many_contexts_go_string_by_string(spark):
    _check(spark, _rows(), 50, hot_rows=3)


def test_many_small_sorts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "SENT", 3)
    _check(spark, _rows(), 50)


def test_length_out_of_range(spark):
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 5)


def test_every_string_is_owned_once():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 99, k).astype(np.uint8) for k in (0, 10, 49, 50, 51, 300, 0, 77)] + [np.full(200, 97, np.uint8)]
    offsets, buf = np.cumsum([0, *map(len, texts)]), np.concatenate(texts)
    h, row, start, end = owned(buf, offsets, 50, 24)
    got = [(r, p - offsets[r]) for r, s, e in zip(row, start, end) for p in range(s, e)]
    assert got == [(r, p) for r, t in enumerate(texts) for p in range(len(t) - 49)]
    of: dict = {}
    for k, s, e in zip(h, start, end):
        for p in range(s, e):
            assert of.setdefault(buf[p : p + 50].tobytes(), k) == k


@pytest.mark.parametrize("length", [8, 24, 50, 100])
def test_suffix_order(length):
    rng = np.random.default_rng(length)
    text = np.concatenate([rng.integers(97, 99, 700).astype(np.uint8), np.full(300, 97, np.uint8), rng.integers(97, 99, 40).astype(np.uint8)])
    text = np.concatenate([text, text[100:400]])
    places = np.sort(rng.permutation(len(text) - length)[:900])
    order, new = suffix_order(text, places, length)
    strings = [text[p : p + length].tobytes() for p in places[order]]
    assert sorted(order) == list(range(len(places)))
    assert strings == sorted(strings)
    assert [a != b for a, b in zip(strings, strings[1:])] == new[1:].tolist()


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(list(docs.items()), 50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_suffix_dedup(spark, sf).collect()}
    assert got == {i: (n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, [(n, gone, spans, kept)] in want.items()}


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
