import datetime
import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.llm import pii, piece_sampling, queries

NAMES = pii.Pseudonyms(b"k")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_feistel_permutes():
    f = pii.Feistel(b"x")
    for n in (1, 2, 3, 10, 97, 256, 1000):
        got = [f.permute(x, n, b"t") for x in range(n)]
        assert sorted(got) == list(range(n)) and [f.invert(y, n, b"t") for y in got] == list(range(n))


@pytest.mark.parametrize(
    "kind,value",
    [("email", "hein.19@mail5.example.com"), ("ip", "108.51.216.133"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("card", "4111-1111-1111-1111"), ("ssn", "123-45-6789"), ("phone", "+1 (017) 555-7713"), ("date", "2024-02-29"), ("date", "31/12/1999"), ("date", "12/31/1999"), ("secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda")],
)
def test_formats_survive_and_invert(kind, value):
    text, counts = f"see {value}, and {value}.", Counter()
    out = pii.replaced(text, NAMES, counts)
    new = out[4 : 4 + len(value)]
    assert out == f"see {new}, and {new}." and counts == {kind: 2} and new != value
    assert pii.replaced(out, NAMES, Counter(), back=True) == text
    if kind == "card":
        s = new.replace("-", "")
        assert pii.luhn_digit(s[:-1]) == s[-1]
    if kind == "date" and value[4] == "-":
        datetime.date.fromisoformat(new)


@pytest.mark.parametrize("local", ["a" * 122, "a" * 123, "Zz9" * 2000, "x.1_" * 50000])
def test_long_addresses(local):
    value = f"{local}@mail.example.com"
    text, counts = f"see {value}, and {value}.", Counter()
    out = pii.replaced(text, NAMES, counts)
    new = out[4 : 4 + len(value)]
    kind = lambda c: (c.isdigit(), c.islower(), c.isupper(), c if not c.isalnum() else "")
    assert out == f"see {new}, and {new}." and counts == {"email": 2} and new != value and new.endswith("example.com")
    assert [kind(c) for c in new] == [kind(c) for c in value]
    assert pii.replaced(out, NAMES, Counter(), back=True) == text
    other = pii.replaced(f"b{value[1:]}", NAMES, Counter())
    pairs = [(a, b) for a, b in zip(other, new) if a.isalnum()]
    assert sum(a == b for a, b in pairs) < len(pairs) // 2


def test_look_alikes_stay():
    text = "4111111111111112 2024-02-30 300.1.1.1 v2.0.1 000-12-3456 GB00WEST12345698765432 12-34"
    assert pii.replaced(text, NAMES, Counter()) == text


def test_pseudonymise_rows(spark):
    rows = [(1, None, "c"), (2, "", "c"), (3, "a b@c.de 4111111111111111 " + "x " * 50000, "c"), (3, "no data", "c"), (None, "1.2.3.4", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_counts string")
    got = pii.pseudonymise(df, b"k")
    assert [r.text for r in pii.pseudonymise(got, b"k", back=True).collect()] == [r[1] for r in rows]
    assert [dict(r.pii_counts) for r in got.collect()] == [{}, {}, {"email": 1, "card": 1}, {}, {"ip": 1}]
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), b"k").collect() == []


def test_query(spark, sf):
    """Every row, one document at a time; equal values stay linked across documents and different ones apart."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names, forth, back = pii.Pseudonyms(queries.PII_KEY), {}, {}
    got = {r.doc_id: r for r in queries.op3_pii_pseudonyms(spark, sf).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        counts = Counter()
        new = pii.replaced(text, names, counts)
        assert hashlib.sha256(new.encode()).hexdigest() == got[i].text_sha256
        assert {k: got[i][f"n_{k}"] for k in pii.KINDS} == {k: counts[k] for k in pii.KINDS}
        assert len(new) == len(text) and pii.replaced(new, names, Counter(), back=True) == text
        changed = [(m[0], new[m.start() : m.end()]) for m in pii._FOUND.finditer(text)]
        assert sum(a != b for a, b in changed) <= sum(counts.values())
        for a, b in changed:
            assert forth.setdefault(a, b) == b and back.setdefault(b, a) == a
    assert len(forth) > 10


SAMPLER = piece_sampling.Sampler(MODEL, 1.0, 11)
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab thei\n▁ é漢😀́\x00") | st.characters(exclude_categories=["Cs"]), max_size=30), max_size=5))
def test_lossless(texts):
    keys = np.arange(len(texts)).astype(np.uint64)
    ids, counts = SAMPLER.encode(texts, keys)
    assert SAMPLER.decode(ids, counts) == texts
    edges = np.append(0, np.cumsum(counts))
    for k, t in enumerate(texts):
        alone, n = SAMPLER.encode([t], keys[k : k + 1])
        assert alone.tolist() == ids[edges[k] : edges[k + 1]].tolist() and n[0] == counts[k]
        if "▁" not in t and "\x00" not in t:
            assert SP.decode(alone.tolist()) == t


def test_samples_follow_the_lattice():
    text, weight = "then", lambda p: -math.log(ORDER[p])
    usual = [i for i in range(SP.vocab_size()) if not (SP.is_control(i) or SP.is_unknown(i) or SP.is_byte(i) or SP.is_unused(i))]
    ORDER = {SP.id_to_piece(i): k + 1 for k, i in enumerate(usual)}
    whole, paths = "▁" + text, {}
    for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
        edge = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(whole)]
        parts = [whole[a:b] for a, b in zip(edge, edge[1:])]
        if all(p in ORDER for p in parts):
            paths[tuple(parts)] = math.exp(sum(weight(p) for p in parts))
    n = 20000
    ids, counts = SAMPLER.encode([text] * n, np.arange(n).astype(np.uint64))
    edge = np.append(0, np.cumsum(counts))
    seen = Counter(tuple(SP.id_to_piece(int(i)) for i in ids[a:b]) for a, b in zip(edge, edge[1:]))
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for p, w in paths.items():
        assert abs(seen[p] / n - w / total) < 4 * math.sqrt(w / total / n) + 1e-3


def test_piece_rows(spark):
    rows = [(1, None), (2, ""), (3, " two  spaces\n"), (3, " two  spaces\n"), (None, "x" * 3000), (4, "word " * 40000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pieces int").repartition(3)
    got = piece_sampling.decode(piece_sampling.encode(df, MODEL), MODEL).collect()
    assert all(r.text == r.decoded for r in got) and len(got) == len(rows)
    assert len({tuple(r.pieces) for r in got if r.doc_id == 3}) == 1
    assert [r.pieces for r in got if r.doc_id == 1] == [None] and [r.pieces for r in got if r.doc_id == 2] == [[]]
