"""Ranked search against a plain version of the formula."""

import math
import random
import re

import numpy as np

from wavemill.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df: dict = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    asked: dict = {}
    for item, text in set(items):
        asked.setdefault(item, []).extend(terms(text))
    out = {}
    for item, words in asked.items():
        scores = []
        for d, b in bags:
            s = 0
            for t in words:
                tf = b.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * len(b) * n_docs) // total)))
            if s > 0:
                scores.append((-s, (d is not None, d or 0), d))
        out[item] = [(d, -s) for s, _, d in sorted(scores)[:k]]
    return {i: v for i, v in out.items() if v}


def found(df):
    out: dict = {}
    rows = df.collect()
    for r in sorted(rows, key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    assert len({(r["item_id"], r["rank"]) for r in rows}) == len(rows) and all(r["rank"] <= len(out[r["item_id"]]) for r in rows)
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_against_the_formula(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Éa", "ça", "x_y", "ÀB", "9"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(3, len(words))]) for _ in range(n))
    docs = [(d, text(rng.randint(1, 60))) for d in range(400)] + [(400 + d, "w1 w2 w3") for d in range(60)]  # ties
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(99, "nowhere"), (98, "w1 W1 w1"), (97, "w2 w3.")]
    want = plain(docs, items)
    assert len(want[98]) == 20
    for cut in ({}, {"block_postings": 40}):
        assert found(R.search(docs_of(spark, docs).repartition(7), items_of(spark, items), **cut)) == want
    assert found(R.search(docs_of(spark, docs), items_of(spark, items), k=3)) == plain(docs, items, 3)


def test_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows of both tables, ids with several texts, extra columns."""
    docs = [(None, "alpha beta"), (None, "alpha beta"), (1, None), (2, ""), (3, " .,;"), (4, "alpha " * 200_000 + "beta"), (5, "beta"), (5, "beta"), (6, "gamma Alpha"), (7, "x" * 300 + " gamma")]
    items = [(None, "beta"), (1, "alpha alpha beta"), (1, "alpha alpha beta"), (2, None), (3, ""), (4, "gamma"), (4, "beta"), (5, "x" * 300)]
    want = plain(docs, items)
    assert found(R.search(docs_of(spark, docs), items_of(spark, items))) == want
    wide = docs_of(spark, docs).selectExpr("doc_id", "text", "1 as n", "2 as terms", "3 as item_id")
    assert found(R.search(wide, items_of(spark, items).selectExpr("item_id", "text", "7 as doc_id", "8 as score"))) == want
    assert R.search(docs_of(spark, []), items_of(spark, items)).collect() == []
    assert R.search(docs_of(spark, docs), items_of(spark, [])).collect() == []


def test_radix_sums():
    rng = np.random.default_rng(2)
    for most in (1, 70_000, 1 << 40):
        keys, values = rng.integers(0, most, 5000), rng.integers(0, 1 << 40, 5000)
        got = R.summed(keys, values, most)
        want: dict = {}
        for a, b in zip(keys.tolist(), values.tolist()):
            want[a] = want.get(a, 0) + b
        assert dict(zip(got[0].tolist(), got[1].tolist())) == want and (np.diff(got[0]) > 0).all()


def test_long_sorts_are_cut(spark):
    """Matches that exceed one sort are cut between documents; a document may exceed it alone."""
    docs = [(d, f"a b c d{d % 5}") for d in range(300)]
    items = [(i, f"a b c d{i}") for i in range(8)]
    assert found(R.search(docs_of(spark, docs), items_of(spark, items), sorted_rows=20)) == plain(docs, items)
