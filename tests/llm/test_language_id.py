import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import language_id as L
from wavemill.llm import queries


def brute_models(texts, order):
    """Interpolated Kneser-Ney over characters by dictionaries; returns p(context, character)."""
    words = [f" {w} " for t in texts for w in "".join(c if c.isalpha() else " " for c in t.lower()).split()]
    counts = [Counter() for _ in range(order)]
    for w in words:
        for i in range(1, len(w)):
            for k in range(order):
                if i - k >= 0:
                    counts[k][w[i - k : i + 1]] += 1
    kinds = [None] * order
    kinds[order - 1] = counts[order - 1]
    for k in range(order - 1):  # kinds of characters before; n-grams at a word's start count as often as they occur
        seen = Counter(g[1:] for g in counts[k + 1])
        for g, n in Counter(w[: k + 1] for w in words if len(w) > k).items():
            if k:
                seen[g] += n
        kinds[k] = seen
    of = []
    for c in kinds:
        n1, n2 = (sum(v == x for v in c.values()) for x in (1, 2))
        of.append(n1 / (n1 + 2 * n2) if n1 and n2 else 0.5)
    total, many = defaultdict(Counter), defaultdict(Counter)
    for k in range(1, order):
        for g, n in kinds[k].items():
            total[k][g[:-1]] += n
            many[k][g[:-1]] += 1
    all_one = sum(kinds[0].values())
    floor = of[0] * len(kinds[0]) / all_one / (len(kinds[0]) + 1)

    def p(g):
        k = len(g) - 1
        if k == 0:
            return (kinds[0][g] - of[0]) / all_one + floor if g in kinds[0] else floor
        low = p(g[1:])
        if not total[k][g[:-1]]:
            return low
        back = of[k] * many[k][g[:-1]] / total[k][g[:-1]]
        return max(kinds[k][g] - of[k], 0) / total[k][g[:-1]] + back * low if g in kinds[k] else back * low

    def bits(text):
        out = n = 0
        for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            w = f" {w} "
            n += len(w) - 1
            out += sum(-np.log2(p(w[max(0, i - order + 1) : i + 1])) for i in range(1, len(w)))
        return out / n

    return bits


def test_entropies_against_dictionaries():
    a = ["the house and the mouse went over there", "then they other than a", "thaw the hat"]
    b = ["das haus und die maus gingen über den see", "der die das und dann", "wann und wo"]
    model = L.fit([("a", t) for t in a] + [("b", t) for t in b], order=4)
    texts = ["the mouse", "die maus!", "über 12 über", "qqq the", "Then x"]
    got = model.entropies(texts)[0]
    for j, rows in enumerate((a, b)):
        bits = brute_models(rows, 4)
        assert got[:, j] == pytest.approx([bits(t) for t in texts], rel=1e-5)


def test_predictions():
    rng = np.random.default_rng(3)
    make = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40))
    model = L.fit([("x", make("abcde")) for _ in range(40)] + [("y", make("efghi")) for _ in range(40)])
    lang, score, rejected = model.predict([make("abcde"), make("efghi"), None, "", "12 --", make("漢字仮名"), "A"])
    assert lang[:2] == ["x", "y"] and lang[2:5] == ["und"] * 3 and lang[6] == "x"
    assert (score[:2] > 0.99).all() and (score[2:5] == 0).all()
    assert not rejected[:2].any() and rejected[2:6].all()


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "x", 0.5), (2, "", "x", 0.5), (None, "ab", None, 0.5), (3, "ab", "x", 0.5), (3, "ab", "x", 0.5), (4, "ab " * 100_000, "x", 0.5)], "doc_id long, text string, lang string, score double")
    got = L.language_id(docs).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "und"), (2, "und"), (None, "x"), (3, "x"), (3, "x"), (4, "x")]
    assert L.language_id(docs.limit(0)).collect() == []
    assert [r.lang_pred for r in L.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 6


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op10_language_id(spark, sf).collect()
    assert {r.doc_id for r in got} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id] is not None]
    assert np.mean(right) > 0.98
