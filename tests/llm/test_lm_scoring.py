import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavemill.llm import lm_scoring, queries


def brute(docs, held=1):
    """Modified Kneser-Ney bigrams by dictionaries."""
    toks = {i: re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in docs}
    pairs = Counter()
    for i, x in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != held:
            pairs.update(zip(["<s>", *[(w,) for w in x[:-1]]], x))
    uni, kinds, total, by = Counter(), Counter(), Counter(), defaultdict(Counter)
    for (c, w), n in pairs.items():
        uni[w] += n
        kinds[w] += 1
        total[c] += n
        by[c][min(n, 3)] += 1
    of = lambda values: lm_scoring.discounts(*(sum(v == k for v in values) for k in (1, 2, 3, 4)))
    d, dw, n_all, v = of(pairs.values()), of(kinds.values()), sum(uni.values()), len(uni)
    spare = sum(dw[min(k, 3)] for k in kinds.values()) / sum(kinds.values())

    def lower(w):
        return max(kinds[w] - dw[min(kinds[w], 3)], 0) / sum(kinds.values()) + spare / (v + 1)

    def p(c, w):
        if not total[c]:
            return lower(w)
        return (max(pairs[c, w] - d[min(pairs[c, w], 3)], 0) + sum(d[k] * by[c][k] for k in (1, 2, 3)) * lower(w)) / total[c]

    return {
        i: (len(x), sum(uni[w] > 0 for w in x), n_all, sum(math.log10((uni[w] + 0.5) / (n_all + 0.5 * (v + 1))) for w in x), sum(math.log10(p(c, w)) for c, w in zip(["<s>", *[(w,) for w in x[:-1]]], x)))
        for i, x in toks.items()
    }


@pytest.mark.parametrize("hot_share", [lm_scoring.HOT_SHARE, 0.02, 0.0])
def test_against_dictionaries(spark, sf, hot_share):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()][:120]
    rows += [(9001, None), (9002, ""), (9003, "the  THE the the\x1cx\x0bof"), (9004, "the " * 3000)]
    got = lm_scoring.lm_scores(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(5), hot_share=hot_share).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)


def test_frequent_contexts(spark):
    df = spark.createDataFrame([("a b a c a d " * 50,), ("e f",)], "text string")
    assert list(lm_scoring.hot_contexts(df, 0.3)) == [lm_scoring.K.hash_spans(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1]))[0]]


def test_query(spark, sf):
    got = {r.doc_id: r for r in queries.op7_lm_scoring(spark, sf).collect()}
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert set(got) == set(want)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3]
        assert (r.base_score, r.score) == pytest.approx(want[i][3:], rel=1e-9)


def test_empty(spark):
    assert lm_scoring.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
