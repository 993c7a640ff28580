import random
import zlib

import numpy as np
import pytest

from wavemill.llm import kernels as K
from wavemill.llm import queries, toxicity
from wavemill.llm.common import hashed_sample

TEXTS = ["", "one", "One two THREE", "été était là 漢字 x1y2 --", "a b c d e f g " * 9, "###", "ab abc abcd abcde abcdef abcdefg"]


def _net(seed=3):
    rng = np.random.default_rng(seed)
    shape = lambda *s: rng.normal(0, 0.5, s)
    return toxicity.Net(shape(toxicity.BUCKETS, toxicity.DIM), [shape(w, toxicity.DIM, toxicity.FILTERS) for w in toxicity.WIDTHS], [shape(toxicity.FILTERS) for _ in toxicity.WIDTHS], shape(toxicity.FILTERS * len(toxicity.WIDTHS)), 0.3, ["a", "b"], shape(toxicity.BUCKETS, 2), np.array([0.1, -0.2, 0.4]), True)


def _by_loops(net, text):
    """The net's score word by word."""
    words = toxicity.read_words(*toxicity._buffers([text]))
    zero = [np.zeros(toxicity.DIM)] * max(toxicity.WIDTHS)
    vectors = [np.mean([net.emb[f] for f in words.features[k]], axis=0) for k in words.of] + zero
    starts = range(len(words.of) + 1)  # a text without words is one window of nothing
    z = net.out_bias
    for n, (w, b) in enumerate(zip(net.conv, net.bias)):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(vectors[i + j] @ w[j][:, f]) for j in range(len(w))) for i in starts)
            z += max(best + b[f], 0) * net.out[n * toxicity.FILTERS + f]
    votes = [sum(np.mean([net.lang_table[f, j] for f in words.features[k]]) for k in words.of) for j in range(2)]
    return 1 / (1 + np.exp(-(z - net.shift[int(np.argmax(votes)) if len(words.of) else 2])))


def test_scores_against_loops():
    net = _net()
    assert net.scores(*toxicity._buffers(TEXTS)) == pytest.approx([_by_loops(net, t) for t in TEXTS])


def test_features_are_those_of_the_word():
    a, b = (toxicity.read_words(*toxicity._buffers([t])) for t in ("réeuxment xx", "zz Réeuxment"))
    one = lambda w, k: w.features[w.of[k]].tolist()
    assert one(a, 0) == one(b, 1)
    c = toxicity.read_words(*toxicity._buffers(["réeuxpa"]))
    assert one(a, 0)[1:5] == one(c, 0)[1:5] and one(a, 0)[0] != one(c, 0)[0] and one(a, 0)[5] != one(c, 0)[5]


def test_gradients_are_slopes_of_the_loss():
    net, label = _net(), np.array([1.0, 0, 1, 0, 1, 0, 1])
    words = toxicity.read_words(*toxicity._buffers(TEXTS))
    first = np.searchsorted(words.rows, np.arange(len(TEXTS) + 1))
    chunk, weight = np.arange(len(TEXTS)), np.linspace(0.5, 2, len(TEXTS))
    grads, rows = toxicity._gradients(net, words, first, chunk, label, weight)

    def loss():
        logit = net.logits(*toxicity._buffers(TEXTS))[0]
        decay = 0.5e-4 * ((net.out**2).sum() + sum((w**2).sum() for w in net.conv) + (net.emb[rows] ** 2).sum())
        return (weight * (np.logaddexp(0, logit) - label * logit)).mean() + decay

    full = np.zeros_like(net.emb)
    full[rows] = grads[0]
    for p, g in zip([net.emb, *net.conv, *net.bias, net.out], [full, *grads[1:-1]]):
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            where, step = np.unravel_index(at, p.shape), 1e-5
            old = p[where]
            p[where] = old + step
            up = loss()
            p[where] = old - step
            down = loss()
            p[where] = old
            assert (up - down) / (2 * step) == pytest.approx(g[where], rel=2e-3, abs=1e-7)


def test_parts_of_words_are_learned():
    rng = random.Random(5)
    word = lambda head="": head + "".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7)))

    def text(bad):
        words = [word() for _ in range(rng.randint(5, 60))]
        for _ in range(bad and 3):
            words[rng.randrange(len(words))] = word("zworg")
        return " ".join(words)

    rows = [(text(k % 5 == 0), "l", int(k % 5 == 0)) for k in range(600)]
    net = toxicity.fit(rows)
    fresh = [(text(k % 2), k % 2) for k in range(200)]
    got = net.scores(*toxicity._buffers([t for t, _ in fresh])) >= 0.5
    assert np.mean(got == np.array([y for _, y in fresh], bool)) > 0.95


@pytest.mark.parametrize("rows", [[], [("a b", "x", 0)] * 9, [("a b", None, 1)] * 9])
def test_one_label_rejects_nothing(rows):
    assert (toxicity.fit(rows).scores(*toxicity._buffers(TEXTS)) == 0).all()


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "q", 2.0), (2, "", "q", 2.0), (None, "a b", None, 1.0), (2, "a b", "q", 1.0), (2, "a b", "q", 1.0), (3, "w " * 200_000, "q", 0.0)], "doc_id long, text string, lang string, toxic_score double")
    got = toxicity.score(df, _net()).collect()
    assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in df.collect()]
    assert [r.toxic_score for r in got] == pytest.approx([_by_loops(_net(), t) for t in ("", "", "a b", "a b", "a b", "w " * 20)])
    assert toxicity.score(df.limit(0), _net()).collect() == []


def test_tables_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(None, None, 1), (1, 1, 1), (1, 0, 0), (2, 0, 7)], "doc_id long, toxic int, toxic_score int")
    assert [r.toxic_score for r in toxicity.toxicity(docs, labels.limit(0)).collect()] == [0, 0]
    assert [r.toxic_score for r in toxicity.toxicity(docs, labels).collect()] == [0, 0]
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


def test_sample_takes_all_of_few_and_a_share_of_many(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "10L AS bytes", "IF(id % 100 = 0, 1, 0) AS label")
    got = {r.label: r.n for r in hashed_sample(rows, "label", 1000, 1 << 30, "s").groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert got[1] == 200 and 900 < got[0] < 1100
    got = hashed_sample(rows, "label", 1000, 1000, "s").where("label = 0").count()
    assert 60 < got < 140
    assert hashed_sample(rows.where("false"), "label", 10, 10, "s").count() == 0


def test_query(spark, sf):
    sf = sf.replace("0.001", "0.01")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_toxicity(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    said = {(held, y): [r.predicted for r in got if r.held_out == held and toxic.get(r.doc_id) == y] for held in (False, True) for y in (0, 1)}
    assert np.mean(said[False, 1]) > 0.8 and np.mean(said[False, 0]) < 0.1 and np.mean(said[True, 0]) < 0.1


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    recall = np.mean([r.predicted for r in got if r.toxic == 1])
    fine = 1 - np.mean([r.predicted for r in got if r.toxic == 0])
    assert recall > 0.85 and fine > 0.95
