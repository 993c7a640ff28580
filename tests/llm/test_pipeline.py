"""Each stage of the pipeline against plain Python, on what its predecessor really kept."""

import re
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from test_toxicity import _by_loops

import corpus_pipeline
from wavemill.llm import piece_sampling, pii, toxicity
from wavemill.llm.common import load


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def keep_one_of_near_copies(rows):
    def shingles(text):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", _low(text))
        return frozenset(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else None

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (a == b or 10 * len(a & b) >= 8 * len(a | b)):
                root[find(i)] = find(j)
    fp = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    best = {}
    for i, (doc, text) in enumerate(rows):
        if sets[i]:
            best[find(i)] = min(best.get(find(i), (1 << 70, 0)), (doc, signed(fp(text))))
    return {r for i, r in enumerate(rows) if not sets[i] or (r[0], signed(fp(r[1]))) == best[find(i)]}


def contaminated(text, windows):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _low(text))
    hit = set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = load(spark, sf, "documents")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), f"test-{name}")
        seen.append(docs.collect())
        if name != "pieces":
            assert docs.columns == load(spark, sf, "documents").columns
    return seen


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]


def test_toxicity(spark, sf, stages):
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    net = toxicity.fitted(toxicity.labelled_sample(docs, labels))
    want = [r for r in stages[0] if not net.fitted or _by_loops(net, r.text[:4000]) < 0.5 and len(r.text) <= 4000]
    got = set(stages[1])
    assert set(want) <= got and got <= set(stages[0])
    short = {r for r in stages[0] if len(r.text) <= 4000}
    assert {r for r in got if r in short} == set(want)


def test_near_duplicates(stages):
    assert {(r.doc_id, r.text) for r in stages[2]} == keep_one_of_near_copies([(r.doc_id, r.text) for r in stages[1]])


def test_decontamination(spark, sf, stages):
    windows = set()
    for r in load(spark, sf, "benchmark").collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", _low(r.text))
        n = min(13, len(w))
        windows.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    assert Counter(stages[3]) == Counter(r for r in stages[2] if not contaminated(r.text, windows))


def test_personal_data(stages):
    names = pii.Pseudonyms(corpus_pipeline.PII_KEY)
    want = {r.doc_id: pii.replaced(r.text, names, Counter()) for r in stages[3]}
    assert {r.doc_id: r.text for r in stages[4]} == want
    assert {r.doc_id: pii.replaced(r.text, names, Counter(), back=True) for r in stages[4]} == {r.doc_id: r.text for r in stages[3]}


def test_pieces(spark, stages):
    got = {r.doc_id: r for r in stages[5]}
    assert {i: r.text for i, r in got.items()} == {r.doc_id: r.text for r in stages[4]}
    df = spark.createDataFrame([(r.doc_id, list(r.pieces)) for r in got.values()], "doc_id long, pieces array<int>")
    back = piece_sampling.decode(df, public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.decoded for r in back.collect()} == {i: r.text for i, r in got.items()}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b c d e f", "en", "s", 3), (3, "x " * 60_000, "en", "s", 1), (4, "same words here and there again", "en", "s", 1), (4, "same words here and there again", "en", "s", 1), (5, "same words here and there again", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, part in (("full", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        part.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        want = [(None, "a b c d e f"), (1, None), (2, ""), (3, "x " * 60_000), (4, "same words here and there again")] if name == "full" else []
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
