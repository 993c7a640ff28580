import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Row

from wavemill.llm import decontamination, quality_rules, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, n):
    items = {}
    for i, t in bench:
        w = words(t)
        items.setdefault(i, set()).update(tuple(w[k : k + min(len(w), n)]) for k in range(len(w) - min(len(w), n) + 1) if w)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, windows in items.items():
            for x in windows:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination(spark, limit):
    item = "The quick BROWN fox jumps over a lazy dog and runs far away today again"
    bench = [(1, item), (10, "short one"), (2, None), (3, "..."), (4, item + " É end"), (5, "ÉTÉ a"), (None, "null item words"), (1, "third text")]
    docs = [(1, "x " * 40 + item.upper().replace(" ", ", ") + " tail"), (2, "Short, one! short one"), (3, None), (4, ""), (5, item + " " + item + " é end É end"), (6, "ÉTÉ A éTÉ a été a"), (7, "clean words only " * 30), (7, "short one"), (None, "null item words"), (8, "y " * 60000 + "third text"), (2, "Short, one! short one")]
    d = spark.createDataFrame([Row(doc_id=i, text=t, contaminated="clash") for i, t in docs], "doc_id long, text string, contaminated string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.decontaminate(d, b, 13, 20, limit)
    assert sorted(((r.doc_id, r.doc_n_words, r.doc_n_hit, r.doc_items, r.contaminated) for r in got.collect()), key=str) == brute(docs, bench, 13)
    cut = {r.doc_id: r.text for r in decontamination.without_spans(got).collect() if r.doc_id in (1, 4, 7)}
    assert cut[1] == "x " * 40 + "tail" and cut[4] == ""
    none = decontamination.decontaminate(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontamination.decontaminate(d.limit(0), b).collect() == []


def test_decontamination_keeps_columns_of_any_name(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, item, 1, 2, 3, 4), (2, "clean", 5, 6, 7, 8), (2, "clean", 5, 6, 7, 8), (None, None, 0, 0, 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, s_id int, s_fp int, key int, row int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontamination.decontaminate(d, b)
    assert got.columns[:6] == d.columns
    assert sorted((tuple(r)[:6] for r in got.collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, decontamination.without_contaminated(d, b).collect()), key=str) == sorted(rows[1:], key=str)
    assert decontamination.without_contaminated(d.limit(0), b).collect() == []


def base_columns(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(tri)
    rep = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)


def test_quality_base(spark):
    texts = [None, "", "one two", "a b c a b c a b c", "l1 x\nl1 x\n\n \nl2\nl1 x", "é ñ 漢字 #|<>", " \t\x0b\x0c\r\n", "w " * 30000, "a\x1cb c", "same line\n" * 60, "tail x y z x y z"]
    rows = [(i, t, "en" if i % 2 else None, 0) for i, t in enumerate(texts)] + [(None, "k l m", "en", 0)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")).collect()
    assert len(got) == len(rows)
    want = {i: base_columns(t) for i, t, *_ in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


def test_quality_blank_lines(spark):
    texts = ["a\n\nb\n\nc\n\n\n", "a\n \t\x0b\x0c\r\n \t\x0b\x0c\r\na\nb", "x \t\x0b\x0c\ry\nx \t\x0b\x0c\ry\n", "\n\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r.doc_id: r.n_dup_lines for r in quality_rules.text_counts(df).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0} == {i: base_columns(t)[3] for i, t in enumerate(texts)}


def test_quality_divergence(spark, sf):
    docs = [(r.doc_id, r.lang, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts, ref_chars, ref_hits, per = defaultdict(Counter), {}, {}, {}
    for _, lang, t in docs:
        counts[lang].update(x for x in (w.lower() for w in re.findall("[^\x20\x09-\x0d]+", t)) if len(x) <= quality_rules.WORD_CHARS)
    common = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.WORDS]] for k, c in counts.items()}
    for i, lang, t in docs:
        n, solid, symbols, *_ = base_columns(t)
        up, low, dig = (len(re.findall(p, t)) for p in ("[A-Z]", "[a-z]", "[0-9]"))
        wide = sum(ord(c) > 127 for c in t)
        chars = [up, low, dig, wide, len(t) - solid, symbols, solid - up - low - dig - wide - symbols]
        c = Counter(w.lower() for w in re.findall("[^\x20\x09-\x0d]+", t))
        hits = [c[w] for w in common[lang]]
        per[i] = (lang, chars, [*hits, n - sum(hits)])
        ref_chars[lang] = [a + b for a, b in zip(ref_chars.get(lang, [0] * 7), per[i][1])]
        ref_hits[lang] = [a + b for a, b in zip(ref_hits.get(lang, [0] * 25), per[i][2])]

    def js(p, q):
        if not (sum(p) and sum(q)):
            return 0.0
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a else 0.0
        return math.sqrt(max(sum((part(a, b) + part(b, a)) / 2 for a, b in zip(p, q)), 0))

    for r in quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        lang, chars, hits = per[r.doc_id]
        assert r.char_distance == pytest.approx(js(chars, ref_chars[lang]), abs=1e-9)
        assert r.word_distance == pytest.approx(js(hits, ref_hits[lang]), abs=1e-9)
        expected = sum(hits) * sum(ref_hits[lang][:-1]) >= quality_rules.LEAST_HITS * sum(ref_hits[lang])
        common_distance = (js(hits[:-1], ref_hits[lang][:-1]) if sum(hits[:-1]) else 1.0) if expected and sum(ref_hits[lang][:-1]) else 0.0
        assert r.common_distance == pytest.approx(common_distance, abs=1e-9)
        n, _, _, _, repeats = base_columns(dict((i, t) for i, _, t in docs)[r.doc_id])
        judged = sum(chars) >= quality_rules.LEAST_CHARS and n >= quality_rules.LEAST_WORDS
        apart = judged and (r.char_distance > quality_rules.MOST_CHARS or max(r.word_distance, common_distance) > quality_rules.MOST_WORDS)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and r.kept == (not r.base_failed and not apart)
    query = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, sf).collect()}
    assert query == {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).collect()}


def test_quality_common_words(spark):
    long = ["whatsoever", "notwithstanding", "heretofore", "aforementioned"]
    usual = ["the", "of", "and", "to", *long]
    text = lambda i, n, common: " ".join(usual[(k // 3 + i) % 8] if common and k % 3 == 0 else f"w{i}x{k}" for k in range(n))
    rows = [(i, text(i, 90 + i % 7, True), "en") for i in range(60)] + [(60, text(60, 90, False), "en"), (61, text(61, 30, False), "en"), (62, text(62, 60, True), "en")]
    rows += [(100 + i, text(100 + i, 60, False), "xx") for i in range(40)]  # no words in common use: nothing is held against it
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(long) < set(next(r.common for r in quality_rules.common_words(df).collect() if r.lang == "en"))
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert got[60].common_distance == 1 and not got[60].base_failed and not got[60].kept
    assert all(got[i].kept for i, *_ in rows if i not in (60, 61)) and got[61].base_failed
