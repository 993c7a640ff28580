import random
import re

from wavemill.llm import queries
from wavemill.llm.jaccard_join import banding, jaccard_join, one_of_each_class


def brute(rows, t=0.8):
    sets = {}
    for i, text in rows:
        w = [x for x in re.findall("[0-9a-zA-Z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    kinds = {s for s in sets.values() if s}
    near = {s: [o for o in kinds if o != s and len(s & o) / len(s | o) >= t] for s in kinds}
    out = {}
    for i, s in sets.items():
        if not s:
            out[i] = (i, i, 0)
            continue
        seen, todo = {s}, [s]
        while todo:
            for o in near[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out[i] = (min(k for k, v in sets.items() if v == s), min(k for k, v in sets.items() if v in seen), len(near[s]))
    return out


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 30, 200]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 3]) * (len(x) > 20)):
                x[rng.randrange(len(x))] = word()
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    return rows + [(100001, None), (100002, ""), (100003, " ?! "), (100004, rows[0][1].upper() + "!")]


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, class_id int")
    for block, block_shingles in ((1000, 1 << 20), (7, 1 << 20), (1000, 300)):
        got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in jaccard_join(df, block=block, block_shingles=block_shingles).collect()}
        assert got == brute(rows)


def test_kept_rows(spark):
    rows = made(5)
    df = spark.createDataFrame([*rows, rows[0], (None, "lone text of six words here"), (None, None), (100001, None)], "doc_id long, text string")
    got = one_of_each_class(df).collect()
    want = brute(rows)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({c[1] for c in want.values()})
    assert sum(r.doc_id is None for r in got) == 2
    assert one_of_each_class(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in queries.op5_jaccard_join(spark, sf).collect()}
    assert got == brute(rows)


def test_kept_rows_have_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 1, {"k": 1}), (1, "a b c d e f", 0, {}), (2, "a b c d e f", 5, None), (3, "other words", 2, {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, row map<string,int>")
    got = [one_of_each_class(part) for part in (df.repartition(3), df.coalesce(1))]
    assert got[0].columns == df.columns
    first, again = (sorted(map(tuple, g.collect()), key=str) for g in got)
    assert first == again and [r[0] for r in first] == [1, 3] and first[0] in rows[:2]


def test_banding():
    b, r = banding(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999
