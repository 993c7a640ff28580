"""Repairs against a plain search over all edit strings, on small and on cut conversations."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from wavemill.llm import conversation_repair as C

SPACES = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract's columns of one conversation's (turn, role, text), by a search over states in plain Python."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(SPACES)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def grown(best):  # any number of insertions
        for _ in range(4):
            for state, (cost, audit, out) in list(best.items()):
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                new = (cost + 5, audit + "I", out + ({"u": "user", "a": "assistant"}[to] + ":",))
                best[to] = min(new, best.get(to, new))
        return best

    best = grown({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}
        for state, (cost, audit, out) in best.items():
            ways = [(state, cost + 2, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                to = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                ways.append((to, cost + 1 + more, "R", ({"u": "user", "a": "assistant"}[to] + ":" + text,)))
                if role[:1] == to or role[:1] == "s" and state == "":
                    ways.append((role[:1], cost + more, "K", (role + ":" + text,)))
            for to, c, e, line in ways:
                new = (c, audit + e, out + line)
                after[to] = min(new, after.get(to, new))
        best = grown(after)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    count = lambda f: faults.count(f)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def found(spark, rows, **cut):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    summaries, repaired = C.repair(df, **cut)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in C.digests(repaired).collect()}
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], hashes[r["conv_id"]]) for r in summaries.collect()}


def expected(rows):
    by: dict = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(rest)
    return {k: plain(v) for k, v in by.items()}


def conversations(seed, n, most):
    rng = random.Random(seed)
    for conv in range(n):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u"])
            text = rng.choice(["", " \n", "a.", "b", "c!", "d? ", f"text {rng.random()}.", f"cut {rng.random()}"])
            yield conv, 2 * turn if rng.random() < 0.9 else None, role, text


def test_tokens_against_all_edit_strings():
    """Every string of edits of up to three tokens and two insertions, tried out one by one."""
    import re

    def tried(tokens):
        best = None
        for n in range(3):
            for places in itertools.combinations_with_replacement(range(len(tokens) + 1), n):
                for edits in itertools.product("KRD", repeat=len(tokens)):
                    cost, audits, outs = 5 * n, "", [""]
                    for k in range(len(tokens) + 1):
                        for _ in range(places.count(k)):
                            audits, outs = audits + "I", [o + x for o in outs for x in "ua"]
                        if k == len(tokens):
                            break
                        tok, e = tokens[k], edits[k]
                        if e != "D" and tok == "x":
                            cost = 10**6
                        cost += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and tok.isupper())
                        audits += e
                        outs = outs if e == "D" else [o + tok.lower() for o in outs] if e == "K" else [o + x for o in outs for x in "ua"]
                    if cost < 10**6 and any(re.fullmatch("(s?(ua)+)?", o) for o in outs):
                        best = min(best or (cost, audits), (cost, audits))
        return best

    for n in range(4):
        for tokens in itertools.product("suaoxSUA", repeat=n):
            ways = C.parse("".join(tokens))
            assert min(ways[e] for e in C.ENDS if e in ways) == tried(tokens)


@pytest.mark.parametrize("cut", [{}, {"block_rows": 1}, {"block_rows": 3}, {"block_bytes": 4}])
def test_against_plain_python(spark, cut):
    rows = [r for r in conversations(7, 60, 9)]
    keep = {(c, t): (c, t, r, x) for c, t, r, x in rows if t is not None}  # one row a turn: ties have an order of their own
    rows = list(keep.values())
    assert found(spark, rows, **cut) == expected(rows)


def test_one_long_conversation(spark):
    """A conversation of many blocks, spread over several partitions."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 900)}" + rng.choice([".", ".", ".", "", "!"])) for t in range(3000)]
    assert found(spark, rows, block_rows=64) == expected(rows)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, a null key, unknown roles, very long texts."""
    rows = [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (5, None, None, None), (6, 3, "user", None), (7, 0, "user", "x." * 300_000), (7, 1, "assistant", "y."), (8, 0, "tool", "z."), (8, 4, "tool", "q."), (9, 1, "user", "r."), (9, 1, "user", "r."), (9, 2, "assistant", "s.")]
    assert found(spark, rows) == expected(rows)
    assert found(spark, rows)[9][6] == "KDK"
    assert found(spark, []) == {}


def test_report(spark):
    """Damage and report: a conversation that lost all its rows stays; columns of other names do not disturb."""
    import zlib

    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    talks = spark.createDataFrame([(gone, 0, "user", "a.", 1, "x")] + [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.", 1, "y") for c in range(20_000, 20_040) for t in range(4)], "conv_id bigint, turn bigint, role string, text string, cost int, audit string")
    got = {r["conv_id"]: r for r in C.repair_report(talks, C.damaged(talks)).collect()}
    assert len(got) == 41 and got[gone]["audit"] == "" and got[gone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    by: dict = {}
    for r in C.damaged(talks).collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for k, rows in by.items():
        assert tuple(got[k][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == plain(rows)
    kinds = {(r["conv_id"], r["turn"]): zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20 for r in talks.collect()}
    n = C.damaged(talks).groupBy("conv_id", "turn").agg(F.count("*").alias("n")).collect()
    assert {(r["conv_id"], r["turn"]): r["n"] for r in n} == {k: 1 + (v == 3) for k, v in kinds.items() if v}
