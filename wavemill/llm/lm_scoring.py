"""Perplexity by an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tasks pre-aggregate their word pairs and exchange them as packed arrays. Pairs are dealt by the hash of the context, so
that a shard sees every continuation of it; contexts that hold a large share of all tokens are found first and their
pairs dealt by pair, so no word makes a large shard. Shards write sorted hash arrays to the shared folder; a second,
smaller exchange by word adds up in how many contexts each word occurs, and what the shards know of the frequent
contexts. Scoring tasks memory-map the arrays.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, crc_residue, freed_shuffles, mounted, schema_of, scratch
from .keysets import publish

SLICE_BYTES = 4 << 20
#: Pairs a task holds before it packs them.
HELD_PAIRS = 3 << 19
#: A context with this share of a shard's tokens, or of one in MOST_HOT tokens, is dealt by pair. It only decides where pairs go.
HOT_SHARE, MOST_HOT = 0.25, 1 << 16
#: Stand-ins for the start and the end of a text; words never hash to them by construction of their bytes.
START, END = K.mix(np.array([1, 2], np.uint64) + np.uint64(1 << 40))
_PACKED = pa.schema([("bucket", pa.int32()), ("a", pa.binary()), ("n", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_PACKED_SPARK = schema_of(bucket="int", a="binary", n="binary", b="binary", c="binary")
#: What shards pass on: kind w (words and in how many contexts they occur), h (frequent contexts and their sums), s (sums over all).
_PASSED = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("key", pa.binary()), ("value", pa.binary())])
_PASSED_SPARK = schema_of(bucket="int", kind="string", key="binary", value="binary")


def sequences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, token and row of every token of each text: its words and one end."""
    n = len(offsets) - 1
    low = K.lower_ascii(buf)
    starts, ends, rows = K.spans(low, offsets, K.NOT_SPACE)
    hashes = K.hash_spans(low, starts, ends)
    token, ctx = np.empty(len(hashes) + n, np.uint64), np.empty(len(hashes) + n, np.uint64)
    counts = np.bincount(rows, minlength=n)
    last = np.cumsum(counts + 1) - 1
    at = np.arange(len(hashes)) + rows
    token[last], token[at] = END, hashes
    ctx[1:] = token[:-1]
    ctx[last - counts] = START
    return ctx, token, np.repeat(np.arange(n), counts + 1)


def pack_counts(a: np.ndarray, b: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b) with summed counts, as sorted a, pairs of each a, b and counts."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(a))) if c is None else np.add.reduceat(c[order], at) if len(at) else np.zeros(0, np.int64)
    a, b = a[at], b[at]
    heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    return a[heads], np.diff(np.append(heads, len(a))), b, count


def _narrow(x: np.ndarray) -> bytes:
    """Non-negative integers behind one byte that tells their width."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in "BHIQ" if top <= np.iinfo(np.dtype(k)).max)
    return kind.encode() + x.astype(kind).tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], chr(x[0])).astype(np.int64)


def _words(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _pack(a: np.ndarray, n: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket: the first ``bits`` bits of a, or of the pair's hash where a is ``hot``."""
    a = np.repeat(a, n)
    deal = np.where(K.lookup(hot, a)[1], K.pair_hash(a, b), a) if len(hot) else a
    bucket = (deal >> np.uint64(64 - bits)).astype(np.int64)
    if len(hot):
        order = np.argsort(bucket, kind="stable")
        a, b, c, bucket = a[order], b[order], c[order], bucket[order]
    for i, j in _cuts(bucket, bits):
        heads = np.flatnonzero(np.append(True, a[i + 1 : j] != a[i : j - 1]))
        yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[i]), "a": a[i:j][heads].tobytes(), "n": _narrow(np.diff(np.append(heads, j - i))), "b": b[i:j].tobytes(), "c": _narrow(c[i:j])}], _PACKED)


def _cuts(bucket: np.ndarray, bits: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _pass_on(kind: str, key: np.ndarray, values: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket of the sorted keys."""
    for i, j in _cuts((key >> np.uint64(64 - bits)).astype(np.int64), bits):
        yield pa.RecordBatch.from_pylist([{"bucket": int(key[i] >> np.uint64(64 - bits)), "kind": kind, "key": key[i:j].tobytes(), "value": _narrow(values[i:j].ravel())}], _PASSED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The packed rows of each bucket; rows come sorted by bucket."""
    held, bucket = [], None
    for batch in batches:
        for row in batch.to_pylist():
            if bucket is not None and row["bucket"] != bucket:
                yield bucket, held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield bucket, held


def hot_contexts(texts: DataFrame, share: float) -> np.ndarray:
    """Sorted contexts that have about ``share`` of all tokens or more; at most 2 / share of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in K.balanced(batch, SLICE_BYTES):
                ctx, times = np.unique(sequences(buf, offsets)[0], return_counts=True)
                often = times >= share * times.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(ctx[often].view(np.int64), 0)), pa.array(np.append(times[often], 0)), pa.array(np.append(np.zeros(int(often.sum()), np.int64), times.sum()))], names=["ctx", "times", "tokens"])

    work = Work(texts.sparkSession)
    reported = texts.mapInArrow(run, schema_of(ctx="bigint", times="bigint", tokens="bigint"))
    found = work.saved(reported.groupBy("ctx").agg(F.sum("times").alias("times"), F.sum("tokens").alias("tokens")), "often")
    total = found.agg(F.sum("tokens")).first()[0] or 0
    rows = found.where((F.col("times") > 0) & (F.col("times") * 2 >= share * total)).select("ctx").collect()  # 2 / share at most
    work.drop("often")
    return np.sort(np.array([r["ctx"] for r in rows], np.int64).view(np.uint64))


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Chen and Goodman's discounts of counts 0, 1, 2 and 3 or more; 0.5 each where counts of counts are too thin."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 1e-3, 1e-3, 1e-3], [0, 1, 2, 3])


def train(docs: DataFrame, bits: int | None = None, hot_share: float = HOT_SHARE) -> dict:
    """Count the texts of ``docs`` (column text; null is empty) and write the model; returns its folder and totals."""
    spark = docs.sparkSession
    parts = docs.select("text").rdd.getNumPartitions()
    bits = bits or max(3, (max(parts, 1) - 1).bit_length())
    folder, shards = mounted(scratch(spark, "ngrams")), 1 << bits
    texts = docs.select("text")
    hot = hot_contexts(texts, max(hot_share / shards, 1 / MOST_HOT))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, buf, offsets in K.balanced(batch, SLICE_BYTES):
                ctx, token, _ = sequences(buf, offsets)
                held.append((ctx, token))
                size += len(ctx)
                if size >= HELD_PAIRS:
                    yield from _pack(*pack_counts(*(np.concatenate(x) for x in zip(*held)), None), bits, hot)
                    held, size = [], 0
        if held:
            yield from _pack(*pack_counts(*(np.concatenate(x) for x in zip(*held)), None), bits, hot)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            a = np.concatenate([np.repeat(_words(r["a"]), _wide(r["n"])) for r in rows])
            b, c = np.concatenate([_words(r["b"]) for r in rows]), np.concatenate([_wide(r["c"]) for r in rows])
            rows.clear()
            ctx, kinds, word, n = pack_counts(a, b, c)
            del a, b, c
            heads = np.cumsum(kinds) - kinds
            sums = np.stack([np.add.reduceat(x, heads) for x in (n, n == 1, n == 2, n >= 3)], 1).astype(np.int64)
            pair = K.pair_hash(np.repeat(ctx, kinds), word)
            order = np.argsort(pair)
            small = np.minimum(n[order], 255)
            big = np.flatnonzero(small == 255)
            publish(folder, f"p{bucket}", key=pair[order], count=small.astype(np.uint8), big=big, big_count=n[order][big])
            shared = K.lookup(hot, ctx)[1]
            own = sums[~shared]
            publish(folder, f"c{bucket}", key=ctx[~shared], total=own[:, 0], n1=own[:, 1].astype(np.uint32), n2=own[:, 2].astype(np.uint32), n3=own[:, 3].astype(np.uint32))
            of = np.array([np.count_nonzero(n == k) for k in (1, 2, 3, 4)] + [len(own), int(n.sum())], np.int64)
            yield pa.RecordBatch.from_pylist([{"bucket": bucket, "kind": "s", "key": b"", "value": of.tobytes()}], _PASSED)
            yield from _pass_on("h", ctx[shared], sums[shared], bits)
            yield from _pass_on("w", *np.unique(word, return_counts=True), bits)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            total = np.sum([np.frombuffer(r["value"], np.int64) for r in rows if r["kind"] == "s"] + [np.zeros(6, np.int64)], axis=0)
            part = lambda kind: [(_words(r["key"]), _wide(r["value"])) for r in rows if r["kind"] == kind] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]  # noqa: B023, E731
            keys, sums = zip(*part("h"))
            ctx, back = np.unique(np.concatenate(keys), return_inverse=True)
            added = np.zeros((len(ctx), 4), np.int64)
            np.add.at(added, back, np.concatenate(sums).reshape(-1, 4))
            publish(folder, f"h{bucket}", key=ctx, total=added[:, 0], n1=added[:, 1], n2=added[:, 2], n3=added[:, 3])
            total[4] += len(ctx)
            yield pa.RecordBatch.from_pylist([{"kind": "pairs", "sums": total.tolist()}], _SUMS)
            keys, sums = zip(*part("w"))
            w, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(w), np.int64)
            np.add.at(n, back, np.concatenate(sums))
            publish(folder, f"w{bucket}", key=w, count=n)
            of = [int(np.count_nonzero(n == k)) for k in (1, 2, 3, 4)] + [len(w), int(n.sum()), int(np.count_nonzero(n >= 3))]
            yield pa.RecordBatch.from_pylist([{"kind": "words", "sums": of}], _SUMS)

    packed = texts.mapInArrow(count, _PACKED_SPARK).repartition(shards, "bucket").sortWithinPartitions("bucket")
    counted = packed.mapInArrow(contexts, _PASSED_SPARK)
    sums = counted.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(words, schema_of(kind="string", sums="array<bigint>"))
    with freed_shuffles(spark):
        exploded = sums.select("kind", F.posexplode("sums").alias("k", "v")).groupBy("kind", "k").agg(F.sum("v").alias("v")).collect()  # 13 numbers
    found = {(r["kind"], r["k"]): r["v"] for r in exploded}
    get = lambda kind, k: float(found.get((kind, k), 0))
    return {
        "folder": folder,
        "bits": bits,
        "hot": hot,
        "pair_d": discounts(*(get("pairs", k) for k in range(4))),
        "word_d": discounts(*(get("words", k) for k in range(4))),
        "word_kinds": (get("words", 0), get("words", 1), get("words", 6)),
        "word_total": get("words", 5),
        "distinct": int(get("pairs", 4)),
        "tokens": int(get("pairs", 5)),
    }


_SUMS = pa.schema([("kind", pa.string()), ("sums", pa.list_(pa.int64()))])


class Model:
    """Memory-mapped shards of a trained model."""

    def __init__(self, about: dict):
        self.about, self.maps = about, {}

    def array(self, shard: str, name: str) -> np.ndarray:
        key = f"{shard}.{name}"
        if key not in self.maps:
            path = f"{self.about['folder']}/{key}.npy"
            self.maps[key] = np.load(path, mmap_mode="r") if os.path.exists(path) else np.zeros(0, np.uint64)
        return self.maps[key]

    def find(self, kind: str, shard_of: np.ndarray, wanted: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values under ``wanted`` keys, 0 where a key is missing; keys are looked up shard by shard in sorted order."""
        out = [np.zeros(len(wanted), np.float64) for _ in names]
        order = np.lexsort((wanted, shard_of))
        cuts = np.flatnonzero(np.diff(shard_of[order].astype(np.int64), prepend=-1, append=1 << 62))
        for i, j in zip(cuts[:-1], cuts[1:]):
            rows = order[i:j]
            shard = f"{kind}{int(shard_of[rows[0]])}"
            at, known = K.lookup(self.array(shard, "key"), wanted[rows])
            for o, name in zip(out, names):
                values = self.array(shard, name)[at[known]]
                if name == "count" and kind == "p":
                    values = values.astype(np.int64)
                    over = np.flatnonzero(values == 255)
                    if len(over):
                        values[over] = self.array(shard, "big_count")[np.searchsorted(self.array(shard, "big"), at[known][over])]
                o[rows[known]] = values
        return out

    def log_probs(self, ctx: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p(token | ctx) and the training count of each token."""
        m, shift = self.about, np.uint64(64 - self.about["bits"])
        every, back = np.unique(np.concatenate([ctx, token]), return_inverse=True)
        names = ("total", "n1", "n2", "n3")
        total, n1, n2, n3 = (x + y for x, y in zip(self.find("c", every >> shift, every, names), self.find("h", every >> shift, every, names)))
        (kinds,) = self.find("w", every >> shift, every, ("count",))
        d = m["word_d"]
        unseen = 1 / (m["distinct"] + 1)
        if m["word_total"]:
            spare = (d[1] * m["word_kinds"][0] + d[2] * m["word_kinds"][1] + d[3] * m["word_kinds"][2]) / m["word_total"]
            lower = np.maximum(kinds - d[np.minimum(kinds, 3).astype(int)], 0) / m["word_total"] + spare * unseen
        else:
            lower = np.full(len(every), unseen)
        start = np.searchsorted(every, START)
        of = total.copy()
        if start < len(every) and every[start] == START:
            of[every == END] = total[start]  # a text ends as often as one starts
        c_ix, t_ix = back[: len(ctx)], back[len(ctx) :]
        code = c_ix.astype(np.int64) * len(every) + t_ix
        _, first, again = np.unique(code, return_index=True, return_inverse=True)
        c, t = c_ix[first], t_ix[first]
        pair = K.pair_hash(every[c], every[t])
        deal = np.where(K.lookup(m["hot"], every[c])[1], pair, every[c])
        (count,) = self.find("p", deal >> shift, pair, ("count",))
        d = m["pair_d"]
        gamma = d[1] * n1 + d[2] * n2 + d[3] * n3
        p = np.where(total[c] > 0, (np.maximum(count - d[np.minimum(count, 3).astype(int)], 0) + gamma[c] * lower[t]) / np.maximum(total[c], 1), lower[t])
        return np.log10(p)[again], of[t_ix]


_MODELS: dict[str, Model] = {}


def score(docs: DataFrame, about: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs`` under a trained model.

    A null or empty text is one end token. Rows are independent: repeated rows repeat, an empty table gives none. A
    model trained on nothing gives every token the same probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _MODELS.get(about["folder"]) or _MODELS.setdefault(about["folder"], Model(about))
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES):
                n = part.num_rows
                ctx, token, rows = sequences(buf, offsets)
                logs, seen = model.log_probs(ctx, token)
                base = np.log10((seen + 0.5) / (about["tokens"] + 0.5 * (about["distinct"] + 1)))
                sums = [np.bincount(rows, minlength=n), np.bincount(rows, weights=seen > 0, minlength=n).astype(np.int64), np.full(n, about["tokens"]), np.bincount(rows, weights=base, minlength=n), np.bincount(rows, weights=logs, minlength=n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, schema_of(doc_id=docs.schema["doc_id"].dataType.simpleString(), n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double"))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_scores(docs: DataFrame, held_out: int = 1, hot_share: float = HOT_SHARE) -> DataFrame:
    """Train on the rows whose crc32 fold is not ``held_out`` and score all rows."""
    about = train(docs.where(crc_residue("doc_id") != held_out), hot_share=hot_share)
    return score(docs, about).withColumn("held_out", crc_residue("doc_id") == held_out)
