"""Toxicity by a small convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the mean of the vectors that its own hash and the hashes of its beginnings and its end have, so words
that were never seen share what they have in common with known ones. The net is fitted in NumPy, in one task, on a
bounded sample of labelled rows. At scoring each filter tap is a table lookup by word, so a text of any length takes
additions and a running maximum. Thresholds are set for each language and folded into the score so that 0.5 is the
decision everywhere. The language is read off the words; the lang of the sampled rows only teaches what a language's
words look like, and no row's lang is read when it is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import crc_residue, hashed_sample, schema_of

#: Labelled rows, and bytes of their texts, that are drawn of each label on average. Texts of any length can be drawn.
SAMPLE_ROWS, SAMPLE_BYTES = 2500, 12 << 20
#: Buckets of the hashed features, bytes of the beginnings and the end of a word that are features beside the whole, and sizes of the net.
BUCKETS, FIRST, LAST = 1 << 15, (3, 4, 5, 6), 4
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
#: Passes over the sample at most, passes without a lower held-back loss that end the fit, rows of a step, learning rate.
EPOCHS, PATIENCE, STEP_ROWS, RATE = 14, 3, 32, 0.01
#: Held-back rows of each label that a threshold needs (with fewer the plain 0.5 stands), and what the share of clean rows
#: left alone weighs beside the share of toxic ones caught.
LEAST_HELD, CLEAN_WEIGHT = 20, 3.0
SLICE_BYTES = 512 << 10
#: Letters of words: ASCII letters and every byte of wider characters.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def _ranges(heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices heads[k] ... heads[k] + counts[k] - 1, one range behind another."""
    return np.repeat(heads - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


@dataclass
class Words:
    """Texts as indices of their distinct words, and a row of hashed features for each of those."""

    of: np.ndarray
    rows: np.ndarray
    features: np.ndarray


def read_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    low = K.lower_ascii(buf)
    starts, ends, rows = K.spans(low, offsets, _WORD)
    every, at, of = np.unique(K.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    starts, ends = starts[at], ends[at]
    found, h, last = [every], np.full(len(every), 1, np.uint64), max(len(low) - 1, 0)
    for k in range(max(FIRST)):
        inside = starts + k < ends
        h = h * _STEP + np.where(inside, low[np.minimum(starts + k, last)], 0) if len(every) else h
        if k + 1 in FIRST:
            found.append(K.mix(h + np.uint64(k)))
    h = np.full(len(every), 2, np.uint64)
    for k in range(LAST):
        inside = ends - 1 - k >= starts
        h = h * _STEP + np.where(inside, low[np.maximum(ends - 1 - k, 0)], 0) if len(every) else h
    return Words(of, rows, (np.stack([*found, K.mix(h)], 1) % np.uint64(BUCKETS)).astype(np.int64))


def laid(of: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """1 + word indices with max(WIDTHS) zeros behind each row, and where each row's windows begin and end.

    The last window begins at the first zero, so none reaches into the next row.
    """
    pad = max(WIDTHS)
    counts = np.bincount(rows, minlength=n)
    begin = np.cumsum(counts + pad) - counts - pad
    out = np.zeros(int(counts.sum()) + pad * n, np.int64)
    out[np.arange(len(of)) + rows * pad] = of + 1
    return out, np.stack([begin, begin + counts + 1], 1).ravel()


@dataclass
class Net:
    """emb and lang_table have a row for each bucket; shift: the threshold of each language, of none at the end."""

    emb: np.ndarray
    conv: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    langs: list[str]
    lang_table: np.ndarray
    shift: np.ndarray
    fitted: bool = False

    def vectors(self, features: np.ndarray, table: np.ndarray) -> np.ndarray:
        """The mean of the features' rows of each word, behind a row of zeros for the padding."""
        out = np.zeros((len(features) + 1, table.shape[1]), table.dtype)
        for k in range(features.shape[1]):
            out[1:] += table[features[:, k]]
        return out / features.shape[1]

    def logits(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw logit and language index (last: no words) of each text."""
        n, words = len(offsets) - 1, read_words(buf, offsets)
        ids, begin = laid(words.of, words.rows, n)
        vectors, parts = self.vectors(words.features, self.emb), []
        for w, b in zip(self.conv, self.bias):
            y = (vectors @ w[0])[ids]
            for j in range(1, len(w)):
                y[: len(ids) - j] += (vectors @ w[j])[ids[j:]]
            parts.append(np.maximum(np.maximum.reduceat(y, begin, axis=0)[::2] + b, 0) if n else np.zeros((0, FILTERS)))
        logit = np.concatenate(parts, 1) @ self.out + self.out_bias
        votes = self.vectors(words.features, self.lang_table)[1:]
        lang = np.stack([np.bincount(words.rows, weights=votes[words.of, j], minlength=n) for j in range(len(self.langs))], 1).argmax(1) if self.langs else np.zeros(n, np.int64)
        return logit, np.where(np.bincount(words.rows, minlength=n) > 0, lang, len(self.langs))

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """0 to 1; a net that was fitted on fewer than two labels finds nothing toxic."""
        if not self.fitted:
            return np.zeros(len(offsets) - 1)
        logit, lang = self.logits(buf, offsets)
        return 1 / (1 + np.exp(-np.clip(logit - self.shift[lang], -60, 60)))


class _Adam:
    """Adam steps; a table of embeddings only moves in the rows that a step touches."""

    def __init__(self, params: list[np.ndarray]):
        self.params, self.m, self.v, self.t = params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def step(self, grads: list, rows: np.ndarray) -> None:
        self.t += 1
        for k, (p, g, m, v) in enumerate(zip(self.params, grads, self.m, self.v)):
            at = rows if k == 0 else slice(None)
            m[at] += 0.1 * (g - m[at])
            v[at] += 0.001 * (g * g - v[at])
            p[at] -= RATE * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.999**self.t)) + 1e-8)


def _gradients(net: Net, words: Words, first: np.ndarray, chunk: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
    """Gradients of the weighted log loss over the rows ``chunk``, and the rows of emb that the first one is for."""
    idx = _ranges(first[chunk], first[chunk + 1] - first[chunk])
    row = np.repeat(np.arange(len(chunk)), first[chunk + 1] - first[chunk])
    mine, of = np.unique(words.of[idx], return_inverse=True)
    ids, begin = laid(of, row, len(chunk))
    at_row = np.searchsorted(begin[::2], np.arange(len(ids)), "right") - 1
    vectors, n = net.vectors(words.features[mine], net.emb), len(ids)
    pooled, argmax = [], []
    for w, b in zip(net.conv, net.bias):
        y = (vectors @ w[0])[ids]
        for j in range(1, len(w)):
            y[: n - j] += (vectors @ w[j])[ids[j:]]
        best = np.maximum.reduceat(y, begin, axis=0)[::2]
        argmax.append(np.minimum.reduceat(np.where(y == best[at_row], np.arange(n)[:, None], n), begin, axis=0)[::2])
        pooled.append(best + b)
    z = np.concatenate(pooled, 1)
    a = np.maximum(z, 0)
    p = 1 / (1 + np.exp(-np.clip(a @ net.out + net.out_bias, -30, 30)))
    d = weight[chunk] * (p - label[chunk]) / len(chunk)
    grads: list = [None, *(np.zeros_like(w) for w in net.conv), *(np.zeros_like(b) for b in net.bias), a.T @ d + 1e-4 * net.out, np.array([d.sum()])]
    dz = d[:, None] * net.out * (z > 0)
    moved = np.zeros_like(vectors)
    for k, (w, at) in enumerate(zip(net.conv, argmax)):
        g = dz[:, k * FILTERS : (k + 1) * FILTERS]
        grads[1 + len(WIDTHS) + k] = g.sum(0)
        for j in range(len(w)):
            pos = ids[np.minimum(at + j, n - 1)]
            grads[1 + k][j] = np.einsum("rfd,rf->df", vectors[pos], g) + 1e-4 * w[j]
            np.add.at(moved, pos.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
    hit = np.flatnonzero(moved[1:].any(1))
    features = words.features[mine[hit]]
    order = np.argsort(features.ravel(), kind="stable")
    rows, at = np.unique(features.ravel()[order], return_index=True)
    each = (moved[1:][hit] / features.shape[1])[order // features.shape[1]]
    grads[0] = np.add.reduceat(each, at, axis=0) + 1e-4 * net.emb[rows] if len(rows) else np.zeros((0, DIM))
    return grads, rows


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.text_buffer(pa.array(texts, pa.string()))


def _loss(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / weight.sum())


def fit(rows: list[tuple[str, str | None, int]], seed: int = 7) -> Net:
    """Fit on (text, lang, label) rows; each fifth row of a label is kept back to end the fit and set the thresholds.

    Both labels weigh the same. Without rows of both labels the net stays unfitted and finds nothing toxic.
    """
    rng = np.random.default_rng(seed)
    langs = sorted({r[1] for r in rows if r[1] is not None})
    net = Net(rng.normal(0, 0.3, (BUCKETS, DIM)), [rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0, langs, np.zeros((BUCKETS, max(1, len(langs)))), np.zeros(len(langs) + 1))
    label = np.array([r[2] for r in rows], float)
    if not 0 < label.sum() < len(rows):
        return net
    words = read_words(*_buffers([r[0] for r in rows]))
    lang = np.array([langs.index(r[1]) if r[1] is not None else -1 for r in rows])
    for j in range(len(langs)):
        times = np.bincount(words.of[lang[words.rows] == j], minlength=len(words.features))
        per = np.bincount(words.features.ravel(), weights=np.repeat(times, words.features.shape[1]), minlength=BUCKETS)
        net.lang_table[:, j] = np.log((per + 0.5) / (per.sum() + 0.5 * BUCKETS))
    nth = np.zeros(len(rows), np.int64)
    for x in (0, 1):
        nth[label == x] = np.arange(int((label == x).sum()))
    held = nth % 5 == 4
    train, kept = np.flatnonzero(~held), np.flatnonzero(held)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    first = np.searchsorted(words.rows, np.arange(len(rows) + 1))
    bias = np.zeros(1)
    adam = _Adam([net.emb, *net.conv, *net.bias, net.out, bias])
    texts = _buffers([rows[i][0] for i in kept])
    best, since, saved = np.inf, 0, None
    for _ in range(EPOCHS):
        for chunk in np.array_split(rng.permutation(train), max(1, len(train) // STEP_ROWS)):
            adam.step(*_gradients(net, words, first, chunk, label, weight))
            net.out_bias = float(bias[0])
        loss = _loss(net.logits(*texts)[0], label[kept], weight[kept]) if len(kept) else 0.0
        if loss < best - 1e-4:
            best, since, saved = loss, 0, pickle.dumps(net)
        else:
            since += 1
            if since == PATIENCE:
                break
    net = pickle.loads(saved) if saved else net
    net.fitted = True
    logit, which = net.logits(*texts) if len(kept) else (np.zeros(0), np.zeros(0, int))
    enough = lambda y: min(y.sum(), (1 - y).sum()) >= LEAST_HELD
    net.shift[:] = best_threshold(logit, label[kept], 0.0) if enough(label[kept]) else 0.0
    for j in range(len(langs)):
        if enough(label[kept][which == j]):
            net.shift[j] = best_threshold(logit[which == j], label[kept][which == j], net.shift[j])
    net.emb, net.lang_table, net.conv = net.emb.astype(np.float32), net.lang_table.astype(np.float32), [w.astype(np.float32) for w in net.conv]
    return net


def best_threshold(logit: np.ndarray, label: np.ndarray, default: float) -> float:
    """The middle of the cut with the best recall plus CLEAN_WEIGHT times the share of clean rows left alone."""
    if not 0 < label.sum() < len(label):
        return default
    order = np.argsort(logit)
    x, y = logit[order], label[order]
    gain = np.concatenate([[0], np.cumsum(CLEAN_WEIGHT * (1 - y) / (1 - label).sum() - y / label.sum())])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    cut = int(best[len(best) // 2])
    return float((x[max(cut - 1, 0)] + x[min(cut, len(x) - 1)]) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """text, lang, label of the sampled rows outside the held-out fold, texts of any length; see ``hashed_sample``."""
    usable = docs.where(F.col("text").isNotNull() & (crc_residue("doc_id") != 0)).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    ids = hashed_sample(usable.select("doc_id", F.octet_length("text").alias("bytes")).join(marks, "doc_id"), "label", per_label, most_bytes, "toxic")
    ids = ids.select("doc_id", "label", "place").dropDuplicates(["doc_id"])
    return usable.join(F.broadcast(ids), "doc_id").select("text", "lang", "label", "place")  # about 2 * per_label rows


def fitted(sample: DataFrame) -> Net:
    """The net of a bounded sample, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["text"], r["lang"], r["label"]) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"net": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    one = sample.repartition(1).sortWithinPartitions("place", "label", "text").select("text", "lang", F.col("label").cast("int").alias("label"))
    found = one.mapInArrow(run, schema_of(net="binary")).first()
    return pickle.loads(found["net"]) if found else fit([])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` with the column toxic_score added: 0 to 1, toxic from 0.5 on, over whole texts.

    A null or empty text gets the score of a text without words; rows are independent, so repeated rows repeat; an
    empty table gives none; other columns pass through, and a column named toxic_score is replaced.
    """
    docs = docs.drop("toxic_score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES, batch.schema.names[at]):
                yield part.append_column("toxic_score", pa.array(shared.value.scores(buf, offsets)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Fit on the labelled sample and score every row of ``docs`` (see ``score``); a table without labels rejects nothing."""
    return score(docs, fitted(labelled_sample(docs, labels, per_label, most_bytes)))
