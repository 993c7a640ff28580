"""Language identification by character n-gram models: interpolated Kneser-Ney, one for each language.

Models are fitted on a bounded sample of labelled rows and kept as sorted hash arrays. A text's characters are
scored word by word (contexts never leave a word), each distinct word of a batch once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import crc_residue, hashed_sample, schema_of

#: Labelled rows, and bytes of their texts, that are drawn of each language on average. Texts of any length can be drawn.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 2 << 20
#: A text is rejected beyond the bits a character that this share of the held-back texts of its own languages stays under.
KEPT_SHARE = 0.995
ORDER = 5
SLICE_BYTES = 4 << 20
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def lowered(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts and their offsets."""
    texts = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def padded_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as ' w ' behind one another, and for each character its distance from its word's start."""
    lengths = ends - starts + 2
    begin = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    out = np.full(len(within), 32, np.uint64)
    inner = (within > 0) & (within < np.repeat(lengths, lengths) - 1)
    out[inner] = codes[(np.repeat(starts, lengths) + within - 1)[inner]]
    return out, within


def grams(chars: np.ndarray, within: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to ``order``: hash of the n-gram that ends at a character, and whether it fits in the word."""
    out = [(K.mix(chars + np.uint64(1)), within >= 0)]
    for k in range(2, order + 1):
        h = np.zeros(len(chars), np.uint64)
        h[1:] = K.pair_hash(out[-1][0][:-1], chars[1:])
        out.append((h, within >= k - 1))
    return out


@dataclass
class CharModels:
    """keys[k]: sorted hashes of the (k+1)-grams; probs[k]: a row for each, a column a language, NaN where unseen;
    backs[k]: weights of the (k+1)-gram as a context, 1 where unseen; floor: probability of an unknown character."""

    langs: list[str]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    backs: list[np.ndarray]
    floor: np.ndarray
    limit: float = np.inf

    def word_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of -log2 p over the characters of each word and its end, a column a language."""
        chars, within = padded_words(codes, starts, ends)
        by_order = grams(chars, within, len(self.keys))
        p = np.tile(self.floor, (len(chars), 1))
        for k, (h, fits) in enumerate(by_order):
            at, known = K.lookup(self.keys[k], h)
            known &= fits
            if k:
                before = by_order[k - 1][0][:-1]
                ctx, seen = K.lookup(self.keys[k - 1], before)
                weight = np.ones_like(p)
                weight[1:][seen] = self.backs[k - 1][ctx[seen]]
                weight[~fits] = 1
                p *= weight
            row = self.probs[k][at[known]]
            p[known] = np.where(np.isnan(row), p[known], row)
        p[within == 0] = 1  # the leading space is given
        bits = -np.log2(p)
        return np.add.reduceat(bits, np.flatnonzero(within == 0), axis=0) if len(starts) else np.zeros((0, len(self.langs)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text, a column a language, and the characters scored."""
        codes, offsets = lowered(texts)
        starts, ends, rows = K.spans(codes, offsets, letters())
        total, count = np.zeros((len(texts), len(self.langs))), np.bincount(rows, weights=ends - starts + 1, minlength=len(texts))
        if len(starts):
            _, first, back = np.unique(K.hash_spans(codes, starts, ends), return_index=True, return_inverse=True)
            scores = self.word_scores(codes, starts[first], ends[first])
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(rows, weights=scores[back, j], minlength=len(texts))
        return total / np.maximum(count, 1)[:, None], count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und: no letter), score and whether the text fits none of the models."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        bits, count = self.entropies(texts)
        best = bits.argmin(1)
        gap = (bits - bits.min(1, keepdims=True)) * np.minimum(count, 200)[:, None]
        score = 1 / np.exp2(-np.minimum(gap, 500)).sum(1)
        lang = [self.langs[b] if c else "und" for b, c in zip(best, count)]
        return lang, np.where(count > 0, score, 0.0), (count == 0) | (bits.min(1) > self.limit)


def _fit_one(texts: list[str], order: int) -> list[dict]:
    """For each order: sorted keys with p, and sorted contexts with their back-off weights."""
    codes, offsets = lowered(texts)
    starts, ends, _ = K.spans(codes, offsets, letters())
    chars, within = padded_words(codes, starts, ends)
    by_order = grams(chars, within, order)
    levels = []
    for k in range(order):
        h, fits = by_order[k]
        usable = fits & (within > 0)  # the leading space is never predicted
        if k == order - 1:
            idx = np.flatnonzero(usable)
            keys, first, counts = np.unique(h[idx], return_index=True, return_counts=True)
            first, counts = idx[first], counts.astype(float)
        else:
            idx = np.flatnonzero(by_order[k + 1][1] & (within > 0))  # kinds of what comes before
            _, one = np.unique(by_order[k + 1][0][idx], return_index=True)
            at_start = np.flatnonzero(usable & (within == k))
            idx = np.concatenate([idx[one], at_start])
            keys, first, inverse = np.unique(h[idx], return_index=True, return_inverse=True)
            counts, first = np.bincount(inverse).astype(float), idx[first]
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if k == 0:
            total, kinds = counts.sum(), len(counts)
            floor = d * kinds / total / (kinds + 1) if kinds else 1e-6
            levels.append({"keys": keys, "p": (counts - d) / total + floor, "floor": floor})
        else:
            ctx = by_order[k - 1][0][first - 1]
            ctx_keys, ctx_of = np.unique(ctx, return_inverse=True)
            totals, kinds = np.bincount(ctx_of, weights=counts), np.bincount(ctx_of)
            at, known = K.lookup(levels[k - 1]["keys"], by_order[k - 1][0][first])
            lower = np.where(known, levels[k - 1]["p"][at], levels[0]["floor"])
            back = d * kinds / totals
            levels.append({"keys": keys, "p": (counts - d) / totals[ctx_of] + back[ctx_of] * lower, "ctx": ctx_keys, "back": back})
    return levels


def fit(rows: list[tuple[str, str]], order: int = ORDER, held: float = 0.2) -> CharModels:
    """Fit on (lang, text) rows; every 1/held-th row of a language sets the rejection limit, the KEPT_SHARE quantile of their bits a character."""
    by_lang: dict[str, list[str]] = {}
    for lang, text in rows:
        if text and letters()[lowered([text])[0]].any():
            by_lang.setdefault(lang, []).append(text)
    langs, step = sorted(by_lang), round(1 / held)
    fitted = [_fit_one([t for i, t in enumerate(by_lang[x]) if i % step or len(by_lang[x]) < step], order) for x in langs]
    keys, probs, backs = [], [], []
    for k in range(order if langs else 0):
        above = [f[k + 1]["ctx"] for f in fitted] if k + 1 < order else []
        union = np.unique(np.concatenate([f[k]["keys"] for f in fitted] + above))
        p, b = np.full((len(union), len(langs)), np.nan, np.float32), np.ones((len(union), len(langs)), np.float32)
        for j, f in enumerate(fitted):
            p[np.searchsorted(union, f[k]["keys"]), j] = f[k]["p"]
            if above:
                b[np.searchsorted(union, f[k + 1]["ctx"]), j] = f[k + 1]["back"]
        keys.append(union), probs.append(p), backs.append(b)
    model = CharModels(langs, keys, probs, backs, np.array([f[0]["floor"] for f in fitted]))
    held_out = [t for x in langs for t in by_lang[x][::step]]
    if held_out:
        model.limit = float(np.quantile(model.entropies(held_out)[0].min(1), KEPT_SHARE))
    return model


def labelled_sample(docs: DataFrame, per_lang: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """lang, text, place of the sampled rows outside the held-out fold, texts of any length; see ``hashed_sample``."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_residue("doc_id") != 0)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    rows = usable.select("doc_id", "lang", F.octet_length("text").alias("bytes"), "text")
    return hashed_sample(rows, "lang", per_lang, most_bytes, "lang").select("lang", "text", "place")


def fitted(sample: DataFrame) -> CharModels:
    """The models of a bounded sample, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["lang"], r["text"]) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(rows))], pa.binary())})

    one = sample.repartition(1).sortWithinPartitions("lang", "place", "text").select("lang", "text")
    found = one.mapInArrow(run, schema_of(model="binary")).first()
    return pickle.loads(found["model"]) if found else fit([])


def identify(docs: DataFrame, model: CharModels) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row: lowest bits a character over the whole text.

    A null text or one without letters gives und with score 0. ``rejected`` marks texts that fit none of the models.
    Rows are independent, so repeated rows repeat; an empty table gives none; without labelled rows all are und.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in K.balanced(batch, SLICE_BYTES):
                lang, score, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, schema_of(doc_id=docs.schema["doc_id"].dataType.simpleString(), lang_pred="string", score="double", rejected="boolean"))


def language_id(docs: DataFrame, per_lang: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Fit on the labelled sample of ``docs`` and identify all of its rows (see ``identify``); adds held_out (crc32 fold 0)."""
    found = identify(docs, fitted(labelled_sample(docs, per_lang, most_bytes)))
    return found.withColumn("held_out", crc_residue("doc_id") == 0)
