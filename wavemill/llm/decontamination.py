"""Benchmark decontamination with DataFrame functions only.

The benchmark's distinct word windows form a hash set. Bitmaps of its words and windows (of bounded size) are tested in
place, so one scan leaves few candidate windows of the texts; these are joined with the set, broadcast while its
measured size is small and shuffled beyond that, and verified word for word.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: What separates words once A-Z are lower-cased is listed; everything else belongs to a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of benchmark words up to which the set of windows is broadcast.
BROADCAST_BYTES = 64 << 20
#: Bits of a bitmap at most (8 MB); more hashes only leave more candidates to verify.
MOST_BITS = 26


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else: ``lower`` where a text is all ASCII, letter by letter where it is not."""
    each = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c.lower())), string.ascii_uppercase, text)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(each)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def window_set(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, words, len: the windows of every item; items without words have none."""
    items = benchmark.select("item_id", words_of(whole_text(benchmark)).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("len", F.least(F.size("w"), F.lit(n)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return items.select("item_id", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("window"))


def bitmap(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """Bits of the hashes, 64 to a number: 64 bits a hash, 2**16 at least and 2**MOST_BITS at most."""
    bits = min(max(16, (64 * max(count, 1) - 1).bit_length()), MOST_BITS)
    size = 1 << (bits - 6)
    place = F.pmod(F.shiftright(column, 6), F.lit(size)).cast("int")
    rows = hashes.groupBy(place.alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(column, F.lit(64)).cast("int"))).alias("bits"))
    out = np.zeros(size, np.int64)
    for r in rows.collect():  # at most 2**(MOST_BITS - 6) numbers
        out[r["at"]] = r["bits"]
    return out


def _maybe(bits: np.ndarray, h: Column) -> Column:
    """Whether a hash's bit is set. The bits go to the plan as one text, which the optimiser folds into an array."""
    numbers = F.split(F.lit(",".join(map(str, bits.tolist()))), ",").cast("array<bigint>")
    return F.getbit(F.get(numbers, F.pmod(F.shiftright(h, 6), F.lit(len(bits))).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def _candidates(length: int, windows: np.ndarray) -> Column:
    """(pos, len, words) of the windows that may be in the set: some of their words are tested first, then the whole."""
    probes = sorted({0, length // 3, 2 * length // 3, length - 1})

    def may(i):
        known = reduce(lambda a, k: a & F.get("known", i + (k - 1)), probes, F.lit(True))
        return known & _maybe(windows, F.xxhash64(F.slice("w", i, F.lit(length))))

    at = F.filter(F.sequence(F.lit(1), F.size("w") - (length - 1)), may)
    found = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.lit(length).alias("len"), F.slice("w", i, F.lit(length)).alias("words")))
    return F.when(F.size("w") >= length, found).otherwise(F.array().cast("array<struct<pos:int,len:int,words:array<string>>>"))


def window_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, fp, n_words of every row, and doc_id, fp, pos (0-based word), len, wid of every occurrence
    of a benchmark window.

    ``fp`` tells rows of one doc_id apart by their text; ``wid`` names a distinct window.
    """
    bench = window_set(benchmark, n).select("len", "window").distinct()
    bench = saved(bench.select(F.col("len").alias("b_len"), F.col("window").alias("b_words"), F.xxhash64("window").alias("b_hash"), F.sha2(F.concat_ws(" ", "window"), 256).alias("wid")), "windows")
    size, count, lengths = bench.agg(F.sum(F.octet_length(F.concat_ws(" ", "b_words"))), F.count("*"), F.sort_array(F.collect_set("b_len"))).first()  # at most n lengths
    words = bench.select(F.explode("b_words").alias("word")).distinct().select(F.xxhash64("word").alias("h"))
    windows, known = bitmap(bench, "b_hash", count), bitmap(words, "h", words.count())
    text = whole_text(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("fp"), words_of(text).alias("w"))
    rows = rows.select("*", F.transform("w", lambda x: _maybe(known, F.xxhash64(x))).alias("known"))
    none = F.array().cast("array<struct<pos:int,len:int,words:array<string>>>")
    rows = rows.select("doc_id", "fp", F.size("w").cast("bigint").alias("n_words"), F.concat(none, *(_candidates(k, windows) for k in lengths or [])).alias("maybe"))
    rows = saved(rows, "candidates")
    at = rows.where(F.size("maybe") > 0).select("doc_id", "fp", F.explode("maybe").alias("m")).select("doc_id", "fp", "m.*").withColumn("hash", F.xxhash64("words"))
    small = (size or 0) <= broadcast_bytes
    found = at.join(F.broadcast(bench) if small else bench, (F.col("hash") == F.col("b_hash")) & (F.col("len") == F.col("b_len")) & (F.col("words") == F.col("b_words")))
    return rows.select("doc_id", "fp", "n_words"), found.select("doc_id", "fp", "pos", "len", "wid")


def _covered(spans: Column) -> Column:
    """Positions covered by sorted (pos, len) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(acc, s):
        end = s["pos"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["pos"]))).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc["n"])


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, share: int, broadcast_bytes: int) -> DataFrame:
    """key (doc_id, fp), doc_n_words, doc_n_hit, doc_spans, doc_items, contaminated of every distinct row."""
    sizes, hits = window_hits(docs, benchmark, n, broadcast_bytes)
    item_of = window_set(benchmark, n).select(F.sha2(F.concat_ws(" ", "window"), 256).alias("wid"), F.col("item_id").cast("string").alias("item")).distinct()
    key = F.struct("doc_id", "fp").alias("key")
    spans = hits.groupBy(key).agg(F.sort_array(F.collect_set(F.struct("pos", "len"))).alias("doc_spans"), F.collect_set("wid").alias("wids"))
    items = spans.select("key", F.explode("wids").alias("wid")).join(item_of, "wid").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("doc_items"))
    found = spans.drop("wids").join(items, "key", "left")
    judged = sizes.select(key, F.col("n_words").alias("doc_n_words")).dropDuplicates(["key"]).join(found, "key", "left")  # repeated rows
    n_hit = F.coalesce(_covered(F.col("doc_spans")), F.lit(0).cast("bigint"))
    judged = judged.withColumns({"doc_n_hit": n_hit, "doc_items": F.coalesce("doc_items", F.array().cast("array<string>"))})
    return judged.withColumn("contaminated", (F.col("doc_n_hit") > 0) & (share * F.col("doc_n_hit") >= F.col("doc_n_words")))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one column, whatever its columns are called, and their key."""
    return docs.select(F.struct("doc_id", F.xxhash64(whole_text(docs)).alias("fp")).alias("key"), F.struct(*docs.columns).alias("row"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with doc_n_words, doc_n_hit, doc_spans, doc_items and contaminated added to its columns.

    A word is hit if it lies in an occurrence of a benchmark window of ``n`` words (an item of fewer words is one
    window); a text is contaminated if a word is hit and ``share * n_hit >= n_words``. doc_spans holds the sorted
    (pos, len) word spans to remove, doc_items the sorted ids of the items that occur. Null and empty texts have no
    words and are clean; repeated rows are each judged and returned; a null item_id marks words but adds no item;
    null doc_ids are kept; an empty benchmark or table hits nothing. Added columns replace columns of their name;
    all others pass through.
    """
    added = ("doc_n_words", "doc_n_hit", "doc_spans", "doc_items", "contaminated")
    judged = _judged(docs, benchmark, n, share, broadcast_bytes)
    return _keyed(docs.drop(*added)).join(judged, "key").select("row.*", *added)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` does not call contaminated. Only the others' keys are joined."""
    gone = _judged(docs, benchmark, n, share, broadcast_bytes).where("contaminated").select("key")
    return _keyed(docs).join(saved(gone, "contaminated"), "key", "left_anti").select("row.*")


def without_spans(judged: DataFrame) -> DataFrame:
    """The rows of ``decontaminate`` with the hit words cut out of ``text``; separators inside a cut span go with it.

    Texts without hits stay as they are, byte for byte.
    """
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.aggregate(
        "doc_spans",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["pos"] + s["len"]).alias("end"), F.concat(acc["out"], F.slice("pieces", acc["end"] + 1, F.greatest(F.lit(0), s["pos"] - acc["end"]))).alias("out")),
        lambda acc: F.concat(acc["out"], F.slice("pieces", acc["end"] + 1, F.size("pieces"))),
    )
    cut = judged.withColumn("pieces", pieces).withColumn("text", F.when(F.col("doc_n_hit") > 0, F.concat(head, F.array_join(kept, ""))).otherwise(F.col("text")))
    return cut.drop("pieces")
