"""Ranked lexical search: matched (item, document, impact) triples are radix-sorted by packed keys and summed in runs.

Texts are tokenised once; of each document only the terms stay that may occur in an item, by a bitmap of fixed size,
with the document's length. From these rows come the document frequencies and, dealt by ranges of doc_id, the scores:
tasks look up their terms among an item block's sorted postings, write out one packed key (item, document) and impact a
match, sort the keys by radix, and add up runs of equal keys. Each item keeps its best documents of a task in a heap, and
the heaps of all tasks meet by item. Items go in blocks of bounded size, one pass over the matched rows each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, schema_of

#: Bytes of text that are tokenised at a time, and matches that are sorted at a time.
SLICE_BYTES, SORTED = 4 << 20, 1 << 20
#: Bits of the map of item terms. Where it fills up, more rows are carried; results do not change.
MAP_BITS = 22
#: Postings of an item block, which each task holds.
BLOCK_POSTINGS = 1 << 19
_TERM = K.byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), True)


def term_counts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text; then text, term hash and occurrences of each of its different terms, by text."""
    low = K.lower_ascii(buf)
    starts, ends, rows = K.spans(low, offsets, _TERM)
    hashes = K.hash_spans(low, starts, ends)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return n, rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable ascending order of non-negative keys up to ``most``: 16 bits a pass, the lowest first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while most >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def summed(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in ascending order and the sum of each one's values."""
    order = radix_order(keys, most)
    keys, values = keys[order], values[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    """Values, which ascend by row, as one list a row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def tokenised(rows: DataFrame, key: str, bitmap: np.ndarray | None) -> DataFrame:
    """key, n (terms with repeats), terms (hashes) and tfs of each text; with a bitmap, only of terms that it may hold."""
    shift = np.uint64(64 - MAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES):
                n, at, hashes, times = term_counts(buf, offsets)
                if bitmap is not None:
                    place = (hashes >> shift).astype(np.int64)
                    known = (bitmap[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
                    at, hashes, times = at[known], hashes[known], times[known]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), _lists(hashes.view(np.int64), at, len(n)), _lists(times, at, len(n))], names=[key, "n", "terms", "tfs"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "text").mapInArrow(run, schema_of(**{key: kind}, n="bigint", terms="array<bigint>", tfs="array<bigint>"))


def term_bitmap(postings: DataFrame) -> np.ndarray:
    """The map of all terms of a table by the first MAP_BITS bits of their hashes: 64 bits a row are collected, a fixed number at most."""
    place = F.shiftrightunsigned("term", 64 - MAP_BITS)
    words = postings.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(term, {}) & 63 as int))".format(64 - MAP_BITS)).alias("bit"))
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    for batch in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return out


class Heaps:
    """The k best (score, then least document) of each item."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.zeros(items, np.int64)

    def offer(self, items: np.ndarray, docs: list, scores: np.ndarray) -> None:
        """Documents come in ascending order within and across calls, so one that only ties with a full heap's least loses."""
        for i in np.flatnonzero(scores > self.least[items]).tolist():
            item, score, heap = int(items[i]), int(scores[i]), self.heaps[int(items[i])]
            if score <= self.least[item]:
                continue
            entry = (score, -docs[i][0], docs[i][1])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _scored(matched: DataFrame, block: dict, n_docs: int, n_terms: int, k: int, sorted_rows: int) -> DataFrame:
    """item (index in the block), doc_id, score: each task's k best documents of each item."""
    terms, heads, owner, weight, n_items = block["terms"], block["heads"], block["owner"], block["weight"], block["items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, order = Heaps(n_items, k), 0
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            hashes = batch.column(2).values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
            tf = batch.column(3).values.to_numpy()[batch.column(3).offsets[0].as_py() : batch.column(3).offsets[-1].as_py()]
            doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
            at, known = K.lookup(terms, hashes)
            at, tf, doc = at[known], tf[known], doc[known]
            m = 75 + (25 * n * n_docs) // max(n_terms, 1)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            spread = heads[at + 1] - heads[at]
            ends = np.cumsum(spread)
            begin = 0
            while begin < len(ids):  # documents whose matches fit one sort, or one document
                first = np.searchsorted(doc, begin)
                used = ends[first - 1] if first else 0
                last = int(np.searchsorted(ends, used + sorted_rows, "right"))
                stop = len(ids) if last >= len(doc) else max(begin + 1, int(doc[last]))
                last = int(np.searchsorted(doc, stop))
                times = spread[first:last]
                total = int(times.sum())
                if total:
                    inside = np.arange(total) - np.repeat(np.cumsum(times) - times, times)
                    posting = np.repeat(heads[at[first:last]], times) + inside
                    width = stop - begin
                    keys, sums = summed(owner[posting] * width + np.repeat(doc[first:last] - begin, times), weight[posting] * np.repeat(impact[first:last], times), n_items * width)
                    mine = keys % width + begin
                    # within an item documents ascend; across slices and batches too, as rows come by doc_id
                    heaps.offer(keys // width, [(order + d, ids[d]) for d in mine.tolist()] if len(mine) < 4096 else _Docs(order, ids, mine), sums)
                begin = stop
            order += len(ids)
        rows = [(item, entry[2], entry[0]) for item, heap in enumerate(heaps.heaps) for entry in heap]
        if rows:
            item, doc_id, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return matched.mapInArrow(run, schema_of(item="int", doc_id="bigint", score="bigint"))


class _Docs:
    """Documents of a slice, made into (order, id) only where a heap asks."""

    def __init__(self, order: int, ids: list, at: np.ndarray):
        self.order, self.ids, self.at = order, ids, at

    def __getitem__(self, i: int):
        d = int(self.at[i])
        return self.order + d, self.ids[d]


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_postings: int = BLOCK_POSTINGS, sorted_rows: int = SORTED) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0, ties by ascending doc_id.

    ``docs`` has doc_id (integer) and text, ``items`` item_id and text; other columns are ignored. A null text has no
    terms. Equal rows of ``items`` count once; different ones of one item_id (null is one too) add up. Each row of
    ``docs`` is a document of its own, also where ids repeat; a null doc_id sorts first. No documents or no items give
    no rows.
    """
    work = Work(docs.sparkSession)
    queries = tokenised(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "item_id", None)
    postings = queries.select("item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("item_id", F.col("p.terms").alias("term")).agg(F.sum("p.tfs").alias("times"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    matched = work.saved(tokenised(texts, "doc_id", term_bitmap(postings)), "matched")
    totals = matched.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = int(totals[0]), int(totals[1])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, df = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])

    df = matched.select("terms").mapInArrow(frequencies, schema_of(term="bigint", df="bigint")).groupBy("term").agg(F.sum("df").alias("df"))
    weighted = postings.join(df, "term")  # a term that no document has adds nothing

    # items in blocks of about ``block_postings`` postings; each block is in few files, which its filter finds by their statistics
    blocks = max(1, math.ceil(postings.count() / block_postings))
    dealt = work.saved(weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")).repartition(blocks, "block"), "dealt")
    ranged = matched.where(F.size("terms") > 0).repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("n", "terms", "tfs")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    if blocks > 1:  # read once a block
        ranged = work.saved(ranged, "ranged")
        work.drop("matched")
    found = None
    for number in range(blocks):
        block, names = _block(dealt.where(F.col("block") == number), n_docs)
        if not block["items"]:
            continue
        best = _scored(ranged, block, n_docs, n_terms, k, sorted_rows)
        labels = docs.sparkSession.createDataFrame(list(enumerate(names)), schema_of(item="int", item_id=items.schema["item_id"].dataType.simpleString()))
        best = best.join(F.broadcast(labels), "item").select("item_id", "doc_id", "score")  # a block's items
        best = work.saved(best, f"best-{number}") if blocks > 1 else best
        found = best if found is None else found.union(best)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema_of(item_id=items.schema["item_id"].dataType.simpleString(), doc_id="bigint", score="bigint"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))  # k rows a task
    return found.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(rows: DataFrame, n_docs: int) -> tuple[dict, list]:
    """The postings of an item block as sorted arrays, and its item ids. Of bounded size, so the driver may hold it."""
    table = rows.select("item_id", "term", "times", "df").toArrow()
    ids = table.column(0).to_pylist()
    names = sorted(set(ids), key=lambda x: (x is not None, x))
    index = {x: i for i, x in enumerate(names)}
    owner = np.array([index[x] for x in ids], np.int64)
    term = table.column(1).to_numpy().view(np.uint64) if len(ids) else np.zeros(0, np.uint64)
    times, df = table.column(2).to_numpy(), table.column(3).to_numpy()
    w = {d: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in set(df.tolist())}
    weight = times * np.array([w[d] for d in df.tolist()], np.int64) if len(ids) else np.zeros(0, np.int64)
    order = np.lexsort((owner, term))
    terms, heads = np.unique(term[order], return_index=True)
    return {"terms": terms, "heads": np.append(heads, len(term)), "owner": owner[order], "weight": weight[order], "items": len(names)}, names
