"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

1. Winnowed fingerprints (each string of ``length`` bytes owns one, which only depends on its bytes) that occur in two
   texts mark where repeats can be; everything else cannot repeat and is left out, losing no match.
2. The marked stretches are cut where their content says so and equal pieces become one, owned by the least doc_id
   that has it. Fingerprints that occur in one piece only are settled by that owner; what is left are, for each
   fingerprint, the distinct contexts (the strings that own it) of different pieces.
3. The contexts are dealt by fingerprint, since equal strings own equal fingerprints, and their suffixes are sorted by
   the difference-cover algorithm over 8-byte symbols: the sampled two thirds are sorted by triples and named, triples
   of names are named again until the names are unique or reach ``length`` bytes, and the remaining third is merged in
   by its first symbols and the names behind them.
4. Neighbours with equal ``length``-byte prefixes form runs; each run's least owner removes the others' bytes. A
   fingerprint with too many contexts for one task is settled string by string, pre-aggregated before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, freed_shuffles, mounted, schema_of, scratch, whole_text
from .keysets import KeySet, publish

LENGTH = 50
SLICE_BYTES = 512 << 10
#: Fingerprints cover this many of LENGTH bytes; a piece ends at one in 2**CUT_BITS of them or after MOST_GRAMS.
GRAM, CUT_BITS, MOST_GRAMS, HELD = 24, 3, 128, 1 << 19
#: Bytes of contexts that are sorted together, and pieces that share a fingerprint beyond which it goes string by string.
SORTED_BYTES, HOT_ROWS = 1 << 19, 16384
#: Hashes whose contents a task remembers to have sent.
SENT = 1 << 19
SYMBOL, _BITS = 8, 21
_NONE, _STEP = np.uint32(0xFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


def rolling(buf: np.ndarray, width: int, kind: type = np.uint64) -> np.ndarray:
    """A hash of the ``width`` bytes at each place, by doubling, in 32 or 64 bits."""
    parts, h, size, k = [], K.mix(np.arange(256, dtype=np.uint64) + np.uint64(7)).astype(kind)[buf], 1, 0
    left = width
    while left:
        if left & size:
            parts.append((size, h))
            left -= size
        if left:
            turn = K.mix(np.array([k + 1], np.uint64)).astype(kind)[0] | kind(1)
            h = h[:-size] * turn + h[size:] if len(h) > size else h[:0]
            size, k = size * 2, k + 1
    n = max(0, len(buf) - width + 1)
    (at, out), *rest = parts
    out = out[:n]
    for size, h in rest:
        out = out * kind(0x85EBCA6B) + h[at : at + n]
        at += size
    if kind is np.uint64:
        return K.mix(out)
    out = (out ^ (out >> kind(15))) * kind(0x2C1B3C6D)
    return out ^ (out >> kind(13))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each window of ``width`` values."""
    out, size = x, 1
    while size * 2 <= width:
        out, size = pick(out[:-size], out[size:]), size * 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def fingerprints(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and ranks of winnowed grams: every ``length`` bytes of a text hold one that only depends on them.

    The least rank (32 bits, equal for equal grams) is chosen; the hash (64 bits) tells the chosen grams apart.
    """
    width = length - gram + 1
    h = rolling(buf, gram, np.uint32)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    np.minimum(h, _NONE - np.uint32(1), out=h)
    for end in offsets[1:-1]:  # grams that cross rows
        h[max(end - gram + 1, 0) : end] = _NONE
    least = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint32)
    at = np.flatnonzero((_slide(np.concatenate([pad, least, pad]), width, np.maximum) == h) & (h != _NONE))
    keys = np.zeros(len(at), np.uint64)
    for k in range(gram):
        keys = keys * _STEP + buf[at + k]
        if k % 8 == 7:
            keys = K.mix(keys)
    return at, K.mix(keys), h[at]


def owned(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, row, start, end of each fingerprint: the strings of ``length`` bytes that begin in [start, end) own it.

    A string owns its least gram, the leftmost of equal ones, so the strings of a row are shared out in order.
    """
    at, h, rank = fingerprints(buf, offsets, length, gram)
    if not len(at):
        return h, at, at, at
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.append(True, row[1:] != row[:-1])
    low = offsets[row]
    limit = np.maximum(offsets[row + 1] - length + 1, low)
    before, before_rank = np.append(0, at[:-1]), np.append(_NONE, rank[:-1])
    start = np.where(rank < before_rank, at - (length - gram), before + 1)  # a smaller gram rules from its entry on
    start = np.minimum(np.maximum(np.where(new, low, start), low), limit)
    start = np.minimum.accumulate(start[::-1])[::-1]
    end = np.where(np.append(new[1:], True), limit, np.append(start[1:], 0))
    keep = end > start
    return h[keep], row[keep], start[keep], end[keep]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Byte-balanced slices; a binary column counts as its bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_binary(col.type):
        col = pa.Array.from_buffers(pa.string(), len(col), col.buffers(), offset=col.offset)
    buf, offsets = K.text_buffer(col)
    for i, j in K.row_slices(offsets, SLICE_BYTES):
        yield batch.slice(i, j - i), buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def repeated_fingerprints(texts: DataFrame, length: int, gram: int) -> tuple[str, int]:
    """Folder and bucket bits of sorted arrays of the fingerprints that occur in two rows of ``texts`` (column text, string or binary)."""
    bits = max(3, (max(texts.rdd.getNumPartitions(), 1) - 1).bit_length())
    folder = mounted(scratch(texts.sparkSession, "fingerprints"))
    schema = pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("often", pa.binary())])

    def flush(held):
        keys, row = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")  # rows stay in order
        keys, row = keys[order], row[order]
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = np.append(at[1:], len(keys)) - 1
        keys, often = keys[at], row[at] != row[last]
        bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[i]), "once": keys[i:j][~often[i:j]].tobytes(), "often": keys[i:j][often[i:j]].tobytes()}], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for batch in batches:
            for part, buf, offsets in _slices(batch, "text"):
                at, h, _ = fingerprints(buf, offsets, length, gram)
                held.append((h, np.searchsorted(offsets, at, "right") - 1 + seen))
                seen, size = seen + part.num_rows, size + len(h)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, once, often = None, [], []

        def done():
            keys, n = np.unique(np.concatenate(once), return_counts=True)
            publish(folder, f"f{bucket}", key=np.unique(np.concatenate([keys[n > 1], *often])))
            return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32())})

        for batch in batches:
            for r in batch.to_pylist():
                if bucket is not None and r["bucket"] != bucket:
                    yield done()
                    once, often = [], []
                bucket = r["bucket"]
                once.append(np.frombuffer(r["once"], np.uint64))
                often.append(np.frombuffer(r["often"], np.uint64))
        if bucket is not None:
            yield done()

    dealt = texts.select("text").mapInArrow(count, schema_of(bucket="int", once="binary", often="binary")).repartition(1 << bits, "bucket").sortWithinPartitions("bucket")
    with freed_shuffles(texts.sparkSession):
        dealt.mapInArrow(merge, schema_of(bucket="int")).count()
    return folder, bits


class _Sent:
    """Which contents a task has sent already; forgetting some only sends them again."""

    def __init__(self):
        self.seen: set = set()

    def once(self, keys: list, make) -> list[bytes | None]:
        out: list[bytes | None] = []
        for i, k in enumerate(keys):
            if k in self.seen:
                out.append(None)
            else:
                self.seen.add(k)
                out.append(make(i))
        if len(self.seen) > SENT:
            self.seen = set()
        return out


def pieces(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """key, at, n, hash, content: content-cut pieces of the stretches of ``texts`` (key, text) that can repeat.

    A piece holds every string of ``length`` bytes that starts at its first ``n`` bytes. Each task sends the content
    of equal pieces once (null otherwise).
    """
    folder, bits = repeated_fingerprints(texts.select("text"), length, gram)
    id_type = texts.schema["key"].dataType.simpleString()
    mask = np.uint64((1 << CUT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, sent = KeySet(folder, bits), _Sent()
        for batch in batches:
            for part, buf, offsets in _slices(batch, "text"):
                h, row, start, end = owned(buf, offsets, length, gram)
                hit = repeated.known(h)
                h, row, start, end = h[hit], row[hit], start[hit], end[hit]
                if not len(h):
                    continue
                cut = np.append(True, (start[1:] != end[:-1]) | (row[1:] != row[:-1]) | ((h[1:] & mask) == 0) & (h[1:] != h[:-1]))
                within = np.arange(len(h)) - np.flatnonzero(cut)[np.cumsum(cut) - 1]
                first = np.flatnonzero(within % MOST_GRAMS == 0)
                b, e, of = start[first], end[np.append(first[1:], len(h)) - 1], row[first]
                where = list(zip(b.tolist(), (e + length - 1).tolist()))
                whole = buf.tobytes()
                hashes = [hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in where]
                content = sent.once(hashes, lambda k: whole[slice(*where[k])])  # noqa: B023
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(b - offsets[of]), pa.array((e - b).astype(np.int32)), pa.array(hashes, pa.binary()), pa.array(content, pa.binary())],
                    names=["key", "at", "n", "hash", "content"],
                )

    return texts.select("key", "text").mapInArrow(run, schema_of(key=id_type, at="bigint", n="int", hash="binary", content="binary"))


def shared_grams(distinct: DataFrame, length: int, gram: int) -> DataFrame:
    """sid, owner, place, n, h, c, content: the fingerprints that occur in two of the ``distinct`` pieces (sid, owner,
    text), the first and the number of the strings that own them, and their context (c: its hash, content: once a task)."""
    folder, bits = repeated_fingerprints(distinct.select("text"), length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, sent = KeySet(folder, bits), _Sent()
        for batch in batches:
            for part, buf, offsets in _slices(batch, "text"):
                h, row, start, end = owned(buf, offsets, length, gram)
                hit = repeated.known(h)
                h, row, start, end = h[hit], row[hit], start[hit], end[hit]
                if not len(h):
                    continue
                whole, strings = buf.tobytes(), rolling(buf, length)
                c = K.pair_hash(strings[start], strings[end - 1])  # both strings together are the whole context
                where = list(zip(start.tolist(), (end + length - 1).tolist()))
                content = sent.once(list(zip(h.tolist(), c.tolist())), lambda k: whole[slice(*where[k])])  # noqa: B023
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), pa.array((start - offsets[row]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(content, pa.binary())],
                    names=["sid", "owner", "place", "n", "h", "c", "content"],
                )

    return distinct.select("sid", "owner", "text").mapInArrow(run, schema_of(sid="bigint", owner="bigint", place="int", n="int", h="bigint", c="bigint", content="binary"))


def symbols(text: np.ndarray) -> np.ndarray:
    """The 8-byte big-endian symbol at each place, zeros behind the end."""
    b = np.concatenate([text, np.zeros(SYMBOL, np.uint8)])
    w = np.zeros(len(text), np.uint64)
    for k in range(SYMBOL):
        w = w << np.uint64(8) | b[k : k + len(w)]
    return w


def _name(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Order-keeping names from 1 on, and how many there are."""
    every, back = np.unique(key, return_inverse=True)
    return back + 1, len(every)


def suffix_order(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``places`` in the order of their suffixes (as far as ``length`` bytes), and which differ from the one before."""
    n, w = len(text), symbols(text)
    if n >= 1 << _BITS:
        raise ValueError("too long to be sorted in one task")
    pad = np.zeros(2 * max(3 * length, 3 * SYMBOL), np.int64)
    first = np.concatenate([_name(w)[0], pad])
    kind = np.arange(n) // SYMBOL % 3
    sample = np.flatnonzero(kind != 0)
    name, step = first, SYMBOL
    while True:  # triples of symbols, then of names
        key = (name[sample] << (2 * _BITS)) | (name[sample + step] << _BITS) | name[sample + 2 * step]
        mine, many = _name(key)
        name = np.concatenate([np.zeros(n, np.int64), pad])
        name[sample] = mine
        step *= 3
        if step >= length or many == len(sample):
            break
    zero, one, two = (np.flatnonzero(kind[places] == k) for k in range(3))
    pair = lambda i: (first[places[i]] << _BITS) | name[places[i] + SYMBOL]
    triple = lambda i: (first[places[i]] << (2 * _BITS)) | (first[places[i] + SYMBOL] << _BITS) | name[places[i] + 2 * SYMBOL]
    cover = np.concatenate([one, two])
    cover = cover[np.argsort(name[places[cover]], kind="stable")]
    at = places[zero]
    zero = zero[np.lexsort((name[at + 2 * SYMBOL], name[at + SYMBOL], first[at]))]
    smaller = np.searchsorted(np.sort(pair(one)), pair(zero)) + np.searchsorted(np.sort(triple(two)), triple(zero))
    order = np.empty(len(places), np.int64)
    spot = smaller + np.arange(len(zero))
    order[spot] = zero
    free = np.ones(len(places), bool)
    free[spot] = False
    order[free] = cover
    p = places[order]
    new = np.ones(len(places), bool)
    new[1:] = np.any([w[p[1:] + k] != w[p[:-1] + k] for k in [*range(0, length - SYMBOL, SYMBOL), length - SYMBOL]], axis=0)
    return order, new


def _whole_grams(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """Tables of about SORTED_BYTES of contexts (``width`` bytes each at most) that never part the rows of one
    fingerprint; rows come sorted by it."""
    rest, many = None, max(1, SORTED_BYTES // width)
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not t.num_rows:
            continue
        h = t.column("h").to_numpy()
        ends = np.flatnonzero(h[1:] != h[:-1]) + 1
        begin = 0
        while True:
            k = np.searchsorted(ends, begin + many)
            if k == len(ends):
                break
            yield t.slice(begin, int(ends[k]) - begin).combine_chunks()
            begin = int(ends[k])
        rest = t.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _texts(column: pa.ChunkedArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of some rows of a binary column."""
    col = column.take(pa.array(rows)).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    return K.text_buffer(pa.Array.from_buffers(pa.string(), len(col), col.buffers(), offset=col.offset))


def _settled(h: np.ndarray, c: np.ndarray, mine: np.ndarray, place: np.ndarray, n: np.ndarray, content: pa.ChunkedArray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first, n: the runs of strings of each row (sorted by h, c) that a smaller owner than the row's has."""
    head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
    of = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(h))))
    owner, gram = np.minimum.reduceat(mine, head), h[head]
    same = np.append(gram[1:] == gram[:-1], False)
    several = np.flatnonzero(same | np.append(False, same[:-1]))  # a lone context has no other owner
    sent = np.flatnonzero(np.asarray(content.is_valid()))
    counts, first, many = np.zeros(len(head), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(several):
        text, begin = _texts(content, sent[np.searchsorted(sent, head[several])])
        sizes = np.diff(begin) - (length - 1)
        heads = np.cumsum(sizes) - sizes
        whose = np.repeat(np.arange(len(several)), sizes)
        order, new = suffix_order(text, begin[whose] + np.arange(len(whose)) - heads[whose], length)
        own = owner[several][whose]
        at = np.flatnonzero(new)
        least = np.empty(len(whose), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(own[order], at), np.diff(np.append(at, len(whose))))
        less = least < own
        joined = less[1:] & less[:-1] & (whose[1:] == whose[:-1])
        begins, ends = np.flatnonzero(less & ~np.append(False, joined)), np.flatnonzero(less & ~np.append(joined, False)) + 1
        first, many = begins - heads[whose[begins]], ends - begins
        counts[several] = np.bincount(whose[begins], minlength=len(several))
    whole = owner[of] < mine
    base = np.cumsum(counts) - counts
    part = np.flatnonzero(~whole & (counts[of] > 0))
    times = counts[of[part]]
    pick = np.repeat(base[of[part]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    rows = np.concatenate([np.flatnonzero(whole), np.repeat(part, times)])
    return rows, np.concatenate([place[whole], place[np.repeat(part, times)] + first[pick]]), np.concatenate([n[whole], many[pick]])


def sorted_grams(grams: DataFrame, length: int, gram: int) -> DataFrame:
    """sid, first, n: the runs of strings in each piece that a smaller owner than the piece's has, by suffix sorting."""
    parts = max(8, 2 * grams.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_grams(batches, 2 * length - gram):
            h, c, mine, place, n = (t.column(x).to_numpy() for x in ("h", "c", "owner", "place", "n"))
            rows, first, many = _settled(h, c, mine, place.astype(np.int64), n.astype(np.int64), t.column("content"), length)
            yield pa.RecordBatch.from_arrays([t.column("sid").combine_chunks().take(pa.array(rows)), pa.array(first), pa.array(many)], names=["sid", "first", "n"])

    dealt = grams.repartition(parts, "h").sortWithinPartitions("h", "c")
    return dealt.mapInArrow(run, schema_of(sid="bigint", first="bigint", n="bigint"))


def counted_grams(grams: DataFrame, length: int) -> DataFrame:
    """The same for fingerprints that too many pieces share: string by string, with the least owner by a plain aggregate."""
    contexts = grams.groupBy("h", "c").agg(F.min("owner").alias("owner"), F.max("content").alias("content"))
    places = F.sequence(F.lit(1), F.octet_length("content") - (length - 1))
    strings = contexts.select("h", "c", "owner", F.posexplode(F.transform(places, lambda i: F.substring("content", i, F.lit(length)))).alias("at", "string"))
    least = strings.groupBy("string").agg(F.min("owner").alias("least"))
    less = strings.join(least, "string").where(F.col("least") < F.col("owner")).groupBy("h", "c").agg(F.collect_list("at").alias("ats"))
    settled = contexts.select("h", "c", F.col("owner").alias("least")).join(less, ["h", "c"], "left")
    joined = grams.select("sid", "owner", "place", "n", "h", "c").join(settled, ["h", "c"])
    one = lambda first, n: F.struct(first.cast("bigint").alias("first"), n.cast("bigint").alias("n"))
    edge = lambda step: F.filter("ats", lambda x: ~F.array_contains("ats", x + step))
    parts = F.zip_with(F.sort_array(edge(-1)), F.sort_array(edge(1)), lambda a, b: one(a + F.col("place"), b - a + 1))
    runs = F.when(F.col("least") < F.col("owner"), F.array(one(F.col("place"), F.col("n")))).otherwise(parts)
    return joined.select("sid", F.explode(runs).alias("x")).select("sid", "x.first", "x.n")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, fp, start, end: arrays of the byte spans of each text that strings of smaller doc_ids cover, in no order.

    ``fp`` is xxhash64 of the text. Only texts that lose bytes are listed; repeated rows once.
    """
    if not SYMBOL <= length <= 1 << 14:
        raise ValueError(f"length must be {SYMBOL} to {1 << 14} bytes")
    gram, text = max(4, length * GRAM // LENGTH), whole_text(docs)
    hot_rows = min(hot_rows, max(1, 3 * SORTED_BYTES // (2 * length - gram)))  # so that a sort stays under 2**_BITS bytes
    work = Work(docs.sparkSession)
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("fp")).alias("key"), text.alias("text"))
    found = work.saved(pieces(keyed, length, gram), "pieces")
    distinct = found.groupBy("hash").agg(F.min("key.doc_id").alias("owner"), F.max("content").alias("text"))
    distinct = work.saved(distinct.withColumn("sid", F.monotonically_increasing_id()), "distinct")
    grams = work.saved(shared_grams(distinct, length, gram), "grams")
    hot = work.saved(grams.groupBy("h").count().where(F.col("count") > hot_rows).select("h"), "hot")
    less = sorted_grams(grams.join(hot, "h", "left_anti"), length, gram).unionByName(counted_grams(grams.join(hot, "h", "left_semi"), length))
    gathered = lambda *c: F.collect_list(F.struct(*c)).alias("runs")
    less = less.groupBy("sid").agg(gathered("first", "n"))  # a piece has MOST_GRAMS fingerprints at most
    owners = work.saved(distinct.select("sid", "hash", F.col("owner").alias("mine")).join(less, "sid", "left").drop("sid"), "owners")
    work.drop("distinct", "grams", "hot")
    placed = found.select("key", "at", F.col("n").cast("bigint").alias("strings"), "hash").join(owners, "hash")
    runs = F.when(F.col("key.doc_id") > F.col("mine"), F.array(F.struct(F.lit(0).cast("bigint").alias("first"), F.col("strings").alias("n")))).otherwise(F.col("runs"))
    placed = placed.where((F.col("key.doc_id") > F.col("mine")) | F.col("runs").isNotNull())
    placed = placed.select("key", F.transform(runs, lambda x: F.struct((F.col("at") + x["first"]).alias("start"), (F.col("at") + x["first"] + x["n"] + (length - 1)).alias("end"))).alias("s"))
    spans = placed.groupBy("key").agg(F.flatten(F.collect_list("s")).alias("s")).select("key.doc_id", "key.fp", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    spans = work.saved(spans, "spans")
    work.drop("pieces", "owners")
    return spans


def _cut(content: pa.Array, start: pa.Array, end: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that stay of each row outside its (start, end) spans, its bytes, bytes removed and removed runs."""
    buf, offsets = K.text_buffer(pa.Array.from_buffers(pa.string(), len(content), content.buffers(), offset=content.offset))
    times = pc.fill_null(pc.list_value_length(start), 0).to_numpy()
    base = np.repeat(offsets[:-1], times)
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, base + start.flatten().to_numpy(), 1)
    np.add.at(edge, base + end.flatten().to_numpy(), -1)
    gone = np.cumsum(edge[:-1]) > 0
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    rises[firsts] = gone[firsts]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    sizes, removed = np.diff(offsets), sums(gone)
    kept = np.concatenate([[0], np.cumsum(sizes - removed)])
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(content), [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(buf[~gone])])
    return rows.cast(pa.binary()), sizes, removed, sums(rises)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs`` (integer doc_id, text).

    Null texts count as empty; rows with a null doc_id keep all their bytes and take none from others; rows of one
    doc_id take nothing from each other, whatever their texts; an empty table gives none; other columns are ignored.
    ``length`` may be 8 to 16384 bytes; a fingerprint that more than ``hot_rows`` pieces share is settled string by string.
    """
    spans = repeated_spans(docs, length, hot_rows).withColumnsRenamed({"doc_id": "s_id", "fp": "s_fp"})
    rows = docs.select("doc_id", whole_text(docs).alias("text"))
    joined = rows.join(spans, (rows["doc_id"].cast("bigint") == spans["s_id"]) & (F.xxhash64(rows["text"]) == spans["s_fp"]), "left").select("doc_id", F.col("text").cast("binary").alias("content"), "start", "end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in _slices(batch, "content"):
                kept, *numbers = _cut(*(part.column(i) for i in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in numbers), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(cut, schema_of(doc_id=docs.schema["doc_id"].dataType.simpleString(), n_bytes="bigint", n_removed="bigint", n_spans="bigint", kept="binary"))


def kept_digest(kept: Column) -> Column:
    """Lowercase hex SHA-256 of the remaining bytes."""
    return F.sha2(kept, 256)
