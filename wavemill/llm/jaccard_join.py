"""N-gram Jaccard self-join by MinHash banding.

Texts with the same set of word shingles form one class, and only classes are joined. Classes that share a band are
linked to the least class of that band, so a band of any size gives as many rows as it has members. Components of
those links are compared block by block on the full shingle sets: a large group spreads over many tasks, which
return link counts and not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Work, schema_of, whole_text
from .components import components
from .keysets import key_set, thinned

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.999
SLICE_BYTES = 2 << 20
#: Classes of a component and shingles that one block holds on average; columns of a block's incidence matrix at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS = 1000, 1 << 20, 4096
_WORD = np.array([(48 <= b <= 57) or (65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def banding(similarity: float, recall: float, rows: int = 6) -> tuple[int, int]:
    """Bands and rows for which a pair at ``similarity`` shares a band with probability ``recall`` at least."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows))), rows


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``width`` consecutive words, sorted in each row, and their row; fewer words are one shingle."""
    low = K.lower_ascii(buf)
    starts, ends, rows = K.spans(low, offsets, _WORD)
    words = K.hash_spans(low, starts, ends)
    hashes, first = K.windows_hash(words, rows, width)
    owner = rows[first]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            keep = np.isin(rows, short)
            h, at = K.windows_hash(words[keep], rows[keep], k)
            hashes, owner = np.concatenate([hashes, h]), np.concatenate([owner, rows[keep][at]])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """A hash for each band of each row with shingles (others: 0)."""
    out = np.zeros((n, bands), np.uint64)
    have, first = np.unique(owner, return_index=True)
    if len(have):
        rng = np.random.default_rng(20240501)
        mult, xor = rng.integers(1, 1 << 63, (2, bands * rows), np.uint64)
        for b in range(bands):
            h = np.full(len(have), b, np.uint64)
            for k in range(b * rows, b * rows + rows):
                h = K.pair_hash(h, np.minimum.reduceat((hashes ^ xor[k]) * (mult[k] | np.uint64(1)), first))
            out[have, b] = h
    return out


def _keys(hashes: np.ndarray, owner: np.ndarray, n: int) -> list[bytes | None]:
    """128 bits of each row's shingle set; None without shingles."""
    sums = np.zeros((n, 2), np.uint64)
    np.add.at(sums[:, 0], owner, K.mix(hashes))
    np.add.at(sums[:, 1], owner, K.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    some = np.bincount(owner, minlength=n) > 0
    return [x.tobytes() if s else None for x, s in zip(sums.astype(">u8"), some)]


def similar_in_block(values: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which (left, right) sets have a Jaccard similarity of num / den at least."""
    sizes = np.bincount(owner, minlength=n)
    _, col, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[col] > 1
    _, col = np.unique(col[shared], return_inverse=True)
    of = owner[shared]
    order = np.argsort(col, kind="stable")
    col, of = col[order], of[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((n, min(COLUMNS, int(col[-1]) + 1 - c)), np.float32)
        m[of[i:j], col[i:j] - c] = 1
        inter += m[left] @ m[right].T
    inter = inter.astype(np.int64)
    return den * inter >= num * (sizes[left][:, None] + sizes[right][None, :] - inter)


def _least_labels(adj: np.ndarray) -> np.ndarray:
    """The least index of each node's component in a symmetric matrix."""
    label = np.arange(len(adj))
    while True:
        new = np.minimum(label, np.where(adj, label[None, :], len(adj)).min(1, initial=len(adj)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def jaccard_join(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, fp, copy_id, class_id, n_links, n_shingles of every row of ``docs``.

    ``fp`` is xxhash64 of the text (null is empty). copy_id is the least doc_id with the same shingle set; n_links
    counts the other distinct sets whose similarity is ``similarity`` or more; class_id is the least doc_id that such
    links reach. Texts without words are unlike any other and have their own doc_id as class. Null doc_ids count as
    larger than any other; repeated rows repeat; an empty table gives none.
    """
    bands, per_band = banding(similarity, recall)
    num, den = (int(x) for x in np.round(np.array([similarity, 1]) * 1000))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(whole_text(docs)).alias("fp"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES):
                n = part.num_rows
                hashes, owner = shingles(buf, offsets, width)
                sig = signatures(hashes, owner, n, bands, per_band).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_keys(hashes, owner, n), pa.binary()), pa.array(np.bincount(owner, minlength=n)), lists], names=["doc_id", "fp", "tkey", "n_shingles", "bands"])

    work = Work(docs.sparkSession)
    signed = work.saved(rows.mapInArrow(sign, schema_of(doc_id=id_type, fp="bigint", tkey="binary", n_shingles="bigint", bands="array<bigint>")), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("r")
    classes = signed.where("tkey IS NOT NULL").groupBy("tkey").agg(first, F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    classes = work.saved(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # ids are short where band rows are shuffled
    banded = classes.select("id", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    linked = banded.join(leads, "band").where(F.col("id") != F.col("lead")).select(F.col("id").alias("u"), F.col("lead").alias("v"))
    found = components(linked)
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    members = work.saved(members.join(classes.select(F.col("id").alias("node"), "tkey", "r", "n_shingles"), "node"), "members")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n_shingles") / block_shingles)).cast("int")
    large = members.groupBy("root").agg(blocks.alias("blocks")).where("blocks > 1")
    wanted = members.join(large, "root", "left").select("root", F.coalesce("blocks", F.lit(1)).alias("blocks"), "tkey", F.struct("r.doc_id", "r.fp").alias("row"))
    # few texts are candidates: the others are left out before the shuffle
    some = thinned(rows, "fp", *key_set(members.select(F.col("r.fp").alias("fp")), "fp"))
    texts = some.select(F.struct("doc_id", "fp").alias("row"), "text").join(wanted, "row").select("root", "blocks", "tkey", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in K.balanced(batch, SLICE_BYTES):
                hashes, owner = shingles(buf, offsets, width)
                cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [hashes[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sets, pa.binary())], names=["root", "blocks", "tkey", "shingles"])

    packed = texts.mapInArrow(pack, schema_of(root="bigint", blocks="int", tkey="binary", shingles="binary"))
    mine = F.pmod(F.xxhash64("tkey"), F.col("blocks")).cast("int")
    packed = packed.withColumn("mine", mine).select("root", "tkey", "shingles", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    packed = packed.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "tkey", "shingles").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "tkey")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            keys, at = np.unique(np.array([r["tkey"].hex() for r in group]), return_index=True)
            group = [group[k] for k in at]  # rows repeated in the input
            n = len(group)
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in group]
            values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
            side = np.array([r["mine"] for r in group])
            i, j = group[0]["i"], group[0]["j"]
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            adj = np.zeros((n, n), bool)
            adj[np.ix_(left, right)] = similar_in_block(values, owner, n, left, right, num, den)
            adj |= adj.T
            np.fill_diagonal(adj, False)
            label = _least_labels(adj)
            yield pa.RecordBatch.from_pydict({"tkey": [r["tkey"] for r in group], "lead": [group[k]["tkey"] for k in label], "links": adj.sum(1)})

    compared = work.saved(packed.mapInArrow(compare, schema_of(tkey="binary", lead="binary", links="bigint")), "compared")
    work.drop("classes", "members")
    links = compared.groupBy("tkey").agg(F.sum("links").alias("links"))
    roots = components(compared.select(F.col("tkey").alias("u"), F.col("lead").alias("v")))
    known = signed.join(links, "tkey", "left").join(roots.withColumnRenamed("node", "tkey"), "tkey", "left").select("doc_id", "fp", "n_shingles", "tkey", F.coalesce("root", "tkey").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links"))
    known = work.saved(known, "known")
    work.drop("signed", "compared")
    least = lambda by, name: known.where("tkey IS NOT NULL").groupBy(by).agg(F.min("doc_id").alias(name))
    out = known.join(least("tkey", "copy_id"), "tkey", "left").join(least("root", "class_id"), "root", "left")
    return out.select("doc_id", "fp", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"), "n_links", "n_shingles")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of each (root, i, j), which lie together."""
    held: list[dict] = []
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            for row in batch.slice(k, 256).to_pylist():
                if held and (row["root"], row["i"], row["j"]) != (held[0]["root"], held[0]["i"], held[0]["j"]):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def one_of_each_class(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the least (doc_id, text hash).

    Texts without words are no copies of one another and stay. Of rows that share doc_id and text the one with the
    least hash over all columns stays (columns that hold maps do not count). Columns may have any names.
    """
    joined = jaccard_join(docs, width, similarity)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    own = F.when(F.col("n_shingles") == 0, F.col("fp"))  # null for texts with words: their class decides
    best = joined.groupBy("class_id", F.coalesce(own, F.lit(0)).alias("own"), (F.col("n_shingles") == 0).alias("bare")).agg(F.min(rank).alias("best"))
    best = Work(docs.sparkSession).saved(best.select(F.struct("best.doc_id", "best.fp").alias("key")), "best")
    hashed = [docs[f.name] for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    rows = docs.select(F.struct("doc_id", F.xxhash64(whole_text(docs)).alias("fp")).alias("key"), F.struct(*docs.columns).alias("row"), F.xxhash64(*hashed).alias("order"))
    # the join deals rows by the key that the aggregate needs, so texts are shuffled once
    return rows.join(best, "key", "left_semi").groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
