"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A space becomes the piece vocabulary's word mark; text before a mark that follows another character segments on its
own. The lattice of each distinct unit of a batch is filtered forward once; every occurrence samples its own path
backward with random numbers that only depend on the seed, the row key and the place in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K

SLICE_BYTES = 1 << 18
HEAD_BITS = 18
_MARK, _LITERAL = 0x2581, 0x110000  # a word mark that the text itself has is kept apart from a space


class Lattice:
    """The pieces of a model with weights by Zipf's law on their rank (``alpha``: its exponent), and byte pieces."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        usual = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.longest = max(len(pieces[i]) for i in usual)
        self.weight = np.zeros(len(pieces))
        self.weight[usual] = -alpha * np.log(np.arange(1, len(usual) + 1))
        self.byte_weight = -alpha * np.log(len(pieces) + 1)
        known: dict[int, int] = {}
        for i in usual:
            h = None
            for k, c in enumerate(pieces[i]):
                h = self._first(np.array([ord(c)])) if h is None else K.pair_hash(h, np.array([ord(c)], np.uint64))
                known.setdefault(int(h[0]), -1)
            known[int(h[0])] = i
        self.keys = np.append(np.array(sorted(known), np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ids = np.array([known.get(int(k), -1) for k in self.keys], np.int64)
        self.heads = np.searchsorted(self.keys, np.arange(1 << HEAD_BITS, dtype=np.uint64) << np.uint64(64 - HEAD_BITS))
        surface = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])

    @staticmethod
    def _first(c: np.ndarray) -> np.ndarray:
        return K.mix(c.astype(np.uint64) + np.uint64(1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes among the keys and whether they are there; the top bits give the place to start at."""
        at = self.heads[h >> np.uint64(64 - HEAD_BITS)]
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < h[behind]]
        return at, self.keys[at] == h

    def edges(self, codes: np.ndarray, unit_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece id of every piece that fits; -1 - code for a character that only bytes spell."""
        start, h = np.arange(len(codes)), None
        out = []
        for k in range(1, self.longest + 1):
            h = self._first(codes) if h is None else K.pair_hash(h, codes[start + k - 1].astype(np.uint64))
            at, alive = self.find(h)
            ids = np.where(alive, self.ids[at], -1)
            real = ids >= 0
            out.append((start[real], np.full(int(real.sum()), k), ids[real]))
            if k == 1:
                bare = start[~real]
                out.append((bare, np.ones(len(bare), np.int64), -1 - codes[bare].astype(np.int64)))
            alive &= start + k < unit_end[start]
            start, h = start[alive], h[alive]
            if not len(start):
                break
        return tuple(np.concatenate(x) for x in zip(*out))


def _utf8_sizes(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64)


class Sampler:
    def __init__(self, path: str, alpha: float, seed: int):
        self.lattice, self.seed = Lattice(path, alpha), np.uint64(seed)

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts behind one another and how many each has."""
        lat, n = self.lattice, len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.where(lengths > 0, lengths + 1, 0)
        begin = np.cumsum(size) - size
        codes = np.full(int(size.sum()), _MARK, np.int64)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        heads = begin[lengths > 0]
        body = np.ones(len(codes), bool)
        body[heads] = False
        codes[body] = np.where(raw == 32, _MARK, np.where(raw == _MARK, _LITERAL, raw))
        cut = np.zeros(len(codes), bool)
        cut[1:] = (codes[1:] == _MARK) & (codes[:-1] != _MARK)
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))
        row = np.searchsorted(begin, starts, "right") - 1
        while (empty := size[row] == 0).any():  # empty rows begin where the next one does
            row = np.where(empty, row - 1, row)
        _, first, unit = np.unique(K.hash_spans(codes, starts, ends), return_index=True, return_inverse=True)
        u_len = (ends - starts)[first]
        u_at = np.cumsum(u_len) - u_len
        within = np.arange(int(u_len.sum())) - np.repeat(u_at, u_len)
        flat = codes[np.repeat(starts[first], u_len) + within]
        of = np.repeat(np.arange(len(first)), u_len)
        e_start, e_len, e_id = lat.edges(flat, (u_at + u_len)[of])
        bare = np.flatnonzero(e_id < 0)
        spelled = np.zeros(len(e_id), np.int64)
        spelled[bare] = np.where(e_id[bare] == -1 - _LITERAL, _MARK, -1 - e_id[bare])
        weight = lat.weight[np.maximum(e_id, 0)]
        weight[bare] = lat.byte_weight * _utf8_sizes(spelled[bare])
        to = within[e_start] + e_len  # places in the unit; node = unit's first node + place
        node = u_at + np.arange(len(first))
        order = np.lexsort((of[e_start], to))
        e_start, e_len, e_id, spelled, weight, to = (x[order] for x in (e_start, e_len, e_id, spelled, weight, to))
        source = node[of[e_start]] + within[e_start]
        target = source + e_len
        new = np.append(True, target[1:] != target[:-1])
        group = np.cumsum(new) - 1
        group_at = np.flatnonzero(new)
        alpha = np.zeros(int(u_len.sum()) + len(first))
        value = np.empty(len(target))
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        for i, j in zip(cuts, np.append(cuts[1:], len(to))):
            value[i:j] = alpha[source[i:j]] + weight[i:j]
            g = group_at[group[i] : group[j - 1] + 1] - i
            top = np.maximum.reduceat(value[i:j], g)
            total = np.add.reduceat(np.exp(value[i:j] - np.repeat(top, np.diff(np.append(g, j - i)))), g)
            alpha[target[group_at[group[i] : group[j - 1] + 1]]] = top + np.log(total)
        own = np.exp(value - alpha[target])
        share = np.cumsum(own)
        ladder = group + np.minimum(share - (share[group_at] - own[group_at])[group], 1 - 1e-12)
        rank = np.zeros(len(alpha), np.int64)
        rank[target[group_at]] = np.arange(len(group_at))
        group_end = np.append(group_at[1:], len(target)) - 1
        # backward: all occurrences at once
        at = node[unit] + u_len[unit]
        seat = np.arange(len(starts)) - np.searchsorted(starts, begin, "left")[row]
        stream = K.pair_hash(K.pair_hash(keys[row], np.full(len(row), self.seed)), seat.astype(np.uint64))
        live = np.arange(len(starts))
        steps, count, k = [], np.zeros(len(starts), np.int64), 0
        while len(live):
            u = (K.pair_hash(stream[live], np.full(len(live), k, np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            r = rank[at[live]]
            edge = np.clip(np.searchsorted(ladder, r + u, "right"), group_at[r], group_end[r])
            steps.append((live, edge))
            count[live] += 1
            at[live] = source[edge]
            live = live[source[edge] != node[unit[live]]]
            k += 1
        last = np.cumsum(count) - 1
        path = np.empty(int(count.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            path[last[who] - k] = edge
        ids = e_id[path]
        owner = np.repeat(row, count)
        if (ids < 0).any():
            bare = np.flatnonzero(ids < 0)
            spell = spelled[path[bare]]
            times = np.ones(len(ids), np.int64)
            times[bare] = _utf8_sizes(spell)
            raw_bytes = np.frombuffer("".join(map(chr, spell.tolist())).encode(), np.uint8)
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = lat.byte_id[raw_bytes]
        return ids.astype(np.int32), np.bincount(owner, minlength=n)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lat = self.lattice
        size = (lat.surface_at[1:] - lat.surface_at[:-1])[ids]
        shift = np.cumsum(size) - size
        data = lat.surface[np.repeat(lat.surface_at[ids] - shift, size) + np.arange(int(size.sum()))].tobytes()
        edge = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(counts))]
        return [data[i + 1 : j].decode() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]  # without the first mark


_SAMPLERS: dict[tuple, Sampler] = {}


def _sampler(*key) -> Sampler:
    return _SAMPLERS.get(key) or _SAMPLERS.setdefault(key, Sampler(*key))


def _row_keys(col: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([0 if x is None else xxhash.xxh64_intdigest(str(x)) for x in col.to_pylist()], np.uint64)


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """``docs`` with the column pieces added: ids of one sampled segmentation of each whole text.

    Equal (key, text) rows get equal segmentations, on any partitioning. A null text gives null, an empty one no
    pieces; rows are independent; an empty table gives none; a null key counts as one key of its own; other columns
    pass through, and a column named pieces is replaced.
    """
    docs = docs.drop("pieces")
    at, key_at = docs.columns.index("text"), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model, alpha, seed)
        for batch in batches:
            for part, _, _ in K.balanced(batch, SLICE_BYTES, batch.schema.names[at]):
                texts = part.column(at).to_pylist()
                ids, counts = sampler.encode([t or "" for t in texts], _row_keys(part.column(key_at)))
                none = np.array([t is None for t in texts])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append(none, False)) if none.any() else pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield part.append_column("pieces", pa.ListArray.from_arrays(offsets, pa.array(ids)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("pieces", T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, model: str, column: str = "pieces") -> DataFrame:
    """``docs`` with the column decoded added: the text that the pieces spell; null for null."""
    docs = docs.drop("decoded")
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(model, 1.0, 11)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in K.row_slices(np.append(0, np.cumsum(sizes)), SLICE_BYTES // 4):  # ids of 4 bytes
                part, counts = batch.slice(i, j - i), sizes[i:j]
                col = part.column(at)
                texts = sampler.decode(col.flatten().to_numpy(zero_copy_only=False), counts)
                yield part.append_column("decoded", pa.array([t if ok else None for t, ok in zip(texts, col.is_valid().to_pylist())], pa.string()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())]))
