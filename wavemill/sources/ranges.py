"""Captures on any file system, cut into byte ranges of any size.

Spark's own line reader cuts the files: 0xAC, the first byte of every format-B record, is its line separator, so a range
starts at such a byte and the ranges of a file joined by it are the file. A range does not know where a record starts.
It looks for the first place from which whole records follow one another, reads on to the first end of a frame, and from
there to the last one its frames need no other range. What lies before and behind, a frame or less on either side, goes
through a second, small job that puts the pieces of each file in line: it finishes frames that cross ranges, and knows
where a walk from the file's start would have ended. Frames are numbered by the counts of the ranges before theirs.
A file that Spark would not cut needs none of this: it is read once, whole, and several small ones are decoded together.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .captures import _ARROW, _batches, A_FIELDS, B_BINS, B_TAGS, CLOSES, HEADER, MAGIC, SCHEMA, is_format_b, mac_text, records_b, signed, walk_a

#: Ranges whose table may be broadcast to number frames; beyond it frames are shuffled.
MOST_BROADCAST = 200_000
#: Bytes up to which a file is read whole, if Spark would not cut it; frames of format B decoded together.
WHOLE, AT_ONCE = 32 << 20, 2048
#: Bytes of small files whose frames are decoded together.
TOGETHER = 1 << 20
_FILES = {"recursiveFileLookup": "true", "pathGlobFilter": "*.{bin,dat}"}
_FRAME = ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("capture") and not x.startswith("frame"))
_RANGE = "path string, start bigint, size bigint, format string, head binary, tail binary, n bigint, interior bigint, broken boolean"


def _u(data, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


class Walk:
    """Whole records of one format from a place where one starts: ends, which of them end a frame, and whether the walk met something else."""

    def __init__(self, data, at: int, format: str):
        self.ends, self.closes, self.groups, self.broken = [], [], [], False
        n = len(data)
        if format == "A":
            while at + HEADER <= n:
                length = _u(data, at, 4)
                if not length:
                    self.broken = True
                    break
                if at + HEADER + length > n:
                    break
                at += HEADER + length
                self.ends.append(at)
            self.closes, self.groups = [True] * len(self.ends), [0] * len(self.ends)
        else:
            buf, most = np.frombuffer(data, np.uint8), 64
            while at + 3 <= n:
                if data[at] != MAGIC:
                    self.broken = True
                    break
                end = at + 3 + _u(data, at + 1, 2)
                if end > n:
                    break
                p, seq, place, heads = at + 3, 0, None, [at]
                while p + 3 <= end:
                    size = _u(data, p + 1, 2)
                    heads.append(p)
                    if data[p] == B_TAGS["sequence"]:
                        seq, place = _u(data, p + 3, size), (p + 3 - at, size)
                    p += 3 + size
                step = end - at
                self.ends.append(end)
                self.closes.append(bool(seq & CLOSES))
                self.groups.append(seq >> 16)
                # Records behind it whose items lie alike: looked at together, twice as many each time.
                more = min(most, (n - end) // step) if p == end and place and place[1] <= 4 else 0
                if more:
                    rows = buf[end : end + more * step].reshape(more, step)
                    fixed = (np.array(heads)[:, None] - at + np.arange(3)).ravel()
                    same = (rows[:, fixed] == buf[at + fixed]).all(1)
                    m = more if same.all() else int(same.argmin())
                    most = 2 * most if m == more else 1
                    seqs = np.zeros(m, np.int64)
                    for byte in range(place[1]):
                        seqs |= rows[:m, place[0] + byte].astype(np.int64) << (8 * byte)
                    self.ends.extend((end + step * np.arange(1, m + 1)).tolist())
                    self.closes.extend((seqs & CLOSES != 0).tolist())
                    self.groups.extend((seqs >> 16).tolist())
                    end += m * step
                at = end
            if at < n and data[at] != MAGIC:
                self.broken = True
        self.at = at


def _is_record_b(data, at: int) -> int:
    """The end of a format-B record at ``at`` whose items fill it exactly and start with the version; 0 for none, -1 if the data end first."""
    if at + 3 > len(data):
        return -1
    if data[at] != MAGIC:
        return 0
    end, p = at + 3 + _u(data, at + 1, 2), at + 3
    if p < len(data) and data[p] != B_TAGS["version"] or end < at + 6:
        return 0
    while p < end:
        if p + 3 > len(data):
            return -1
        p += 3 + _u(data, p + 1, 2)
    return 0 if p != end else end if end <= len(data) else -1


def _is_record_a(data, at: int) -> int:
    """The same for format A: a header whose geometry gives its length."""
    if at + HEADER > len(data):
        return -1
    length, rx, tx, sc = (_u(data, at + A_FIELDS[k][0], n) for k, n in (("length", 4), ("num_rx", 1), ("num_tx", 1), ("num_sc", 4)))
    if not (1 <= rx <= 8 and 1 <= tx <= 8 and 1 <= sc <= 8192 and length == rx * tx * sc * 4):
        return 0
    return at + HEADER + length if at + HEADER + length <= len(data) else -1


def _chain(data, at: int, check) -> bool:
    """Whether two whole records follow one another at ``at``, and nothing else starts behind them."""
    for k in range(3):
        end = check(data, at)
        if end <= 0:
            return end < 0 and k >= 2
        at = end
    return True


def first_record(data) -> tuple[int, str]:
    """The first place of a range where records of a format follow one another; its end and no format if there is none."""
    raw = bytes(data)
    at = raw.find(bytes([MAGIC]))
    while at >= 0:
        if _chain(raw, at, _is_record_b):
            return at, "B"
        at = raw.find(bytes([MAGIC]), at + 1)
    if len(raw) > 2 * HEADER:
        rx, tx = (np.frombuffer(raw, np.uint8)[A_FIELDS[k][0] :][: len(raw) - HEADER] for k in ("num_rx", "num_tx"))
        length = np.ndarray((len(raw) - HEADER,), "<u4", raw, A_FIELDS["length"][0], (1,))
        sc = np.ndarray((len(raw) - HEADER,), "<u4", raw, A_FIELDS["num_sc"][0], (1,))
        likely = (rx >= 1) & (rx <= 8) & (tx >= 1) & (tx <= 8) & (sc >= 1) & (sc <= 8192)
        likely &= length == rx.astype(np.uint32) * tx * np.where(likely, sc, 0) * 4
        for at in np.flatnonzero(likely).tolist():
            if _chain(raw, at, _is_record_a):
                return at, "A"
    return len(raw), ""


def inside(data, start: int) -> dict:
    """What a range can tell alone: format, head (bytes up to the first end of a frame), interior (lo, hi, n frames) and tail."""
    if start == 0:
        at, format = 0, "B" if is_format_b(bytes(data[:4])) else "A"
    else:
        at, format = first_record(data)
        if not format:
            return {"format": "", "lo": len(data), "hi": len(data), "n": 0, "broken": False}
    walk = Walk(data, at, format)
    ends = [e for e, c in zip(walk.ends, walk.closes) if c]
    if start and format == "B":
        if not ends:
            return {"format": format, "lo": len(data), "hi": len(data), "n": 0, "broken": walk.broken}
        return {"format": format, "lo": ends[0], "hi": ends[-1], "n": len(ends) - 1, "broken": walk.broken}
    return {"format": format, "lo": at, "hi": ends[-1] if ends else at, "n": len(ends), "broken": walk.broken}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """path, start, file size and bytes of each range, from its lines in order."""
    at, held = None, []

    def joined():
        return (*at, b"".join([b"\xac"] * (at[1] > 0) + [b"\xac".join(held)]))

    for batch in batches:
        paths, starts, sizes = (batch.column(k).to_pylist() for k in (1, 2, 3))
        lines = batch.column(0)
        for k in range(batch.num_rows):
            here = (paths[k], starts[k], sizes[k])
            if here != at:
                if at is not None:
                    yield joined()
                at, held = here, []
            held.append(lines[k].as_py())
    if at is not None:
        yield joined()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between 0xAC bytes, in order within each range."""
    text = spark.read.options(**_FILES).option("encoding", "ISO-8859-1").option("lineSep", "¬").text(path)
    meta = F.col("_metadata")
    return text.select(F.col("value").cast("binary").alias("line"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), meta["file_size"].alias("size"))


def ranges(lines: DataFrame) -> DataFrame:
    """One row a range: format, head and tail bytes, and the number of frames between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, size, data in _pieces(batches):
            x = inside(data, start)
            row = {"path": path, "start": start, "size": size, "format": x["format"], "head": data[: x["lo"]], "tail": data[x["hi"] :], "n": x["n"], "interior": x["hi"] - x["lo"], "broken": x["broken"]}
            yield pa.RecordBatch.from_pylist([row], _RANGES)

    return lines.mapInArrow(run, _RANGE)


_RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("format", pa.string()), ("head", pa.binary()), ("tail", pa.binary()), ("n", pa.int64()), ("interior", pa.int64()), ("broken", pa.bool_())])
_JOINED = pa.schema([("capture", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("format", pa.string()), ("kept", pa.int64()), ("crossing", pa.list_(pa.binary()))])


class Line:
    """The walk over a file's pieces from its start: holds the records of one open frame and a record that is not whole yet."""

    def __init__(self, format: str, size: int):
        self.format, self.size, self.at, self.rest, self.open, self.group, self.over = format, size, 0, b"", [], None, False

    def feed(self, piece: bytes) -> list[bytes]:
        """The bytes of the frames that this piece completes."""
        if self.over:
            return []
        data, done, before = self.rest + piece, [], 0
        walk = Walk(data, 0, self.format)
        for end, closes, group in zip(walk.ends, walk.closes, walk.groups):
            if group != self.group:
                self.open, self.group = [], group
            self.open.append(data[before:end])
            before = end
            if closes:
                done.append(b"".join(self.open))
                self.open, self.group = [], None
        self.at += before
        self.rest = data[before:]
        needs = 3 + _u(self.rest, 1, 2) if self.format == "B" else HEADER + (_u(self.rest, 0, 4) if len(self.rest) >= 4 else 0)
        self.over = walk.broken or len(self.rest) >= 3 and self.at + needs > self.size
        return done

    def clean(self) -> bool:
        return not self.rest and not self.open

    def skip(self, n: int) -> None:
        self.at += n


def in_line(found: DataFrame, root: str) -> DataFrame:
    """capture, path, start, format of the file, kept (frames between head and tail that a walk from the start would reach) and crossing (bytes of frames that end in the head)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, line = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, line = r["path"], Line(r["format"] if r["start"] == 0 else "A", r["size"])
                    line.over = r["start"] != 0  # no walk without a start
                crossing = line.feed(r["head"])
                kept = 0
                if not line.over and (r["interior"] or r["format"] and r["tail"] != b"" or r["broken"]):
                    if not line.clean() or r["format"] != line.format:
                        raise ValueError(f"{path}: records at byte {r['start']} do not line up with those before; read it in one range")
                    line.skip(r["interior"])
                    kept = r["n"]
                    line.over = r["broken"]
                    line.feed(r["tail"])
                rows.append({"capture": _name(path, root), "path": path, "start": r["start"], "format": line.format, "kept": kept, "crossing": crossing})
            yield pa.RecordBatch.from_pylist(rows, _JOINED)

    dealt = found.repartition("path").sortWithinPartitions("path", "start")
    return dealt.mapInArrow(run, "capture string, path string, start bigint, format string, kept bigint, crossing array<binary>")


def decode_b(data: bytes, plane: int) -> Iterator[pa.RecordBatch]:
    """Frames of whole records in which every frame is closed. Fields are gathered from all records of one size at once where their items lie alike."""
    walk = Walk(data, 0, "B")
    if not walk.ends:
        return
    ends = np.array(walk.ends)
    starts, buf = np.append(0, ends[:-1]), np.frombuffer(data, np.uint8)
    n = len(ends)
    number = {k: np.zeros(n, np.int64) for k in ("time", "rssi", "width", "tpi", "rpi")}
    place = {k: np.zeros((n, 2), np.int64) for k in ("mac", "real", "imag")}
    for size in np.unique(ends - starts):
        mine = np.flatnonzero(ends - starts == size)
        while len(mine):
            layout, heads, p = {}, [], 3
            first = data[starts[mine[0]] : ends[mine[0]]]
            while p + 3 <= size:
                heads.append(p)
                layout[first[p]] = (p + 3, min(_u(first, p + 1, 2), int(size) - p - 3))
                p += 3 + _u(first, p + 1, 2)
            at = starts[mine][:, None, None] + np.array(heads, np.int64).reshape(1, -1, 1) + np.arange(3)
            alike = (buf[at] == buf[at[:1]]).all((1, 2))
            group, mine = mine[alike], mine[~alike]
            for k in number:
                o, length = layout.get(B_TAGS[k], (0, 0))
                for byte in range(min(length, 8)):
                    number[k][group] |= buf[starts[group] + o + byte].astype(np.int64) << (8 * byte)
            for k in place:
                o, length = layout.get(B_TAGS[k], (0, 0))
                place[k][group] = np.stack([starts[group] + o, np.full(len(group), length)], 1)
    group, closes = np.array(walk.groups), np.array(walk.closes)
    begins = np.append(True, (group[1:] != group[:-1]) | closes[:-1])
    run = np.cumsum(begins) - 1
    closed = np.flatnonzero(closes)
    order = np.lexsort((np.arange(n), np.where(number["rpi"] == plane, number["tpi"], 0), number["rpi"] != plane, run))
    at = np.searchsorted(run[order], run[closed])
    first = order[at]
    second = order[np.minimum(at + 1, n - 1)]
    in_plane = number["rpi"] == plane
    paired = (run[second] == run[closed]) & (second != first) & in_plane[first] & in_plane[second]
    bins = np.array([B_BINS.get(int(w), 0) for w in number["width"][first]])

    for low in range(0, len(closed), AT_ONCE):
        some = slice(low, low + AT_ONCE)
        yield _frames(buf, number, place, first[some], second[some], paired[some], bins[some], low)


def _planes(buf: np.ndarray, at: np.ndarray, bins: np.ndarray, good: np.ndarray) -> pa.Array:
    """Samples of 14 bits that lie at ``at``, in order of frequency; null where a frame has none."""
    offsets = np.append(0, np.cumsum(np.where(good, bins, 0)))
    flat = np.empty(offsets[-1], np.float32)
    for width in np.unique(bins[good]).tolist():
        mine = np.flatnonzero(good & (bins == width))
        raw = np.lib.stride_tricks.sliding_window_view(buf, 2 * width)[at[mine]].view("<u2")
        values = np.fft.fftshift((raw << 2).view("<i2") >> 2, 1)  # the upper two bits are the sign's
        if len(flat) == values.size:
            flat[:] = values.ravel()
        else:
            flat[offsets[mine][:, None] + np.arange(width)] = values
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(~good))


def _names(buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The addresses of ``lengths`` bytes that lie at ``at`` as text."""
    names = np.empty(len(at), object)
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        raw = buf[at[mine][:, None] + np.arange(length)]
        if (raw == raw[:1]).all():
            names[mine] = mac_text(raw[0].tobytes())
        else:
            kinds, which = np.unique(raw, axis=0, return_inverse=True)
            names[mine] = np.array([mac_text(k.tobytes()) for k in kinds], object)[which.ravel()]
    return pa.array(names, pa.string())


def _frames(buf: np.ndarray, number: dict, place: dict, first: np.ndarray, second: np.ndarray, paired: np.ndarray, bins: np.ndarray, low: int) -> pa.RecordBatch:
    """One row a frame, numbered from ``low``, of its first record and, where there is one, its second."""
    n = len(first)
    whole = lambda record: (bins > 0) & (place["real"][record, 1] == 2 * bins) & (place["imag"][record, 1] == 2 * bins)
    one, two = whole(first), whole(second) & paired
    lead = np.where(one, first, second)
    made = {"capture": pa.repeat(pa.scalar(""), n), "frame": np.arange(low, low + n), "tick": number["time"][first], "coarse": number["time"][first] * 1000, "rssi": signed(number["rssi"][first], 8), "source": _names(buf, *place["mac"][first].T), "num_rx": one.astype(np.int32) + two, "num_tx": np.ones(n, np.int32), "num_sc": bins}
    for k, good, record in ((0, one | two, lead), (1, one & two, second)):
        made |= {f"re{k}": _planes(buf, place["real"][record, 0], bins, good), f"im{k}": _planes(buf, place["imag"][record, 0], bins, good)}
    return pa.RecordBatch.from_arrays([made[x.name] if isinstance(made[x.name], pa.Array) else pa.array(made[x.name], x.type) for x in _ARROW], schema=_ARROW)


def _decoded(data: bytes, format: str, plane: int) -> Iterator[pa.RecordBatch]:
    yield from decode_b(data, plane) if format == "B" else _batches("", walk_a(data))


def read_captures(spark: SparkSession, path: str, plane: int = 0) -> DataFrame:
    """Frames of all ``.bin`` and ``.dat`` captures under a path of any file system, with the columns of `captures.SCHEMA`.

    Frames do not depend on how files are cut (``spark.sql.files.maxPartitionBytes``); only larger files are cut. A capture is its path below
    ``path`` without its suffix; empty files and partial records at the end have no frames, and a walk ends where no
    record follows. A file whose records do not line up across ranges, as one that holds another capture as samples,
    raises a ValueError.
    """
    most = min(WHOLE, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().toString().rstrip("/")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"  # else a task for each folder lists it
    tasks = spark.conf.get(name)
    spark.conf.set(name, str(min(int(tasks), 8 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").options(**_FILES).load(path)
    finally:
        spark.conf.set(name, tasks)
    size = F.col("_metadata.file_size")  # a filter on it is applied to the listing
    found = _whole(files.where(size <= most), root, plane)
    if files.where(size > most).select(size).isEmpty():
        return found
    return found.unionByName(_cut(spark, path, root, most, plane))


def _whole(files: DataFrame, root: str, plane: int) -> DataFrame:
    """Frames of files that lie in one range each."""

    def named(parts: list[tuple[str, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches of files that were decoded together, with the captures' names and the frames' numbers."""
        counts = np.array([n for _, n in parts])
        ends, of = np.cumsum(counts), pa.array([_name(path, root) for path, _ in parts])
        low = 0
        for batch in batches:
            at = np.arange(low, low + batch.num_rows)
            which = np.searchsorted(ends, at, "right")
            low += batch.num_rows
            yield pa.RecordBatch.from_arrays([of.take(pa.array(which)), pa.array(at - (ends - counts)[which]), *batch.columns[2:]], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, bytes_held = [], [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer() if content.is_valid else b"").cast("B")
                x = inside(data, 0)
                if x["n"] and x["format"] == "A":
                    yield from named([(path, x["n"])], _decoded(bytes(data[x["lo"] : x["hi"]]), "A", plane))
                elif x["n"]:
                    parts.append((path, x["n"]))
                    held.append(data[x["lo"] : x["hi"]])
                    bytes_held += x["hi"] - x["lo"]
                if bytes_held >= TOGETHER:
                    yield from named(parts, _decoded(b"".join(held), "B", plane))
                    parts, held, bytes_held = [], [], 0
        if parts:
            yield from named(parts, _decoded(b"".join(held), "B", plane))

    some = files.select(F.col("_metadata.file_path").alias("path"), "content")
    dealt = some.rdd.getNumPartitions()  # by the number of files, however small they are
    return some.coalesce(max(4 * files.sparkSession.sparkContext.defaultParallelism, dealt // 8)).mapInArrow(run, SCHEMA)


def _cut(spark: SparkSession, path: str, root: str, most: int, plane: int) -> DataFrame:
    """Frames of the files of more than ``most`` bytes, by ranges."""
    from ..operators.joins import kept

    lines = _lines(spark, path).where(F.col("size") > most)
    joined = kept(in_line(ranges(lines), root))
    counts = joined.select("capture", "path", "start", "format", "kept", F.size("crossing").alias("_c"))
    before = F.sum(F.col("kept") + F.col("_c")).over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    counts = counts.withColumn("_base", F.coalesce(before, F.lit(0)))
    fields = f"path string, start bigint, place bigint, {_FRAME}"
    names = [x.name for x in _ARROW if x.name not in ("capture", "frame")]

    def out(path: str, start: int, first: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(path), n), pa.repeat(pa.scalar(start, pa.int64()), n), pa.array(np.arange(first, first + n)), *(batch.column(batch.schema.get_field_index(k)) for k in names)], names=["path", "start", "place", *names])

    def interior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, _, data in _pieces(batches):
            x, first = inside(data, start), 0
            for batch in _decoded(data[x["lo"] : x["hi"]], x["format"], plane) if x["n"] else ():
                yield out(path, start, first, batch)
                first += batch.num_rows

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for k, data in enumerate(r["crossing"]):
                    for made in _decoded(data, r["format"], plane):
                        yield out(r["path"], r["start"], k, made)

    few = counts.count() <= MOST_BROADCAST
    numbered = F.broadcast(counts) if few else counts
    whole = lines.mapInArrow(interior, fields).join(numbered, ["path", "start"]).where(F.col("place") < F.col("kept")).withColumn("frame", F.col("_base") + F.col("_c") + F.col("place"))
    cut = joined.where(F.size("crossing") > 0).select("path", "start", "format", "crossing").mapInArrow(crossing, fields).join(numbered, ["path", "start"]).withColumn("frame", F.col("_base") + F.col("place"))
    return whole.unionByName(cut).select("capture", "frame", *names)


def _name(path: str, root: str) -> str:
    """A capture's path below the root, or its file name if it is the root."""
    plain = lambda x: unquote(x).replace("file:///", "file:/")
    path, root = plain(path), plain(root)
    below = path[len(root) + 1 :] if path.startswith(root + "/") else path.rsplit("/", 1)[-1]
    return below.rsplit(".", 1)[0]
