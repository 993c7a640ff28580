"""Segment files of capture streams: a sink that cuts at record boundaries, in batch and streaming, and commits whole writes.

``wavemill.segments`` takes rows (source string, seq bigint, record binary), in order within each partition, and writes
``<source>/seg-<write>-<partition>-<number>.bin``; a source's names ascend in the order of its records if its partitions
do. Tasks write hidden files; only a commit gives them their names, so a failed or repeated write leaves none or the
same. The folder has to be mounted on every machine.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

#: Bytes after which the next record opens a new segment.
SEGMENT_BYTES = 16 << 20


@dataclass
class Written(WriterCommitMessage):
    """Hidden files of one task with the names that they get; a name's ``{write}`` stands for the write."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Segments:
    """What batch and streaming writes share."""

    def __init__(self, options):
        self.root, self.most = os.path.abspath(options["path"]), int(options.get("segmentbytes", options.get("segmentBytes", str(SEGMENT_BYTES))))
        self.hidden = f"{self.root}/_hidden-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done, partition, file, size, source = Written(), TaskContext.get().partitionId(), None, 0, None
        folder = f"{self.hidden}/{uuid.uuid4().hex}"  # of this attempt
        os.makedirs(folder, exist_ok=True)
        try:
            for batch in batches:
                for name, record in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    if name != source or size >= self.most:
                        if file is not None:
                            file.close()
                        number = len(done.files)
                        done.files.append((f"{folder}/{number}", f"{quote(str(name), safe='')}/seg-{{write}}-{partition:05d}-{number:05d}.bin"))
                        file, size, source = open(done.files[-1][0], "wb"), 0, name
                    file.write(record or b"")
                    size += len(record or b"")
        finally:
            if file is not None:
                file.close()
        return done

    def _publish(self, messages: list[Written | None], write: str) -> set[str]:
        names = set()
        for m in messages:
            for hidden, name in m.files if m is not None else ():
                final = f"{self.root}/{name.format(write=write)}"
                os.makedirs(os.path.dirname(final), exist_ok=True)
                if os.path.exists(hidden):  # a commit that is repeated finds them gone
                    os.replace(hidden, final)
                names.add(final)
        return names

    def _discard(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m is not None else ():
                if os.path.exists(hidden):
                    os.remove(hidden)


class BatchWriter(_Segments, DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages):
        before = set(segments(self.root)) if self.overwrite else set()
        after = self._publish(messages, uuid.uuid4().hex)
        for name in before - after:
            os.remove(name)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.hidden, ignore_errors=True)


class StreamWriter(_Segments, DataSourceStreamArrowWriter):
    """Segments of batch k are named by k, so a batch that runs again after a restart replaces its own files."""

    def commit(self, messages, batchId):
        write = f"{batchId:010d}"
        names = self._publish(messages, write)
        for old in segments(self.root):
            if f"/seg-{write}-" in old and old not in names:
                os.remove(old)

    def abort(self, messages, batchId):
        self._discard(messages)


class SegmentSink(DataSource):
    """``df.write.format("wavemill.segments").mode("append").save(folder)`` or ``writeStream``; register once with ``spark.dataSource.register``."""

    @classmethod
    def name(cls):
        return "wavemill.segments"

    def schema(self):
        return "source string, seq bigint, record binary"

    def writer(self, schema, overwrite):
        return BatchWriter(self.options, overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options)


def segments(root: str) -> list[str]:
    """The committed segment files of a folder, by source and order."""
    return sorted(os.path.join(d, f) for d, _, names in os.walk(root) if "/_hidden-" not in d for f in names if f.startswith("seg-"))
