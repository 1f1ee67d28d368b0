"""Live frames as a stream: a Python data source over append-only spool files, one for each stream.

A gateway appends each frame to its stream's file as a head (lengths of the id and of the payload), the id and the
payload. Offsets name for each stream the bytes read and the frames counted, so what a query has read is exactly what its
checkpoint says: one that starts again repeats and loses nothing. A frame counts once all of its record is there.

``spark.dataSource.register(LiveFrameSource)``, format ``live_frames``, option ``path``: a folder mounted on every executor.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from orrery.sources.ply import local_path

SCHEMA = "stream_id string, arrival_seq long, frame_id string, payload_bytes long, decodable boolean"
HEAD = struct.Struct("<II")
ENDING = ".frames"
# The first bytes of the image formats that frames may have.
IMAGE_STARTS = (b"\xff\xd8\xff", b"\x89PNG\r\n\x1a\n", b"RIFF", b"BM")
FRAMES_PER_BATCH = 10_000


def spool_file(path: str, stream_id: str) -> str:
    """The file of a stream; any id makes a file name."""
    return os.path.join(local_path(path), quote(stream_id, safe="") + ENDING)


def append_frame(path: str, stream_id: str, frame_id: str, payload: bytes) -> None:
    """Appends a frame, as the gateway that receives a stream does; a stream has one writer."""
    os.makedirs(local_path(path), exist_ok=True)
    name = frame_id.encode()
    with open(spool_file(path, stream_id), "ab") as out:
        out.write(HEAD.pack(len(name), len(payload)) + name + payload)


def records(path: str, at: int, end: int) -> Iterator[tuple[int, str, int, bytes]]:
    """(end of the record, frame id, payload's length, its first bytes) of whole records between two places of a file."""
    with open(path, "rb") as f:
        while at + HEAD.size <= end:
            f.seek(at)
            id_length, length = HEAD.unpack(f.read(HEAD.size))
            at += HEAD.size + id_length + length
            if at > end:
                return
            yield at, f.read(id_length).decode(), length, f.read(min(length, 16))


@dataclass
class Range(InputPartition):
    """Frames of a stream between two places of its file; the first one has the number ``first``."""

    stream_id: str
    start: int
    end: int
    first: int


class LiveFrameReader(DataSourceStreamReader):
    """Offsets are ``{stream: [bytes, frames]}``."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802  names of the interface
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        folder = local_path(self.path)
        for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
            if name.endswith(ENDING):
                at, n = self.seen.get(name, (0, 0))
                file = os.path.join(folder, name)
                for after, *_ in records(file, at, os.path.getsize(file)):
                    at, n = after, n + 1
                if n:
                    self.seen[name] = [at, n]
        return {unquote(name.removesuffix(ENDING)): list(x) for name, x in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = [(s, *start.get(s, (0, 0)), *x) for s, x in sorted(end.items())]
        return [Range(s, a, b, n) for s, a, n, b, _ in ranges if b > a] or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["stream_id", "arrival_seq", "frame_id", "payload_bytes", "decodable"])

        if partition.end > partition.start:
            for k, (_, frame, length, head) in enumerate(records(spool_file(self.path, partition.stream_id), partition.start, partition.end)):
                rows.append((partition.stream_id, partition.first + k, frame, length, head.startswith(IMAGE_STARTS)))
                if len(rows) >= FRAMES_PER_BATCH:
                    yield batch()
                    rows.clear()
            if rows:
                yield batch()

    def commit(self, end: dict) -> None:
        """Nothing to do: spool files stay until the gateway ends a stream."""


class LiveFrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_frames"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LiveFrameReader(self.options["path"])
