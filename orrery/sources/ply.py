"""Point clouds in binary PLY files.

A file has a text header and then records of 15 bytes: three little-endian floats and three bytes of colour.
``write_clouds`` and ``read_clouds`` go through the session's own file systems, wherever the files are: tasks make whole
files of a bounded number of points, Spark's commit makes them visible all at once, and what a killed task has left is
never seen. ``PlySource`` is a data source (``spark.dataSource.register(PlySource)``, format ``ply``) over folders that are
mounted on every executor; each partition is written to a valid file of its own, and files of any size are read in ranges
of whole records.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

RECORD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")])
SCHEMA = "x float, y float, z float, red int, green int, blue int"
RECORDS_PER_SPLIT = 1 << 20
# The lines of the header.
HEADER = "ply\nformat binary_little_endian 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"


def local_path(path: str) -> str:
    """The mounted path of a ``file:`` URI or plain path. The folder has to be mounted on every executor."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the ply source reads and writes mounted folders, not {parsed.scheme}:")
    return unquote(parsed.path) if parsed.scheme else path


@dataclass
class Split(InputPartition):
    """Records ``first`` to ``first + count`` of a file."""

    path: str
    first: int
    count: int
    offset: int


def read_header(path: str) -> tuple[int, int]:
    """(number of records, size of the header) of a file."""
    with open(path, "rb") as f:
        return parse_header(f.read(1024), path)


def parse_header(head: bytes, path: str) -> tuple[int, int]:
    """(number of records, size of the header) from the first bytes of a file."""
    if b"end_header\n" not in head:
        raise ValueError(f"{path} has no header of a point cloud")
    end = head.index(b"end_header\n") + len(b"end_header\n")
    lines = head[:end].decode("ascii").splitlines()
    n = next(int(x.split()[2]) for x in lines if x.startswith("element vertex"))
    if head[:end].decode("ascii") != HEADER.format(n=n):
        raise ValueError(f"{path} doesn't have the fields of a coloured point cloud")
    return n, end


def _columns(rows: np.ndarray) -> pa.RecordBatch:
    colors = [pa.array(rows[c].astype(np.int32)) for c in ("red", "green", "blue")]
    return pa.RecordBatch.from_arrays([*[pa.array(rows[c].astype(np.float32)) for c in "xyz"], *colors], names=list(RECORD.names))


def _records(batch: pa.RecordBatch) -> np.ndarray:
    rows = np.empty(batch.num_rows, RECORD)
    for c in RECORD.names:
        rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    return rows


def _files(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole files of at most ``most`` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def file() -> pa.RecordBatch:
            data = HEADER.format(n=n).encode("ascii") + b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["file"])

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = _records(batch.slice(at, most))
                if n + len(part) > most:
                    yield file()
                    held, n = [], 0
                held.append(part.tobytes())
                n += len(part)
        if n:
            yield file()

    return run


def write_clouds(points: DataFrame, path: str, most: int = RECORDS_PER_SPLIT) -> int:
    """Points (columns of ``SCHEMA``) as PLY files of at most ``most`` points in the folder ``path``, on any file system.

    Files are made and committed in a hidden folder inside ``path`` and then renamed, so that only whole files ever have
    their names; those that are there already stay. Returns how many were written; of no points that is none.
    """
    spark = points.sparkSession
    files = points.select(*RECORD.names).mapInArrow(_files(most), "file binary")
    staged = f"{path.rstrip('/')}/_making-{uuid.uuid4().hex}"
    # The text writer puts a row's bytes as they are, and a line end that the number of records leaves unread.
    paths = spark._jvm.org.apache.hadoop.fs
    folder = paths.Path(staged)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(staged)
    except Exception:
        system.delete(folder, True)
        raise
    made = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen() > 0)
    run = uuid.uuid4().hex[:8]
    for k, name in enumerate(made):
        if not system.rename(paths.Path(folder, name), paths.Path(folder.getParent(), f"part-{run}-{k:05d}.ply")):
            raise OSError(f"{staged}/{name} can't be renamed")
    system.delete(folder, True)
    return len(made)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            data = content.as_py()
            n, offset = parse_header(data[:1024], path)
            if len(data) < offset + n * RECORD.itemsize:
                raise ValueError(f"{path} ends before its last point")
            for at in range(0, n, RECORDS_PER_SPLIT):
                yield _columns(np.frombuffer(data, RECORD, min(RECORDS_PER_SPLIT, n - at), offset + at * RECORD.itemsize))


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """The points of the PLY files in a folder, on any file system. A file is read whole in one task (2 GB at most)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content")
    return files.mapInArrow(_points, SCHEMA)


class PlyReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = local_path(path)

    def partitions(self) -> list[InputPartition]:
        names = sorted(os.path.join(self.path, x) for x in os.listdir(self.path) if x.endswith(".ply")) if os.path.isdir(self.path) else [self.path]
        out: list[InputPartition] = []
        for name in names:
            n, offset = read_header(name)
            out += [Split(name, k, min(RECORDS_PER_SPLIT, n - k), offset) for k in range(0, n, RECORDS_PER_SPLIT)]
        return out or [Split("", 0, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.count:
            return
        rows = np.fromfile(split.path, RECORD, split.count, offset=split.offset + split.first * RECORD.itemsize)
        yield _columns(rows)


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class PlyWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path = local_path(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Records go to a body file, and the header before them once their number is known."""
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{uuid.uuid4().hex}")
        n = 0
        with open(f"{name}.body", "wb") as body:
            for batch in batches:
                rows = _records(batch)
                n += len(rows)
                body.write(rows.tobytes())
        with open(f"{name}.ply", "wb") as out, open(f"{name}.body", "rb") as body:
            out.write(HEADER.format(n=n).encode("ascii"))
            while chunk := body.read(1 << 20):
                out.write(chunk)
        os.remove(f"{name}.body")
        return Written(f"{name}.ply")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Hidden parts get their names once all of them are there."""
        for k, m in enumerate(m for m in messages if m and m.path):
            os.rename(m.path, os.path.join(self.path, f"part-{k:05d}-{uuid.uuid4().hex[:8]}.ply"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlyWriter(self.options["path"], overwrite)
