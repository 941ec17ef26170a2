"""Model inputs as binary frames in files: a source and sink, for tables and streams.

A frame is a header (fixed layout, little endian: magic, version, sequence, inputs, floats, a count per possible input)
followed by its floats. ``tensors.tensor_messages`` makes the rows, ``tensors.validate_messages`` judges them.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition,
    WriterCommitMessage,
)

from flowspark.sources.tensors import HEADER_BYTES, MAX_INPUTS

# Fixed value of the frame contract.
HEADER = struct.Struct("<IIQII" + "I" * MAX_INPUTS)
assert HEADER.size == HEADER_BYTES

SCHEMA = "magic INT, version INT, seq BIGINT, n_inputs INT, total_floats INT, elem_counts ARRAY<INT>, payload ARRAY<FLOAT>"
ARROW = pa.schema([
    ("magic", pa.int32()), ("version", pa.int32()), ("seq", pa.int64()), ("n_inputs", pa.int32()), ("total_floats", pa.int32()),
    ("elem_counts", pa.list_(pa.int32())), ("payload", pa.list_(pa.float32())),
])
# Bytes after which a task begins another file, and after which a reader hands on what it has.
FILE_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024
COMMITS = "_commits"


def register_frames(spark: SparkSession) -> None:
    """Make ``format("frames")`` known to the session. Executors import this package."""
    spark.dataSource.register(FrameSource)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


def _commits(path: str) -> list[str]:
    """Paths of the commits, in order."""
    files, home = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{home}/{COMMITS}", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".json"))


def _read_json(path: str, at: str) -> dict:
    with _open(path)[0].open_input_stream(at) as f:
        return json.loads(f.read())


@dataclass
class FramesWritten(WriterCommitMessage):
    files: list[str]


@dataclass
class FrameFile(InputPartition):
    name: str

    def __init__(self, name: str):
        self.name = name


class FrameSource(DataSource):
    """Options: ``path``; ``file_bytes`` for the sink.

    Files count only when a commit lists them, which a job writes after its last task: a task that fails, or a job
    that is given up, leaves no frame, and a stream's batch that is written again counts once. Streams read commit by commit.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("frames need a path")
        return path

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self._path())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrameStreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("frames are appended, not overwritten")
        return FrameWriter(self._path(), int(self.options.get("file_bytes", FILE_BYTES)))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return FrameStreamWriter(self._path(), int(self.options.get("file_bytes", FILE_BYTES)))


def read_file(path: str, name: str) -> Iterator[pa.RecordBatch]:
    """The frames of one file, a few MB at a time. A file that ends inside a frame is an error."""
    files, home = _open(path)
    with files.open_input_stream(f"{home}/{name}") as f:
        heads, counts, floats, size = [], [], [], 0
        while head := f.read(HEADER.size):
            if len(head) < HEADER.size:
                raise ValueError(f"{name} ends inside a header")
            magic, version, seq, n, total, *each = HEADER.unpack(head)
            body = f.read(4 * total)
            if len(body) < 4 * total:
                raise ValueError(f"{name} ends inside a frame")
            heads.append((magic, version, seq, n, total))
            counts.append(each[: min(n, MAX_INPUTS)])
            floats.append(np.frombuffer(body, "<f4"))
            size += len(body)
            if size >= BATCH_BYTES or len(heads) >= 10_000:
                yield _batch(heads, counts, floats)
                heads, counts, floats, size = [], [], [], 0
        if heads:
            yield _batch(heads, counts, floats)


def _batch(heads: list, counts: list, floats: list) -> pa.RecordBatch:
    # unsigned in the frame, signed in the table: a foreign magic stays what it is, bit by bit
    table = np.array(heads, dtype=np.uint64)
    columns = [table[:, i].astype(np.int64) if i == 2 else table[:, i].astype(np.uint32).view(np.int32) for i in range(5)]
    ends = np.r_[0, np.cumsum([len(f) for f in floats])].astype(np.int32)
    payload = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(floats).astype(np.float32)))
    return pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(counts, pa.list_(pa.int32())), payload], schema=ARROW)


class FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FrameFile]:
        return [FrameFile(n) for c in _commits(self.path) for n in _read_json(self.path, c)["files"]]

    def read(self, partition: FrameFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition.name) if partition is not None else iter(())


class FrameStreamReader(DataSourceStreamReader):
    """The offset is the number of commits."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        return {"commits": len(_commits(self.path))}

    def partitions(self, start: dict, end: dict) -> list[FrameFile]:
        chosen = _commits(self.path)[start["commits"] : end["commits"]]
        return [FrameFile(n) for c in chosen for n in _read_json(self.path, c)["files"]]

    def read(self, partition: FrameFile) -> Iterator[pa.RecordBatch]:
        return read_file(self.path, partition.name)

    def commit(self, end: dict) -> None:
        pass


class _FrameSink:
    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path, file_bytes

    def write(self, batches: Iterator[pa.RecordBatch]) -> FramesWritten:
        """The task's frames, in files of about ``file_bytes``. Names are new in each attempt."""
        files, home = _open(self.path)
        files.create_dir(home, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in batches:
                for frame in frames_of(batch):
                    if out is None or size >= self.file_bytes:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.frames")
                        out, size = files.open_output_stream(f"{home}/{names[-1]}"), 0
                    out.write(frame)
                    size += len(frame)
        except BaseException:
            if out is not None:
                out.close()
            self._remove(names)
            raise
        if out is not None:
            out.close()
        return FramesWritten(names)

    def _remove(self, names: list[str]) -> None:
        files, home = _open(self.path)
        for n in names:
            if files.get_file_info(f"{home}/{n}").type == fs.FileType.File:
                files.delete_file(f"{home}/{n}")

    def _publish(self, messages: list, batch_id: int | None) -> None:
        files, home = _open(self.path)
        names = [n for m in messages if m is not None for n in m.files]
        done = _commits(self.path)
        if batch_id is not None and any(_read_json(self.path, c)["batch"] == batch_id for c in done[-2:]):
            self._remove(names)  # the batch was written before
            return
        files.create_dir(f"{home}/{COMMITS}", recursive=True)
        at = f"{home}/{COMMITS}/{len(done):012d}"
        with files.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps({"batch": batch_id, "files": names}).encode())
        files.move(f"{at}.new", f"{at}.json")

    def _give_up(self, messages: list) -> None:
        self._remove([n for m in messages if m is not None for n in m.files])


def frames_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Rows as bytes. A row whose counts do not fit its floats is an error."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in ARROW.names]
    heads = list(zip(*[c.to_pylist() for c in columns[:5]]))
    counts, payloads = columns[5], columns[6]
    for i, (magic, version, seq, n, total) in enumerate(heads):
        each = counts[i].as_py()
        body = np.asarray(payloads[i].values.to_numpy(zero_copy_only=False), dtype="<f4")
        if n != len(each) or n > MAX_INPUTS or total != len(body) or sum(each) != total:
            raise ValueError(f"counts of frame {seq} do not fit its floats")
        yield HEADER.pack(magic, version, seq, n, total, *each, *[0] * (MAX_INPUTS - n)) + body.tobytes()


class FrameWriter(_FrameSink, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._publish(messages, None)

    def abort(self, messages: list) -> None:
        self._give_up(messages)


class FrameStreamWriter(_FrameSink, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self._publish(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self._give_up(messages)
