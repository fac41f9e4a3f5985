"""A log of feed frames as a Spark data source: numbered segments, offsets, replay.

A live connection can't be read twice, so what it delivers is appended to a log first: text files of one
frame a line, named by the number of their first frame and how many they hold. An offset is the number of
the next frame. A batch is a range of numbers, whose segments are its partitions; after a restart Spark asks
for the ranges of its checkpoint, and gets the same frames. The folder is any that pyarrow's file systems
read (local, or a URI).

    frames.write.format("frame_log").mode("append").save(path)
    spark.readStream.format("frame_log").load(path)      # seq long, value string
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SEGMENT = 50_000
_NAME = re.compile(r"^(\d{20})-(\d+)\.frames$")


def _store(path: str):
    """The file system of a path or URI, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, int, str]]:
    """(first frame's number, frames, file) of the log, in order."""
    from pyarrow import fs

    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    named = [(m, f.path) for f in found if (m := _NAME.match(f.base_name))]
    return sorted((int(m[1]), int(m[2]), file) for m, file in named)


def _stage(path: str, frames: list[str]) -> str:
    """Write frames beside the log under a name that readers skip; line ends inside a frame become blanks."""
    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    name = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}"
    with store.open_output_stream(name) as out:
        out.write("".join(re.sub(r"[\r\n]+", " ", f) + "\n" for f in frames).encode())
    return name


def _publish(path: str, staged: list[tuple[str, int]]) -> int:
    """Number staged files after the log's end, in order, by renaming; returns the next number."""
    store, folder = _store(path)
    held = segments(path)
    at = held[-1][0] + held[-1][1] if held else 0
    for name, count in staged:
        store.move(name, f"{folder.rstrip('/')}/{at:020d}-{count}.frames")
        at += count
    return at


def record(receive: Callable[[], str | None], path: str, stop_after: int | None = None, segment: int = SEGMENT) -> int:
    """Append what a connection delivers until it closes (None) or `stop_after` frames; returns their number.

    `receive` is a client's blocking call, for one a web socket's recv. One recorder writes a log at a time.
    A frame is visible to readers with its segment, so a small segment keeps them close behind.
    """
    n, held = 0, []
    while stop_after is None or n < stop_after:
        frame = receive()
        if frame is not None:
            n, held = n + 1, [*held, frame]
        if held and (frame is None or len(held) >= segment):
            _publish(path, [(_stage(path, held), len(held))])
            held = []
        if frame is None:
            break
    if held:
        _publish(path, [(_stage(path, held), len(held))])
    return n


@dataclass
class Piece(InputPartition):
    """Frames first .. last of a segment, told as lines after the segment's first."""

    file: str
    number: int
    first: int
    last: int

    def __post_init__(self):
        super().__init__(self.number)


class _Reader:
    def __init__(self, path: str):
        self.path = path

    def _pieces(self, start: int, end: int) -> list[InputPartition]:
        held = [(first, max(first, start), min(first + count, end), file) for first, count, file in segments(self.path)]
        pieces = [Piece(file, lo, lo - first, hi - first) for first, lo, hi, file in held if lo < hi]
        if sum(p.last - p.first for p in pieces) != end - start:
            raise ValueError(f"frames {start} to {end} are no longer all in {self.path}")
        return pieces

    def read(self, partition: Piece | None) -> Iterator:
        import pyarrow as pa

        if partition is None:  # the one partition of a range without pieces
            return
        store, _ = _store(self.path)
        with store.open_input_stream(partition.file) as file:
            lines = file.readall().decode().split("\n")[partition.first : partition.last]
        numbers = range(partition.number, partition.number + len(lines))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(lines, pa.string())], names=["seq", "value"])


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        held = segments(self.path)
        return {"next": held[-1][0] + held[-1][1] if held else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._pieces(start["next"], end["next"])


class _BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        held = segments(self.path)
        return self._pieces(0, held[-1][0] + held[-1][1]) if held else []


@dataclass
class _Staged(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str, column: int, segment: int):
        self.path, self.column, self.segment = path, column, segment

    def write(self, iterator: Iterator) -> _Staged:
        out, held = [], []
        for row in iterator:
            held.append(row[self.column] or "")
            if len(held) == self.segment:
                out.append((_stage(self.path, held), len(held)))
                held = []
        return _Staged(out + ([(_stage(self.path, held), len(held))] if held else []))

    def commit(self, messages: list[_Staged | None]) -> None:
        _publish(self.path, [f for m in messages if m is not None for f in m.files])

    def abort(self, messages: list[_Staged | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for name, _ in message.files if message is not None else ():
                store.delete_file(name)


class FrameLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return "seq long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a frame log is only appended to")
        return _Writer(self.options["path"], schema.fieldNames().index("value"), int(self.options.get("segment", SEGMENT)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its classes travel to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FrameLog)
