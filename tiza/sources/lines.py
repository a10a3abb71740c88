"""Lines of growing files as a data source: each complete line comes once, however often its file is appended to.

The offset of a file is the end of its last complete line. What follows it is carried over: a line that two appends make up is
read when its end is there. Files are cut into parts of CHUNK bytes; a part reads the lines that begin in it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

CHUNK = 32 << 20
#: Bytes that are read at once in search of a line's end, and lines of a batch.
BLOCK, BATCH = 1 << 16, 10_000
LINE = "file string, position bigint, value string"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (s3a as s3) and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1)) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def complete_end(file: pa.NativeFile, known: int, size: int) -> int:
    """The end of the last complete line before size; `known` if none ends after it. Reads from the end backwards."""
    end = size
    while end > known:
        begin = max(known, end - BLOCK)
        at = file.read_at(end - begin, begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return known


def complete(path: str, known: dict[str, int]) -> dict[str, int]:
    """Each file below the path and the end of its complete lines; a file that is gone or has become shorter keeps its last end."""
    fs, root = file_system(path)
    found = dict(known)
    for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        hidden = any(x.startswith((".", "_")) for x in f.path.removeprefix(root).split("/"))
        if f.type == pafs.FileType.File and not hidden and (f.size or 0) > known.get(f.path, 0):
            with fs.open_input_file(f.path) as file:
                end = complete_end(file, known.get(f.path, 0), f.size)
            if end:
                found[f.path] = end
    return found


class Part(InputPartition):
    def __init__(self, file: str, first: int, begin: int, stop: int, end: int):
        self.file, self.first, self.begin, self.stop, self.end = file, first, begin, stop, end


def parts(start: dict[str, int], end: dict[str, int]) -> list[Part]:
    cut = [(f, start.get(f, 0), e) for f, e in sorted(end.items()) if e > start.get(f, 0)]
    return [Part(f, s, b, min(e, b + CHUNK), e) for f, s, e in cut for b in range(s, e, CHUNK)]


def read_part(path: str, part: Part) -> Iterator[pa.RecordBatch]:
    """The non-blank lines that begin in [begin, stop): the last one goes on to its end."""
    fs, _ = file_system(path)
    with fs.open_input_file(part.file) as file:
        at = part.begin
        if at > part.first and file.read_at(1, at - 1) != b"\n":  # the part before reads the line that begins there
            while at < part.end:
                block = file.read_at(min(BLOCK, part.end - at), at)
                if (k := block.find(b"\n")) >= 0:
                    at += k + 1
                    break
                at += len(block)
        places, values, rest, rest_at = [], [], b"", at
        while at < part.end and rest_at < part.stop:
            block = file.read_at(min(BLOCK * 16, part.end - at), at)
            at += len(block)
            *lines, rest = (rest + block).split(b"\n")
            for line in lines:
                if rest_at >= part.stop:
                    break
                if line.strip():
                    places.append(rest_at)
                    values.append(line.decode("utf-8", "replace"))
                rest_at += len(line) + 1
                if len(places) == BATCH:
                    yield _batch(part.file, places, values)
                    places, values = [], []
        if places:
            yield _batch(part.file, places, values)


def _batch(file: str, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(places)), pa.array(places, pa.int64()), pa.array(values, pa.string())], ["file", "position", "value"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return parts({}, complete(self.path, {}))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, part) if isinstance(part, Part) else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.known = complete(self.path, self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Part]:
        # after a restart the files' ends begin from the checkpoint's, not from nothing
        self.known = {f: max(e, self.known.get(f, 0)) for f, e in end.items()} | {f: e for f, e in self.known.items() if f not in end}
        return parts(start, end)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return read_part(self.path, part)


class Lines(DataSource):
    """Format `growing_lines`, option path: rows (file, position, value) of the complete lines of all files below it; blank ones drop out."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def growing_lines(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    spark.dataSource.register(Lines)
    return (spark.readStream if stream else spark.read).format("growing_lines").option("path", path).load()
