"""Archives and logs of lines as a data source of their own, for tables and for streams.

``spark.read.format("line_archive").load(folder)`` gives each line of the folder's files with
its file and byte offset.  Files are cut into ranges of ``splitBytes``; a line belongs to the
range it starts in, so large files are read by many tasks.  A filter on ``file`` is pushed
down and picks the files.  The stream form reads what was appended since the last offsets,
whole lines only.  Files are opened by Arrow's file systems, so a folder of any store that
they know will do.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SPLIT = 64 << 20
#: Lines in a batch, at most.
LINES = 2000
SCHEMA = "file string, at long, record string"


class Range(InputPartition):
    """Bytes of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Folder:
    """The files of a folder, without hidden ones, and their lines."""

    def __init__(self, options: dict[str, str]) -> None:
        self.uri, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def sizes(self) -> dict[str, int]:
        system, root = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=False))
        return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def ranges(self, spans: dict[str, tuple[int, int]]) -> list[InputPartition]:
        return [Range(p, at, min(at + self.split, end)) for p, (start, end) in sorted(spans.items()) for at in range(start, end, self.split)]

    def lines(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        name, held = part.path.rsplit("/", 1)[-1], []
        with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as f:
            at = part.start
            if at:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the line that the range before has
            while at < part.end and (line := f.readline()):
                held.append((name, at, line.rstrip(b"\r\n").decode("utf-8", "replace")))
                at += len(line)
                if len(held) >= LINES:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "at", "record"])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.names = Folder(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.folder.ranges({p: (0, n) for p, n in self.folder.sizes().items() if self.names is None or p.rsplit("/", 1)[-1] in self.names})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class ArchiveStream(DataSourceStreamReader):
    """Offsets are the bytes read of each file, as JSON, up to the last end of a line."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({p: self._whole(p, n) for p, n in sorted(self.folder.sizes().items())})}

    def _whole(self, path: str, size: int) -> int:
        """The end of the last whole line; what is behind it is still being written."""
        system, _ = fs.FileSystem.from_uri(self.folder.uri)
        with system.open_input_file(path) as f:
            end = size
            while end:
                start = max(end - (1 << 16), 0)
                f.seek(start)
                if (last := f.read(end - start).rfind(b"\n")) >= 0:
                    return start + last + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return self.folder.ranges({p: (before.get(p, 0), n) for p, n in after.items() if n > before.get(p, 0)})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class LineArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "line_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArchiveStream(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineArchive)
