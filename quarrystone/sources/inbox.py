"""A streaming source over append-only files of lines, with a cursor for each consumer.

Each file below a folder is an inbox or the output of a task.  An offset maps
every file to the bytes that have been taken, up to the end of a whole line;
a micro-batch reads what was appended since, one partition a piece of a file.
When a batch is committed, the consumer's cursor is written beside the files,
and an ended output that every consumer has taken whole is removed.

The query's checkpoint makes each line come once over restarts.  The cursor is
for a query with a new checkpoint; Spark commits a batch when it plans the
next, so ``settle`` writes it for a query that has ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

#: Bytes that one partition reads, and bytes read at a time when looking for a line's end.
PIECE, _TAIL = 64 << 20, 1 << 16
#: A file is ended when one of this name and ending lies beside it.
ENDED = ".ended"


@dataclass
class _Piece(InputPartition):
    name: str
    start: int
    stop: int


class _Folder:
    def __init__(self, uri: str):
        self.uri = uri
        self.store, self.root = fs.FileSystem.from_uri(uri)

    def sizes(self) -> dict[str, int]:
        """The bytes of each file of lines, by its name below the folder."""
        found = self.store.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        out = {}
        for f in found:
            name = f.path.removeprefix(self.root).lstrip("/")
            if f.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in name.split("/")) and not name.endswith(ENDED):
                out[name] = f.size
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def whole_lines(self, name: str, start: int, size: int) -> int:
        """The end of the last whole line from ``start`` to ``size``; ``start`` if there is none."""
        with self.store.open_input_file(self.path(name)) as file:
            stop = size
            while stop > start:
                low = max(start, stop - _TAIL)
                file.seek(low)
                at = file.read(stop - low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                stop = low
        return start

    def cursors(self) -> dict[str, dict[str, int]]:
        """Each consumer's offsets."""
        found = self.store.get_file_info(fs.FileSelector(self.path("_cursors"), allow_not_found=True))
        return {f.base_name.removesuffix(".json"): json.loads(self.store.open_input_stream(f.path).read()) for f in found if f.base_name.endswith(".json")}

    def write_cursor(self, consumer: str, offset: dict[str, int]) -> None:
        self.store.create_dir(self.path("_cursors"), recursive=True)
        made = self.path(f"_cursors/{consumer}.new")
        with self.store.open_output_stream(made) as file:
            file.write(json.dumps(offset).encode())
        self.store.move(made, self.path(f"_cursors/{consumer}.json"))


class LineReader(DataSourceStreamReader):
    def __init__(self, uri: str, consumer: str, piece: int):
        self.uri, self.consumer, self.piece = uri, consumer, piece

    def initialOffset(self) -> dict:
        """Where the consumer's cursor stands, so a new query goes on and does not begin again."""
        return {"files": _Folder(self.uri).cursors().get(self.consumer, {})}

    def latestOffset(self) -> dict:
        folder = _Folder(self.uri)
        known = folder.cursors().get(self.consumer, {})
        return {"files": {name: folder.whole_lines(name, min(known.get(name, 0), size), size) for name, size in sorted(folder.sizes().items())}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, stop in end["files"].items():
            for at in range(start["files"].get(name, 0), stop, self.piece):
                out.append(_Piece(name, at, min(stop, at + self.piece)))
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The lines that begin in the piece; its first one belongs to the piece before unless it begins there."""
        folder = _Folder(self.uri)
        with folder.store.open_input_file(folder.path(partition.name)) as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                skipped = _line(file)
                at += len(skipped) - 1
            file.seek(at)
            while at < partition.stop:
                line = _line(file)
                if not line.endswith(b"\n"):
                    break
                yield partition.name, at, line[:-1].decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        folder = _Folder(self.uri)
        folder.write_cursor(self.consumer, end["files"])
        cursors, sizes = folder.cursors(), folder.sizes()
        for name, size in sizes.items():
            mark = folder.path(name + ENDED)
            taken = all(own.get(name, 0) >= size for own in cursors.values())
            if taken and folder.store.get_file_info(mark).type == fs.FileType.File:
                folder.store.delete_file(folder.path(name))
                folder.store.delete_file(mark)


def settle(query: StreamingQuery, uri: str, consumer: str) -> None:
    """Write the cursor of a query that has ended, and remove what it took last of ended outputs."""
    if query.lastProgress:
        LineReader(uri, consumer, PIECE).commit(json.loads(query.lastProgress.json)["sources"][0]["endOffset"])


def _line(file) -> bytes:
    parts = []
    while chunk := file.read(4096):
        end = chunk.find(b"\n")
        if end >= 0:
            file.seek(file.tell() - len(chunk) + end + 1)
            return b"".join([*parts, chunk[: end + 1]])
        parts.append(chunk)
    return b"".join(parts)


class LineSource(DataSource):
    """``spark.readStream.format("appended_lines")`` with the options ``path`` (a URI that all executors share), ``consumer`` and ``piece``; rows are (output, position, line)."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "output string, position long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LineReader(self.options["path"], self.options.get("consumer", "default"), int(self.options.get("piece", PIECE)))
