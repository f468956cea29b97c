"""Lines in a wire format as Python data sources: batch and stream readers with offsets, and a writer with commit.

    spark.dataSource.register(EntityLines)
    spark.read.format("entity_lines").load(folder)
    spark.readStream.format("entity_lines").option("strict", "false").load(folder)
    df.select("line").write.format("entity_lines").mode("append").save(folder)

A user's format is a subclass with a name, a schema and `parse`. Files are found and read by pyarrow's filesystems, so a
folder may be in any store that they know. A file is whole once it is in the folder: write elsewhere and move it in, as the
writer does. For formats that Spark can split itself, `lines.entity_lines` over spark.read.text stays in the JVM and is faster.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of a file that one task reads; rows of a batch.
SPLIT, ROWS = 64 << 20, 10_000
HIDDEN = ("_", ".")


class Malformed(ValueError):
    """A line that the format doesn't have."""


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    path: str | None


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    store, folder = _store(path)
    found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith(HIDDEN)}


def _spans(sizes: dict[str, int]) -> list[Span]:
    return [Span(p, at, min(at + SPLIT, n)) for p, n in sorted(sizes.items()) for at in range(0, n, SPLIT)]


def _lines(path: str, span: Span) -> Iterator[str]:
    """A line belongs to the span that it begins in."""
    store, _ = _store(path)
    with store.open_input_file(span.path) as f:
        at = max(span.start - 1, 0)
        f.seek(at)
        held, first = b"", span.start > 0
        while True:
            piece = f.read(1 << 20)
            held += piece
            *whole, rest = held.split(b"\n")
            for line in whole:
                if not first and at >= span.end:
                    return
                if not first:
                    yield line.decode().removesuffix("\r")
                first, at = False, at + len(line) + 1
            held = rest
            if not piece:
                if held and not first and at < span.end:
                    yield held.decode().removesuffix("\r")
                return


class LineSource(DataSource):
    """Lines in a format of `parse`; malformed ones fail the query, or with strict=false come as rows whose `corrupt` is the
    line and whose other columns are null."""

    columns = "line string"

    @classmethod
    def parse(cls, line: str) -> tuple:
        """The values of a line's columns; raises ValueError for a malformed one."""
        return (line,)

    @classmethod
    def name(cls) -> str:
        return "lines"

    def schema(self) -> str:
        return f"{self.columns}, corrupt string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(type(self), self.options, schema)

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(type(self), self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("lines are only appended")
        return LineWriter(self.options["path"])


class LineReader(DataSourceReader):
    def __init__(self, source: type[LineSource], options: dict, schema: StructType):
        self.source, self.path, self.schema = source, options["path"], schema
        self.strict = options.get("strict", "true").lower() != "false"

    def partitions(self) -> list[Span]:
        return _spans(_files(self.path)) or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        blank = (None,) * (len(schema) - 1)
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for line in _lines(self.path, span) if span.path else ():
            try:
                rows.append((*self.source.parse(line), None))
            except ValueError as e:
                if self.strict:
                    raise Malformed(f"malformed line: {line[:200]}") from e
                rows.append((*blank, line))
            if len(rows) >= ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class LineStream(LineReader, DataSourceStreamReader):
    """Offsets are the files seen so far with their sizes; a batch is the files that are new since the last one."""

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(_files(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:  # type: ignore[override]
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return _spans({p: n for p, n in after.items() if p not in before}) or [Span("", 0, 0)]

    def commit(self, end: dict) -> None:
        pass


class LineWriter(DataSourceWriter):
    """One text column to lines: each task writes a hidden file, and only the commit of all of them gives them their names."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        name, n = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}", 0
        with store.open_output_stream(name) as out:
            for r in rows:
                out.write(f"{r[0]}\n".encode())
                n += 1
        if not n:
            store.delete_file(name)
        return Written(name if n else None)

    def commit(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.path:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/part-{name[1:]}")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class EntityLines(LineSource):
    """Tab-separated entities: 16 fields for A, B and C, 6 for JSON."""

    columns = "type string, id bigint, ms bigint, emitted_ms bigint, pk bigint, fk bigint, sel1 bigint, sel2 bigint, long1 bigint, long2 bigint, filter_attr int, text string, json string, padding binary, qmask bigint"

    @classmethod
    def name(cls) -> str:
        return "entity_lines"

    @classmethod
    def parse(cls, line: str) -> tuple:
        f = line.split("\t")
        whole = lambda x: int(x) if x else None
        if f[0] == "JSON" and len(f) == 6:
            return ("JSON", *map(int, f[1:4]), *[None] * 8, f[4], None, whole(f[5]))
        if f[0] not in ("A", "B", "C") or len(f) != 16:
            raise ValueError("unknown type or number of fields")
        return (f[0], *map(int, f[1:10]), whole(f[10]), f[11] or None, f[12] or None, base64.b64decode(f[14], validate=True) if f[14] else None, whole(f[15]))


class AuctionLines(LineSource):
    """Comma-separated bids of the auction format: 6 fields after the tag 2; other tags have no row in this table."""

    columns = "auction bigint, bidder bigint, price bigint, at string, extra string"

    @classmethod
    def name(cls) -> str:
        return "bid_lines"

    @classmethod
    def parse(cls, line: str) -> tuple:
        f = line.split(",")
        if f[0] != "2" or len(f) != 6:
            raise ValueError("no bid")
        return (*map(int, f[1:4]), f[4], f[5] or None)
