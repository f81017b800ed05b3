"""Chunk files and Markdown as a data source of Spark: ``spark.read.format("corpus").load(folder)``, and as a stream.

Files are ``.md`` (one text), ``.txt`` (its non-blank lines, trimmed), ``.jsonl`` (a text per line) and ``.json`` (a list of texts), where a text
is a string or an object with ``text`` or ``content``.  Line files of any size are read in stretches, small files together, so
neither one large file nor many small ones make a large task.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

SCHEMA = "name string, kind string, at bigint, text string"
KINDS, LINE_KINDS = ("md", "txt", "jsonl", "json"), ("txt", "jsonl")
#: Bytes of one partition, and rows of one batch of Arrow.
SPLIT_BYTES, BATCH_ROWS = 64 << 20, 4096


@dataclass
class Stretch(InputPartition):
    """What one task reads: (path below the folder, first byte, end) of files or parts of line files."""

    parts: list[tuple[str, int, int]]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _kind(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def listed(folder: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of its files of a known kind, by path; names that begin with a dot or underscore are none."""
    system, root = _open(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    named = ((i.path[len(root.rstrip("/")) + 1 :], i.size) for i in found if i.type == fs.FileType.File)
    return sorted((n, size) for n, size in named if _kind(n) in KINDS and not any(p[:1] in "._" for p in n.split("/")))


def stretches(files: list[tuple[str, int]], split_bytes: int) -> list[Stretch]:
    """Files dealt to partitions of about ``split_bytes``; line files beyond it are cut."""
    made, parts, held = [], [], 0
    for name, size in files:
        step = split_bytes if _kind(name) in LINE_KINDS else max(size, 1)
        for low in range(0, max(size, 1), step):
            high = min(low + step, size)
            if parts and held + high - low > split_bytes:
                made.append(Stretch(parts))
                parts, held = [], 0
            parts.append((name, low, high))
            held += high - low
    return [*made, Stretch(parts)] if parts else made


def _text(value: object) -> str | None:
    if isinstance(value, dict):
        value = value.get("text") or value.get("content")
    return value if isinstance(value, str) and value else None


def _lines(system: fs.FileSystem, path: str, low: int, high: int) -> Iterator[tuple[int, str]]:
    """(first byte, line) of the lines that begin in a stretch; the one that ends beyond it is read to its end."""
    with io.BufferedReader(system.open_input_file(path), 1 << 20) as file:
        at = low
        if low:
            at = file.seek(low - 1)
            while at < high:  # past the line that an earlier stretch reads, but not beyond this one
                piece = file.readline(1 << 20)
                at += len(piece)
                if not piece or piece.endswith(b"\n"):
                    break
        while at < high and (line := file.readline()):
            yield at, line.removesuffix(b"\n").decode("utf-8", "replace")
            at += len(line)


def _texts(system: fs.FileSystem, root: str, name: str, low: int, high: int) -> Iterator[tuple[int, str]]:
    path, kind = f"{root}/{name}", _kind(name)
    if kind in LINE_KINDS:
        for at, line in _lines(system, path, low, high):
            if line.strip():
                text = line.strip() if kind == "txt" else _text(json.loads(line))
                if text:
                    yield at, text
        return
    with system.open_input_file(path) as file:
        whole = file.read().decode("utf-8", "replace")
    if kind == "md":
        yield 0, whole
    else:
        yield from ((i, text) for i, text in enumerate(map(_text, json.loads(whole))) if text)


def _read(folder: str, stretch: Stretch) -> Iterator[pa.RecordBatch]:
    system, root = _open(folder)
    rows: list[tuple[str, str, int, str]] = []

    def made() -> pa.RecordBatch:
        name, kind, at, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(kind), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["name", "kind", "at", "text"])

    size = 0
    for name, low, high in stretch.parts:
        for at, text in _texts(system, root.rstrip("/"), name, low, high):
            rows.append((name, _kind(name), at, text))
            size += len(text)
            if len(rows) >= BATCH_ROWS or size >= 8 << 20:
                yield made()
                rows, size = [], 0
    if rows:
        yield made()


class _Reader(DataSourceReader):
    """One listing of the folder; filters on ``name`` and ``kind`` decide which files are opened."""

    def __init__(self, folder: str, split_bytes: int) -> None:
        self.folder, self.split_bytes, self.filters = folder, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("name",), ("kind",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        def holds(f: Filter) -> bool:
            value = name if f.attribute == ("name",) else _kind(name)
            if isinstance(f, EqualTo):
                return value == f.value
            if isinstance(f, In):
                return value in f.value
            return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)

        return all(map(holds, self.filters))

    def partitions(self) -> list[Stretch]:
        return stretches([f for f in listed(self.folder) if self._wanted(f[0])], self.split_bytes) or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    """Each offset is a number of notes in the ``log`` folder; a note lists the files that were new when it was written.

    A note is written whole before its offset is used, so a restart reads the same files for the same offsets, and a file counts
    once, whatever its time.
    """

    def __init__(self, folder: str, log: str, split_bytes: int) -> None:
        self.folder, self.log, self.split_bytes = folder, log, split_bytes
        self.seen: set[str] = set()
        self.notes = 0

    def _note(self, number: int) -> str:
        return f"{_open(self.log)[1].rstrip('/')}/{number:09d}.json"

    def _files(self, number: int) -> list[tuple[str, int]] | None:
        system = _open(self.log)[0]
        if system.get_file_info(self._note(number)).type != fs.FileType.File:
            return None
        with system.open_input_stream(self._note(number)) as file:
            return [(name, size) for name, size in json.loads(file.read())]

    def initialOffset(self) -> dict:
        return {"notes": 0}

    def latestOffset(self) -> dict:
        while (known := self._files(self.notes + 1)) is not None:
            self.seen |= {name for name, _ in known}
            self.notes += 1
        new = [f for f in listed(self.folder) if f[0] not in self.seen]
        if new:
            system, root = _open(self.log)
            system.create_dir(root, recursive=True)
            target = self._note(self.notes + 1)
            with system.open_output_stream(target + ".new") as file:
                file.write(json.dumps(new).encode())
            system.move(target + ".new", target)
            self.seen |= {name for name, _ in new}
            self.notes += 1
        return {"notes": self.notes}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        files = [f for n in range(start["notes"] + 1, end["notes"] + 1) for f in self._files(n) or []]
        return stretches(files, self.split_bytes) or [Stretch([])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _read(self.folder, partition)


class CorpusSource(DataSource):
    """Format ``corpus``: (name, kind, at, text); ``at`` is the first byte of a line, or the place in a list.

    Options: ``path``; ``splitBytes``; for streams ``log``, a shared folder of its own outside ``path``.  A missing folder is an error.  Files of a stream are
    moved in whole and do not change.  Bytes that are no UTF-8 become replacement characters; a line of ``.jsonl`` that is no JSON is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def _split(self) -> int:
        return int(self.options.get("splitBytes", SPLIT_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._split())

    def streamReader(self, schema) -> DataSourceStreamReader:
        if "log" not in self.options:
            raise ValueError("a stream needs the option log")
        return _StreamReader(self.options["path"], self.options["log"], self._split())


def register_corpus(spark: SparkSession) -> None:
    """Make the format ``corpus`` known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusSource)
