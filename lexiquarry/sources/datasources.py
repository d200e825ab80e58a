"""Spark data sources: ``docx_items`` (batch) and ``chat_updates`` (stream), for ``spark.read`` and ``spark.readStream``.

Files are listed and read with ``pyarrow.fs``, so a path may be local or a URI that it knows (hdfs://, s3://, gs:// and others).  Where
only Spark can read a store, ``files.files`` with ``ooxml.items`` does the same from Spark's own binary files.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..plans.shipping import ship
from .ooxml import ITEMS, body_items

UPDATES = "update_id long, value string"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, or of one file, by name."""
    from pyarrow import fs

    system, where = _filesystem(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix))


def _content(root: str, path: str) -> bytes:
    with _filesystem(root)[0].open_input_stream(path) as f:
        return f.read()


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]
    start: int = 0
    end: int = 0


class DocxItems(DataSource):
    """Paragraphs and tables of DOCX files in the order of the body.

    Options: ``path`` (a folder, searched below too, or a file), ``bytesPerPartition`` (16 MB by default: small files share a partition,
    a large one has its own).  A damaged file gives one item of the kind ``error``; the others are read.
    """

    @classmethod
    def name(cls) -> str:
        return "docx_items"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options["path"], int(self.options.get("bytesPerPartition", 16_000_000)))


class DocxReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        out, paths, held = [], [], 0
        for path, size in _listed(self.path, ".docx"):
            if paths and held + size > self.most:
                out.append(Files(tuple(paths)))
                paths, held = [], 0
            paths.append(path)
            held += size
        return out + [Files(tuple(paths))] if paths else out or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                yield from [(path, *item, None) for item in body_items(_content(self.path, path))]
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError) as e:
                yield path, 0, "error", None, None, None, f"{type(e).__name__}: {e}"


class ChatUpdates(DataSource):
    """Chat updates from a folder of ``.jsonl`` files: an update a line, with ``update_id``; ids rise with file names and lines.

    Options: ``path``; ``maxUpdatesPerTrigger`` admits at most so many ids to a micro-batch, so that a backlog is worked off in pieces (back
    pressure).  The offset is the next id to read: a query that is started again goes on there.  A line that is no update is skipped.
    """

    @classmethod
    def name(cls) -> str:
        return "chat_updates"

    def schema(self) -> str:
        return UPDATES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return UpdatesReader(self.options["path"], int(self.options.get("maxUpdatesPerTrigger", 10_000)))


class UpdatesReader(DataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most, self.at = path, most, None

    def initialOffset(self) -> dict:
        first = next((u for path, _ in _listed(self.path, ".jsonl") for u, _ in _updates(self.path, path)), 0)
        return {"update_id": first}

    def latestOffset(self) -> dict:
        """The next piece's end: what is there, but not beyond the limit from where the last piece ended."""
        if self.at is None:
            self.at = self.initialOffset()["update_id"]
        there = self.at
        for path, _ in reversed(_listed(self.path, ".jsonl")):
            last = max((u for u, _ in _updates(self.path, path)), default=None)
            if last is not None:
                there = max(there, last + 1)
                break
        self.at = min(there, self.at + self.most)
        return {"update_id": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at or 0, end["update_id"])
        return [Files((path,), start["update_id"], end["update_id"]) for path in self._between(start["update_id"], end["update_id"])] or [Files(())]

    def _between(self, start: int, end: int) -> list[str]:
        """Files that may hold ids from start to end: each holds those from its first id to the next file's."""
        firsts = [(path, next((u for u, _ in _updates(self.path, path)), None)) for path, _ in _listed(self.path, ".jsonl")]
        firsts = [(p, u) for p, u in firsts if u is not None]
        nexts = [u for _, u in firsts[1:]] + [None]
        return [p for (p, u), after in zip(firsts, nexts) if u < end and (after is None or after > start)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            for update, line in _updates(self.path, path):
                if partition.start <= update < partition.end:
                    yield update, line

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["update_id"])


def _updates(root: str, path: str) -> Iterator[tuple[int, str]]:
    for line in _content(root, path).decode("utf-8", "replace").splitlines():
        try:
            update = json.loads(line)["update_id"]
        except (ValueError, KeyError, TypeError):
            continue
        if isinstance(update, int):
            yield update, line


def register(spark: SparkSession) -> None:
    """Make both sources known to the session."""
    ship(spark)
    for source in (DocxItems, ChatUpdates):
        spark.dataSource.register(source)
