"""Page records and other extracted assets as a data source, chosen by asset kind.

`spark.read.format("extracted_assets").option("kind", "pdf").load(folder)` reads JSON lines that an extractor left in a
folder; `readStream` follows the folder. An adapter per asset kind turns one record into rows of pages:

- `pdf`: `{"asset_id", "generation", "page_number", "text"}`, one page a line;
- `image`: `{"asset_id", "generation", "lines": [...], "caption"}`, recognised lines and a caption as page 1.

A file is cut at line ends into stretches of about `bytes_per_partition`, one partition each. A stream's offset is the
name of the last file it has read; files are taken in the order of their names, so extractors number them upwards. A
batch has all files that are there, as partitions that executors share. A restart continues behind the last committed name, a repeated batch reads the same files.
Blank lines are left out; a line that is no such record is an error that names file and line.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PAGE_SCHEMA = "asset_id string, generation int, page_number int, text string"
PARTITION_BYTES = 64 << 20

Page = tuple[str, int, int, str | None]


def pdf_pages(record: dict) -> Iterator[Page]:
    text = record.get("text")
    yield str(record["asset_id"]), int(record.get("generation", 1)), int(record["page_number"]), None if text is None else str(text)


def image_pages(record: dict) -> Iterator[Page]:
    lines = [str(x) for x in record.get("lines") or [] if str(x).strip()]
    caption = record.get("caption")
    text = "\n".join([*lines, *([str(caption)] if caption else [])])
    yield str(record["asset_id"]), int(record.get("generation", 1)), 1, text or None


#: Asset kinds and what turns one of their records into pages; `register_adapter` adds to it.
ADAPTERS: dict[str, Callable[[dict], Iterator[Page]]] = {"pdf": pdf_pages, "image": image_pages}


def register_adapter(kind: str, adapter: Callable[[dict], Iterator[Page]]) -> None:
    if kind in ADAPTERS:
        raise ValueError(f"asset kind {kind} has an adapter already")
    ADAPTERS[kind] = adapter


def adapter_of(kind: str) -> Callable[[dict], Iterator[Page]]:
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter for asset kind {kind!r}; known are {sorted(ADAPTERS)}")
    return ADAPTERS[kind]


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int


def _files(uri: str) -> list[tuple[str, int]]:
    """Paths and sizes of the data files of a folder, in the order of their names."""
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _stretches(files: list[tuple[str, int]], size: int) -> list[Stretch]:
    return [Stretch(path, at, min(at + size, n)) for path, n in files for at in range(0, n, size)]


def _read(uri: str, part: Stretch, adapter: Callable[[dict], Iterator[Page]]) -> Iterator[Page]:
    system = fs.FileSystem.from_uri(uri)[0] if "://" in uri or uri.startswith("file:") else fs.LocalFileSystem()
    with io.BufferedReader(system.open_input_file(part.path)) as source:
        at = part.start
        if at:
            source.seek(at - 1)
            at += len(source.readline()) - 1  # a line that began before belongs to the stretch before
        else:
            source.seek(0)
        while at < part.end:
            line = source.readline()
            if not line:
                return
            if line.strip():
                try:
                    yield from adapter(json.loads(line))
                except (ValueError, KeyError, TypeError, AttributeError) as problem:
                    raise ValueError(f"{part.path}, byte {at}: no record of this kind ({problem!r})") from problem
            at += len(line)


class ExtractedAssets(DataSource):
    """The registered source."""

    @classmethod
    def name(cls) -> str:
        return "extracted_assets"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Options:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.adapter = adapter_of(options.get("kind", "pdf"))
        self.size = int(options.get("bytes_per_partition", PARTITION_BYTES))

    def read(self, partition: Stretch | None) -> Iterator[Page]:
        if partition is None:  # an empty folder
            return iter(())
        return _read(self.path, partition, self.adapter)


class _Batch(_Options, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return _stretches(_files(self.path), self.size)


class _Stream(_Options, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        files = _files(self.path)
        return {"file": files[-1][0].rsplit("/", 1)[-1] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        files = [(p, n) for p, n in _files(self.path) if start["file"] < p.rsplit("/", 1)[-1] <= end["file"]]
        return _stretches(files, self.size)

    def commit(self, end: dict) -> None:
        """Nothing is kept outside the stream's own checkpoint."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExtractedAssets)
