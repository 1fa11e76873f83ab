"""Folders of JSON documents as a data source that prunes: spark.read.format('document_folders').

    folders.register(spark)
    spark.read.format("document_folders").schema("name string, title string").option("path", base).option("file", "manifest.json").load().where("name LIKE 'a%'")

Each folder below `path` (an own folder, or key=value as writers make them) holds documents in files of a pattern, one to a file, or with by_line one to a line. The column `name` is the folder's name, its value where the folder is key=value with option key. Filters on it (equality, sets, prefixes, bounds) are taken over whole: folders that don't match are not listed, and their files not opened. Spark tells a Python source no columns, so the schema that is asked for says which fields are taken out of a document; other fields are not converted. Nested fields are asked for as strings, and are JSON then.

Documents that can't be read are left out, or stop the query with option strict. As a stream the source takes files in the order of their times of writing and their paths; the offset is the last one taken, so each file comes once, over restarts too. Files must be put in place whole (as by renaming), and not be changed.

Paths are opened in the tasks by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StringType, StructType

#: Files that one task reads at most.
FILES_OF_TASK = 200


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files  # (name, path)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_folders"

    def schema(self) -> StructType:
        raise ValueError("document_folders needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(dict(self.options), schema)


class _Documents:
    """What batches and streams share: listing and reading."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.pattern = options["path"], options.get("file", "*.json")
        self.key, self.strict = options.get("key"), options.get("strict", "false").lower() == "true"
        self.by_line, self.schema = options.get("by_line", "false").lower() == "true", schema
        self.each = int(options.get("files_of_task", FILES_OF_TASK))
        self.tests: list[Filter] = []

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _name(self, folder: str) -> str | None:
        if not self.key:
            return folder
        return folder.removeprefix(f"{self.key}=") if folder.startswith(f"{self.key}=") else None

    def _wanted(self, name: str) -> bool:
        return all(holds(f, name) for f in self.tests)

    def listed(self) -> Iterator[tuple[str, fs.FileInfo]]:
        """(name, file) of all folders that the filters leave."""
        store, base = self._store()
        for folder in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = self._name(folder.base_name) if folder.type == fs.FileType.Directory else None
            if name is not None and self._wanted(name):
                for file in store.get_file_info(fs.FileSelector(folder.path)):
                    if file.type == fs.FileType.File and fnmatch.fnmatch(file.base_name, self.pattern):
                        yield name, file

    def parted(self, files: list[tuple[str, str]]) -> list[Files]:
        return [Files(files[at : at + self.each]) for at in range(0, len(files), self.each)] or [Files([])]

    def rows(self, partition: Files) -> Iterator[tuple]:
        store, _ = self._store()
        for name, path in partition.files:
            with store.open_input_stream(path) as f:
                text = f.read()
            for document in text.split(b"\n") if self.by_line else [text]:
                if self.by_line and not document.strip():
                    continue
                try:
                    found = json.loads(document)
                    if not isinstance(found, dict):
                        raise ValueError("no object")
                    row = tuple(name if field.name == "name" else value(found.get(field.name), field.dataType) for field in self.schema.fields)
                except (ValueError, TypeError) as e:
                    if self.strict:
                        raise ValueError(f"{path}: {e}") from e
                    continue
                yield row


def value(x, kind):
    """A field of a document as a column's value; a text column takes what is nested as JSON."""
    if x is None:
        return None
    if isinstance(kind, StringType):
        return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if isinstance(kind, (DoubleType, FloatType)):
        return float(x)
    if isinstance(kind, (IntegerType, LongType)):
        if isinstance(x, float) and x != int(x):
            raise ValueError(f"{x} is no whole number")
        return int(x)
    return x


def holds(f: Filter, name: str) -> bool:
    """Whether a pushed filter lets a folder's name pass."""
    if isinstance(f, In):
        return name in f.value
    if isinstance(f, StringStartsWith):
        return name.startswith(f.value)
    return {EqualTo: name == f.value, GreaterThan: name > f.value, GreaterThanOrEqual: name >= f.value, LessThan: name < f.value, LessThanOrEqual: name <= f.value}[type(f)]


class FolderReader(_Documents, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("name",):
                self.tests.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        return self.parted(sorted((name, file.path) for name, file in self.listed()))

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class FolderStream(_Documents, DataSourceStreamReader):
    """Offsets are {"at": time of writing in ns, "path": path} of the last file taken."""

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def _ordered(self) -> list[tuple[int, str, str]]:
        return sorted((file.mtime_ns or 0, file.path, name) for name, file in self.listed())

    def latestOffset(self) -> dict:
        last = max(self._ordered(), default=(0, "", ""))
        return {"at": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["at"], start["path"]), (end["at"], end["path"])
        return self.parted([(name, path) for at, path, name in self._ordered() if low < (at, path) <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark offer Python sources their filters, which it doesn't by itself."""
    spark.dataSource.register(Folders)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
