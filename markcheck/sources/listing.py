"""A data source that lists files folder by folder and never enters an ignored one.

``spark.read.format("pruned-files")`` gives ``folder, path, modified, bytes`` of the files under ``root`` by suffix; every
folder that is not ignored is a partition of its own. As a stream, its offset is a digest of each folder's files (name,
time and length): what is read are the folders whose digest is another one than before, whole, with one row without
a path that says the folder was looked at. So edited, new and vanished files all show, and what is kept between two
looks grows with the folders and not with the files.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from markcheck.functions import paths

FORMAT = "pruned-files"
SCHEMA = "folder string, path string, modified long, bytes long"


class Tree:
    """Files under ``root``, by folder; ``ignores`` are globs over paths from the root on."""

    def __init__(self, root: str, suffixes: Sequence[str], ignores: Sequence[str]):
        self.files, base = _opened(root)
        self.base = base.rstrip("/")
        self.suffixes = tuple(suffixes)
        patterns = [p for g in ignores for p in {paths.glob_regex(g), paths.glob_regex(re.sub(r"/\*\*$", "", g))}]
        self.ignored = re.compile("|".join(f"(?:{p})" for p in patterns)) if patterns else None

    def _wanted(self, path: str) -> bool:
        return self.ignored is None or not self.ignored.search(path[len(self.base) + 1 :])

    def look(self, folder: str) -> tuple[list[arrow_fs.FileInfo], list[str]]:
        """The files of one folder that count, and the folders in it that are not ignored."""
        found = self.files.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
        own = [f for f in found if f.type == arrow_fs.FileType.File and f.path.endswith(self.suffixes) and self._wanted(f.path)]
        return sorted(own, key=lambda f: f.path), sorted(f.path for f in found if f.type == arrow_fs.FileType.Directory and self._wanted(f.path))

    def walk(self) -> Iterator[tuple[str, list[arrow_fs.FileInfo]]]:
        """Folders and their files, from the root on."""
        todo = [self.base]
        while todo:
            folder = todo.pop()
            own, inner = self.look(folder)
            todo += reversed(inner)
            yield folder, own

    def rows(self, folder: str) -> pa.RecordBatch:
        own, _ = self.look(folder)
        return self.table([(folder, None, None, None), *((folder, f.path, f.mtime_ns // 1000, f.size) for f in own)])

    @staticmethod
    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["folder", "path", "modified", "bytes"])


def _digest(own: list[arrow_fs.FileInfo]) -> str:
    return hashlib.sha256("\0".join(f"{f.path}\0{f.mtime_ns // 1000}\0{f.size}" for f in own).encode()).hexdigest()[:32]


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Batch(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self) -> list[Folder]:
        return [Folder(folder) for folder, own in self.tree.walk() if own] or [Folder(self.tree.base)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        yield self.tree.rows(partition.path).slice(1)


class _Stream(DataSourceStreamReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def initialOffset(self) -> dict:
        return {"folders": {}}

    def latestOffset(self) -> dict:
        return {"folders": {folder: _digest(own) for folder, own in self.tree.walk() if own}}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        before, now = start["folders"], end["folders"]
        return [Folder(f) for f in sorted({*before, *now}) if before.get(f) != now.get(f)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        yield self.tree.rows(partition.path)


class PrunedFiles(DataSource):
    """Options: ``root``, ``suffixes`` and ``ignores``, the last two by line."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _tree(self) -> Tree:
        lists = {k: [x for x in self.options.get(k, "").split("\n") if x] for k in ("suffixes", "ignores")}
        return Tree(self.options["root"], lists["suffixes"] or [""], lists["ignores"])

    def reader(self, schema) -> _Batch:
        return _Batch(self._tree())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._tree())


def options(root: str, suffixes: Sequence[str], ignores: Sequence[str]) -> dict[str, str]:
    return {"root": root, "suffixes": "\n".join(suffixes), "ignores": "\n".join(ignores)}


def listed(spark: SparkSession, root: str, suffixes: Sequence[str], ignores: Sequence[str] = ()) -> DataFrame:
    """``folder, path, modified, bytes`` of the files under ``root``; microseconds since 1970."""
    spark.dataSource.register(PrunedFiles)
    return spark.read.format(FORMAT).options(**options(root, suffixes, ignores)).load()


def listed_stream(spark: SparkSession, root: str, suffixes: Sequence[str], ignores: Sequence[str] = ()) -> DataFrame:
    """The same as a stream of changed folders; a row without ``path`` stands for the folder itself."""
    spark.dataSource.register(PrunedFiles)
    return spark.readStream.format(FORMAT).options(**options(root, suffixes, ignores)).load()


def with_text(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` with the text of each, read where the row is; null where the file is no more, bad bytes replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(b.schema.get_field_index(path)).to_pylist()
            for i, name in enumerate(names):  # a row each, so that texts do not pile up
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([_content(name)], pa.string())], [*b.schema.names, text])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField(text, StringType())]))


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def _content(path: str) -> str | None:
    files, at = _opened(path)
    try:
        with files.open_input_stream(at, compression=None) as stream:
            return stream.read().decode("utf-8", "replace")
    except FileNotFoundError:
        return None


def put(path: str, text: str) -> None:
    """Writes one file and the folders it is in."""
    files, at = _opened(path)
    files.create_dir(at.rpartition("/")[0], recursive=True)
    with files.open_output_stream(at, compression=None) as stream:
        stream.write(text.encode())


def drop(spark: SparkSession, files: DataFrame) -> None:
    """Deletes the files that ``files(path)`` names, in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, at = _opened(name)
                store.delete_file(at)
            yield from ()

    files.select("path").mapInArrow(run, "path string").count()
