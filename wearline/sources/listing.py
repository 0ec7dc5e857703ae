"""A data source that lists files, empty ones included, folder by folder in the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

if TYPE_CHECKING:
    from pyarrow import fs

SCHEMA = "path string, length long, modificationTime timestamp"
#: Folder levels below the root that the driver walks to deal folders to tasks.
LEVELS = 2


class _Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        super().__init__(None)
        self.path, self.recursive = path, recursive


def _split(root: str) -> tuple[str, str]:
    """(what stands before a path in a file's address, path) of a root; a plain path is a local one."""
    scheme, colon, rest = root.partition("://")
    if not colon:
        return "file:", root.removeprefix("file:")
    host, slash, path = rest.partition("/")
    return ("file:", slash + path) if scheme == "file" else (f"{scheme}://{host}", slash + path)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    from pyarrow import fs  # starts threads, so only where files are listed

    head, path = _split(root)
    return (fs.LocalFileSystem(), path) if head == "file:" else fs.FileSystem.from_uri(f"{head}{path}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, top = _open(self.root)
        level, parts = [top], []
        for _ in range(LEVELS):
            found = [f.path for folder in level for f in files.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.Directory]
            parts += [_Folder(folder, False) for folder in level]
            level = found
        return parts + [_Folder(folder, True) for folder in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = _open(self.root)
        head, _ = _split(self.root)
        for f in files.get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive)):
            if f.type == fs.FileType.File and fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", ".")):
                yield (f"{head}{f.path}" if f.path.startswith("/") else f"{head}/{f.path}"), f.size, f.mtime


class FileListing(DataSource):
    """`spark.read.format("file_listing").option("pattern", "*.csv").load(root)`."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below a folder of a mounted, Hadoop or object-store file system, with its size; contents are never opened."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("pattern", pattern).load(root)
