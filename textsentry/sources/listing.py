"""A listing of file trees that also holds what Spark's file source leaves out: empty files and folders that cannot be read.

It is a batch source of its own: the driver opens a few levels until there are
folders enough, and tasks walk them. No content is read.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, error string"

# Folders the driver opens before it hands the rest to tasks.
FOLDERS = 64


def _hidden(name: str) -> bool:
    """What Spark's file source skips."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _open(uri: str):
    """The file system of a folder, what its paths start with as Spark spells them, and the path there."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        path = rest if colon else uri
        return fs.LocalFileSystem(), "file:", "/" + path.lstrip("/")
    system, path = fs.FileSystem.from_uri(uri)
    return system, uri[: len(uri) - len(path)] if uri.endswith(path) else f"{scheme}://", path


def _children(system, folder: str) -> tuple[list, list[str]]:
    """Files and folders right below a folder."""
    from pyarrow import fs

    entries = [e for e in system.get_file_info(fs.FileSelector(folder)) if not _hidden(e.base_name)]
    return [e for e in entries if e.type == fs.FileType.File], [e.path for e in entries if e.type == fs.FileType.Directory]


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str]):
        self.roots = roots

    def partitions(self) -> list[InputPartition]:
        """Folders listed by themselves, and folders walked to the ground."""
        opened, waiting = [], list(self.roots)
        while waiting and len(opened) + len(waiting) < FOLDERS:
            uri = waiting.pop(0)
            opened.append(InputPartition((uri, False)))
            try:
                system, prefix, path = _open(uri)
                waiting += [prefix + folder for folder in _children(system, path)[1]]
            except OSError:  # reported by the task that lists it
                continue
        return opened + [InputPartition((uri, True)) for uri in waiting]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        uri, deep = partition.value
        system, prefix, path = _open(uri)
        folders = [path]
        while folders:
            folder = folders.pop()
            try:
                found, below = _children(system, folder)
            except OSError:
                yield prefix + folder, None, "cannot be listed"
                continue
            for entry in found:
                yield prefix + entry.path, entry.size, None
            if deep:
                folders += below


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["roots"]))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, error`` of every file below ``path`` (a folder or a glob of folders), hidden ones aside.

    A folder that cannot be listed is a row with an error and no length.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    matched = system.globStatus(system.makeQualified(where)) or []
    roots = [m.getPath().toString() for m in matched if m.isDirectory()]
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("roots", json.dumps(roots)).load()


# Executors get the source itself, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
