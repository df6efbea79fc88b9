"""A folder of text files as a table, each file read where its task runs.

Spark's own file sources leave out names that begin with ``_`` or ``.``, which a
source tree is full of; this data source leaves out only the folders it is told to.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Endings of files that are read, and folders that aren't.
ENDINGS = ".py,.md,.txt,.rst,.json,.yaml,.yml,.toml"
SKIPPED = ".git,__pycache__,node_modules,.venv,venv,.idea,dist,build"
#: Folders from which the driver lists no further: each is walked by the task that reads it.
FOLDERS = 64


def _located(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, by its URI, and the path there. A plain path is one of the machine's own or mounted folders."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(os.path.expanduser(root))


class _Some(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options.get("path") or "."
        self.endings = tuple(options.get("endings", ENDINGS).lower().split(","))
        self.skipped = options.get("skipped", SKIPPED).split(",")
        self.errors = options.get("errors", "ignore")
        self.most = int(options.get("maxchars", "0"))

    def _listed(self, disk: fs.FileSystem, folder: str) -> tuple[list[str], list[str]]:
        """The folders to enter and the files to read of one folder."""
        found = sorted(disk.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path)
        folders = [f.path for f in found if f.type == fs.FileType.Directory and not any(fnmatch(f.base_name, s) for s in self.skipped)]
        return folders, [f.path for f in found if f.type == fs.FileType.File and os.path.splitext(f.base_name)[1].lower() in self.endings]

    def partitions(self) -> list[InputPartition]:
        disk, root = _located(self.uri)
        out, level = [], [root]
        while level and len(level) < FOLDERS:
            out += [_Some(f, False) for f in level]
            level = [x for f in level for x in self._listed(disk, f)[0]]
        return out + [_Some(f, True) for f in level]

    def read(self, partition: _Some) -> Iterator[tuple]:
        disk, root = _located(self.uri)
        waiting = [partition.folder]
        while waiting:
            folders, files = self._listed(disk, waiting.pop())
            if partition.deep:
                waiting += folders
            for full in files:
                path = posixpath.relpath(full, root)
                try:
                    with disk.open_input_stream(full) as f:
                        # a character has four bytes at most, and a line end may be two characters
                        raw = f.read(8 * (self.most + 1)) if self.most else f.read()
                except OSError as e:
                    yield path, None, str(e)
                    continue
                text = raw.decode("utf-8", self.errors).replace("\r\n", "\n").replace("\r", "\n")
                yield path, text[: self.most + 1] if self.most else text, None


class TextFolder(DataSource):
    """``spark.read.format("text_folder").load(folder)``: path, content, error.

    Options: ``endings``, ``skipped`` (comma-separated), ``errors`` (``ignore`` or
    ``replace`` for bytes that aren't UTF-8), ``maxChars`` (one more than this many characters are read). Line ends are read as ``\\n``. A file
    that can't be read has a null content and an error. Paths are relative, with ``/``. The folder is a path or a URI of any file system
    that Arrow knows. The driver lists the upper folders only; the tasks list and read the others.
    """

    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "path string, content string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFolder)


def write_texts(rows: DataFrame, root: str) -> DataFrame:
    """Write each (path, content) as a UTF-8 file under ``root``, a folder that all executors share; (path, chars, error) for each.

    The folder of a file must exist, and a path must stay under the root. Lazy, and done again if a task is; rows of one path overwrite each other.
    On a cluster ``root`` must name its file system (``hdfs://`` and the like) or be mounted on all machines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _located(root)
        for batch in batches:
            chars: list[int | None] = []
            errors: list[str | None] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                full = posixpath.normpath(posixpath.join(base, path or ""))
                try:
                    if not full.startswith(base.rstrip("/") + "/"):
                        raise OSError("outside the folder")
                    with disk.open_output_stream(full) as f:
                        f.write((content or "").encode())
                    chars.append(len(content or ""))
                    errors.append(None)
                except OSError as e:
                    chars.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(errors, pa.string())], ["path", "chars", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, chars bigint, error string")
