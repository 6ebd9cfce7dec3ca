"""Files as a table of hashes: a Python data source that streams each file through one task, whatever its size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task holds of a file, and of small files that it takes together.
CHUNK, TOGETHER = 4_000_000, 64_000_000
#: The schemes of paths that are read here; others go through the JVM.
SCHEMES = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if not urlparse(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class Lines:
    """Counts the lines that hold more than ASCII white space, in chunks cut anywhere."""

    def __init__(self) -> None:
        self.rows, self.said = 0, False

    def add(self, chunk: bytes) -> None:
        first, *rest = chunk.split(b"\n")
        self.said = self.said or bool(first.strip())
        if rest:
            self.rows += self.said + sum(bool(x.strip()) for x in rest[:-1])
            self.said = bool(rest[-1].strip())

    def total(self) -> int:
        return self.rows + self.said


class Some(InputPartition):
    def __init__(self, files: list[tuple[str, int]]) -> None:
        self.files = files


class HashReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Some]:
        """One task for a large file, or for small files of TOGETHER bytes."""
        where, root = _at(self.path)
        info = where.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
        out, size = [], TOGETHER
        for f in sorted((f for f in found if f.type == fs.FileType.File and not _hidden(f.path, root)), key=lambda f: f.path):
            if size + f.size > TOGETHER:
                out.append(Some([]))
                size = 0
            out[-1].files.append((f.path, f.size))
            size += f.size
        return out or [Some([])]

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        where, root = _at(self.path)
        folder = root.rstrip("/") if where.get_file_info(root).type == fs.FileType.Directory else root.rpartition("/")[0]
        for path, size in partition.files:
            digest, lines = hashlib.sha256(), Lines()
            with where.open_input_stream(path, buffer_size=0) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
                    lines.add(chunk)
            yield pa.RecordBatch.from_pydict({"file": [path.removeprefix(folder).lstrip("/")], "size": [size], "sha256": [digest.hexdigest()], "rows": [lines.total()]}, schema=pa.schema([("file", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("rows", pa.int64())]))


def _hidden(path: str, root: str) -> bool:
    """Whether Spark's own readers leave a file out: it, or a folder of it, starts with a dot or an underscore without an equals sign."""
    return any(p.startswith(".") or p.startswith("_") and "=" not in p for p in path.removeprefix(root).strip("/").split("/"))


class Hashes(DataSource):
    """spark.read.format("spindle_hashes").load(path): (file, size, sha256, rows) of a file or of all files below a folder."""

    @classmethod
    def name(cls) -> str:
        return "spindle_hashes"

    def schema(self) -> str:
        return "file string, size bigint, sha256 string, rows bigint"

    def reader(self, schema) -> HashReader:
        return HashReader(self.options["path"])


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256, rows) of a file or of every file below a folder; rows are its lines that are not blank. file is relative to the folder.

    Files of file systems that only the JVM reads are rows of one whole file each, of 2 GB at most.
    """
    if urlparse(path).scheme in SCHEMES:
        spark.dataSource.register(Hashes)
        return spark.read.format("spindle_hashes").load(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    lines = F.split(F.decode("content", "ISO-8859-1"), "\n")
    blank = F.lit(r"^[\x09-\x0D\x20]*$")
    root = path.rstrip("/").split("/")[-1] + "/"
    return files.select(F.substring_index("path", root, -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.size(F.filter(lines, lambda x: ~F.regexp_like(x, blank))).cast("long").alias("rows"))
