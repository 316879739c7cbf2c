"""A folder of text files as a Spark data source.

``spark.read.format("quarry_files").option("path", folder).load()`` lists the
folder on the driver, deals the paths to tasks and reads them there.  Hidden
folders and the fixed skip list are left out, hidden files are not; links are
not followed.  Rows of unreadable files have ``readable`` false, rows of files
with a NUL among the first 8 KB ``is_binary`` true; neither has text.
``complete`` tells on every row whether the walk could open every folder, and
is what a sweep's authority rests on.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.schema import SKIP_DIRS
from quarry.session import ship

SCHEMA = "path string, text string, mtime long, readable boolean, is_binary boolean, complete boolean"
HEAD = 8192


def skipped(name: str) -> bool:
    return name.startswith(".") or name in SKIP_DIRS


def walk(folder: str) -> tuple[list[tuple[str, int, int]], bool]:
    """(path, mtime, size) of the regular files below ``folder``, and whether every folder opened."""
    found, complete, todo = [], True, [folder]
    while todo:
        here = todo.pop()
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            complete = False
            continue
        for e in entries:
            at = f"{here}/{e.name}"
            try:
                s = os.lstat(at)
            except OSError:
                continue
            if stat.S_ISDIR(s.st_mode):
                if not skipped(e.name):
                    todo.append(at)
            elif stat.S_ISREG(s.st_mode):
                found.append((at, int(s.st_mtime), s.st_size))
    return found, complete


def read_one(path: str) -> tuple[str | None, bool, bool]:
    """(text, readable, is_binary) of one file."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        return None, False, False
    if b"\0" in data[:HEAD]:
        return None, True, True
    return data.decode("utf-8", "replace"), True, False


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]], complete: bool):
        super().__init__(0)
        self.files, self.complete = files, complete


class FolderReader(DataSourceReader):
    """Partitions hold about ``bytes`` of files each."""

    def __init__(self, folder: str, size: int, texts: bool = True):
        self.folder, self.size, self.texts = folder, size, texts

    def partitions(self) -> list[InputPartition]:
        files, complete = walk(self.folder)
        out, run, held = [], [], 0
        for path, mtime, size in files:
            run.append((path, mtime))
            held += size + 4096
            if held >= self.size:
                out.append(_Files(run, complete))
                run, held = [], 0
        return [*out, _Files(run, complete)] if run or not out else out

    def read(self, part: _Files) -> Iterator[pa.RecordBatch]:
        names = ["path", "text", "mtime", "readable", "is_binary", "complete"]
        for i in range(0, len(part.files), 256):
            some = part.files[i : i + 256]
            got = [read_one(p) if self.texts else (None, True, False) for p, _ in some]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in some], pa.string()),
                pa.array([g[0] for g in got], pa.string()),
                pa.array([m for _, m in some], pa.int64()),
                pa.array([g[1] for g in got], pa.bool_()),
                pa.array([g[2] for g in got], pa.bool_()),
                pa.array([part.complete] * len(some), pa.bool_()),
            ], names=names)


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"].rstrip("/") or "/", int(self.options.get("bytes", 32 << 20)), self.options.get("texts", "true") == "true")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(Folder)
    return spark.read.format("quarry_files").option("path", folder).load()


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, complete) of :func:`read_folder`'s rows, without opening a file."""
    ship(spark)
    spark.dataSource.register(Folder)
    return spark.read.format("quarry_files").option("path", folder).option("texts", "false").load().select("path", "mtime", "complete")


def read_listed(listing: DataFrame) -> DataFrame:
    """The files of a listing, as :func:`read_folder` reads them."""
    ship(listing.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                some = b.slice(i, 256)
                got = [read_one(p) for p in some["path"].to_pylist()]
                made = [pa.array([g[0] for g in got], pa.string()), some["mtime"], pa.array([g[1] for g in got], pa.bool_()), pa.array([g[2] for g in got], pa.bool_()), some["complete"]]
                yield pa.RecordBatch.from_arrays([some["path"], *made], names=["path", "text", "mtime", "readable", "is_binary", "complete"])

    return listing.select("path", "mtime", "complete").mapInArrow(run, SCHEMA)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the monthly capture files."""
    from pyspark.sql import functions as F

    return spark.read.text(f"{folder}/*.md", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """One token for each line, in order; a vocabulary is bounded."""
    return [line.rstrip("\r") for line in spark.read.text(path, wholetext=True).first()[0].split("\n") if line]


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The JSON object of a model's manifest."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])
