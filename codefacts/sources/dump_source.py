"""Dump files as a Spark data source of their own: ``spark.read.format("codefacts_dump")``.

Gives the ordered lines that all readers here take. A large file is read as
splits, lines that nobody asks for never leave the reader, and files are chosen
by pattern before anything is opened.

Options: ``pattern`` (of file names, default all), ``keep`` (a Python regular
expression; other lines are dropped), ``splitBytes``. The path may be local or of
a file system that Arrow opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "codefacts_dump"
SCHEMA = "file string, block long, pos long, line string"
SPLIT_BYTES = 16 << 20
ROWS_PER_BATCH = 10_000


@dataclass
class Split(InputPartition):
    """Bytes ``start`` to ``stop`` of a file: the lines that begin there."""

    file: str
    start: int
    stop: int


class DumpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DumpReader(dict(self.options))


class DumpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        if not given.get("path"):
            raise ValueError(f"{NAME} needs a path")
        self.root = given["path"]
        self.pattern = given.get("pattern", "*")
        self.keep = given.get("keep")
        self.split_bytes = int(given.get("splitbytes", SPLIT_BYTES))
        if self.split_bytes < 1:
            raise ValueError("splitBytes must be positive")

    def partitions(self) -> list[Split]:
        system, path = arrow_fs.FileSystem.from_uri(self.root)
        found = system.get_file_info(path)
        if found.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        whole = found.type == arrow_fs.FileType.File
        infos = [found] if whole else system.get_file_info(arrow_fs.FileSelector(path, recursive=True))
        out = []
        for info in sorted(infos, key=lambda i: i.path):
            if info.type == arrow_fs.FileType.File and (whole or fnmatch(info.base_name, self.pattern)):
                out += [Split(info.path, s, min(s + self.split_bytes, info.size)) for s in range(0, info.size, self.split_bytes)]
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = arrow_fs.FileSystem.from_uri(self.root)
        wanted = re.compile(self.keep).search if self.keep else None
        with system.open_input_file(split.file) as file:
            rows: list[tuple[int, str]] = []
            for number, line in enumerate(_lines(file, split.start, split.stop)):
                text = line.removesuffix(b"\r").decode("utf-8", "replace")
                if wanted is None or wanted(text):
                    rows.append((number, text))
                if len(rows) == ROWS_PER_BATCH:
                    yield _batch(split, rows)
                    rows = []
            yield _batch(split, rows)


def _batch(split: Split, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    columns = [pa.array([split.file] * len(rows), pa.string()), pa.array([split.start] * len(rows), pa.int64())]
    columns += [pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "pos", "line"])


def _lines(file, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin at ``start`` or after and before ``stop``, the last one to its end."""
    at = max(start - 1, 0)  # the byte before tells whether a line begins at the split's first byte
    file.seek(at)
    held, skipping = b"", start > 0
    while True:
        data = file.read(1 << 20)
        held += data
        while (end := held.find(b"\n")) >= 0 or (not data and held):
            line, rest = (held[:end], held[end + 1 :]) if end >= 0 else (held, b"")
            if not skipping:
                if at >= stop:
                    return
                yield line
            skipping = False
            at += len(held) - len(rest)
            held = rest
        if not data or (at >= stop and not skipping):
            return


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DumpSource)
