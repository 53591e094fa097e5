"""The build tool's binary dependency log."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.session import ensure_checkpoint_dir, exists

# File name, signature, version and record limits.
LOG_NAME = ".ninja_deps"
MAGIC = b"# ninjadeps\n"
VERSION = 4
GREATEST_RECORD = 1 << 24
DEPS_BIT = 1 << 31

ROWS_PER_FRAME = 50_000
COLUMNS = {"file": pa.string(), "sequence": pa.int64(), "output": pa.string(), "ordinal": pa.int32(), "input": pa.string()}
#: Bytes read from a log at once, and the schemes that a task opens itself.
CHUNK_BYTES = 1 << 20
OPENED_SCHEMES = ("file", "hdfs", "s3", "gs")


class _Bytes:
    """Bytes of a log taken from its chunks as they are asked for; at most a chunk and a record are held."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at, self.passed = iter(chunks), b"", 0, 0

    def take(self, n: int) -> bytes | None:
        """The next ``n`` bytes, or None if the log ends before."""
        while len(self.held) - self.at < n:
            more = next(self.chunks, None)
            if more is None:
                return None
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        self.passed += n
        return self.held[self.at - n : self.at]


def entries(chunks: bytes | Iterable[bytes]) -> Iterator[tuple[int, str, int, str]]:
    """``(sequence, output, ordinal, input)`` of one log, whole or in chunks; a cut-off tail is ignored, a wrong size is an error.

    What is carried from chunk to chunk is the paths named so far.
    """
    log = _Bytes([chunks] if isinstance(chunks, bytes) else chunks)
    if log.take(len(MAGIC)) != MAGIC:
        raise ValueError("not a dependency log")
    version = log.take(4)
    if version is None or struct.unpack("<I", version)[0] != VERSION:
        raise ValueError("dependency log version is not 4")
    known: list[str] = []
    sequence = 0
    while (head := log.take(4)) is not None:
        (word,) = struct.unpack("<I", head)
        size = word & ~DEPS_BIT
        if not 4 <= size <= GREATEST_RECORD:
            raise ValueError(f"a dependency record of {size} bytes at byte {log.passed - 4}")
        record = log.take(size)
        if record is None:
            return
        if word & DEPS_BIT:
            if size < 12 or size % 4:
                raise ValueError(f"malformed dependency record of {size} bytes")
            ids = struct.unpack(f"<{size // 4}I", record)
            if ids[0] < len(known):
                inputs = [known[i] for i in ids[3:] if i < len(known)]
                # An output without inputs still supersedes its earlier record.
                for ordinal, name in enumerate(inputs or [""]):
                    yield sequence, known[ids[0]], ordinal, name
        else:
            (check,) = struct.unpack("<I", record[-4:])
            if check != 0xFFFFFFFF ^ len(known):
                raise ValueError(f"path record {len(known)} fails its check")
            known.append(record[:-4].rstrip(b"\0").decode("utf-8", "surrogateescape"))
        sequence += 1


def _frames(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while chunk := list(islice(rows, ROWS_PER_FRAME)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), COLUMNS.values())], names=list(COLUMNS))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of whole logs; many small ones share a frame."""
    return _frames(
        (file, *entry)
        for batch in batches
        for file, content in zip(batch["file"].to_pylist(), batch["content"])
        for entry in entries(content.as_py())
    )


def _opened_entries(file: str) -> Iterator[tuple]:
    with _opened(file) as log:
        for entry in entries(iter(lambda: log.read(CHUNK_BYTES), b"")):
            yield file, *entry


def _parse_opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _frames(row for batch in batches for file in batch["file"].to_pylist() for row in _opened_entries(file))


ENTRIES = "file string, sequence long, output string, ordinal int, input string"


def dependencies(logs: DataFrame) -> DataFrame:
    """``(file, output, ordinal, input)`` from ``(file, content)``; the last record of an output wins."""
    return _latest(logs.select("file", "content").mapInArrow(_parse, ENTRIES))


def _latest(rows: DataFrame) -> DataFrame:
    """The last record of each output; the logs are parsed once, an output's records are bounded by its rebuilds."""
    latest = F.max("sequence").over(Window.partitionBy("file", "output"))
    return (
        rows.withColumn("latest", latest)
        .filter((F.col("sequence") == F.col("latest")) & (F.col("input") != ""))
        .select("file", "output", "ordinal", "input")
    )


def _opened(file: str):
    """A log that is known to exist: a task that cannot reach it fails."""
    local = re.sub(r"^file:/+", "/", file)
    if ":/" not in local:
        return open(local, "rb")
    system, path = arrow_fs.FileSystem.from_uri(file)
    return system.open_input_stream(path)


def _copied(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, content)`` of logs whose file system only Spark reads.

    Spark's file sources leave out names that start with a dot, so each log is
    copied under another name into the shared folder, by the file systems'
    own streams, and read from there.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    for i, file in enumerate(files):
        source, target = jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.hadoop.fs.Path(f"{folder}/{i}.log")
        jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    names = spark.createDataFrame(list(enumerate(files)), "number int, file string")
    read = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"/(\d+)\.log$", 1).cast("int").alias("number"), "content")
    return read.join(F.broadcast(names), "number").select("file", "content")


def read_dependencies(spark: SparkSession, *build_dirs: str) -> DataFrame:
    """Dependencies of one or more builds; a build without a log has none.

    Whether a log exists is asked of its own file system here. A log on a local
    file system, or one that Arrow knows, is read by the task that parses it,
    a chunk at a time. One of another file system (``viewfs``, ``s3a``, ...) is
    copied into the shared folder and read by Spark.
    """
    found = [f for f in (f"{d.rstrip('/')}/{LOG_NAME}" for d in build_dirs) if exists(spark, f)]
    scheme = lambda f: f.partition(":/")[0] if ":/" in f else "file"
    near = [f for f in found if scheme(f) in OPENED_SCHEMES]
    far = [f for f in found if scheme(f) not in OPENED_SCHEMES]
    rows = spark.createDataFrame([(f,) for f in near], "file string").mapInArrow(_parse_opened, ENTRIES)
    if far:
        rows = rows.unionByName(_copied(spark, far).mapInArrow(_parse, ENTRIES))
    return _latest(rows)
