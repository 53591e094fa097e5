"""Token counts from flat, unindexed token files by a separator scan.

A token file is ids end to end, each document closed by a separator id; nothing
says where documents begin. Files are cut into blocks of fixed size and every
block is searched for the separator at once. A block yields the documents that
begin and end in it; what its edges cut is stitched by a running sum over the
blocks of a file, as a prefix scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import Scratch, prepare, require
from codefacts.llm.tokens import END_ID, default_vocabulary, encoder

#: Bytes of a block; a multiple of every id width.
BLOCK_BYTES = 4 << 20
#: Blocks of a scan task.
BLOCKS_PER_TASK = 4
#: Blocks whose prefix is scanned together; the prefixes of such stretches are scanned in a second step.
STRETCH = 1024


@dataclass(frozen=True)
class TokenFiles:
    """``files``: path, bytes, n_docs, file_no. ``names``: file_no, ordinal, doc_key. Ids are little-endian, ``width`` bytes each."""

    files: DataFrame
    names: DataFrame
    width: int
    separator: int


def _system(path: str):
    """The Arrow file system of a URI and the path in it; plain paths are local."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


def open_file(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def create_file(path: str):
    system, inner = _system(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def write_token_files(
    docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, separator: int = END_ID
) -> TokenFiles:
    """One flat file per task under the shared folder: ids of two bytes, every document closed by ``separator``.

    A retried task writes a file of its own name, and only files of successful
    attempts are listed. Null and empty texts are a lone separator. The special
    token's own text inside a document is read as ordinary text, since no scan
    could tell its id from a separator.
    """
    require(docs, key, text)
    scratch = Scratch(docs.sparkSession, "token-files")
    root, vocabulary = scratch.path("flat"), vocabulary or default_vocabulary()

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        path, ordinal, out = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}.bin", 0, None
        encode = encoder(vocabulary).ids
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            if not bodies:
                continue
            out = out or create_file(path)
            sizes = []
            for body in bodies:
                ids = encode(body)
                if (ids == separator).any():
                    ids = encoder(vocabulary).fast.encode_to_numpy(body, disallowed_special=())
                out.write(np.append(ids, np.uint32(separator)).astype("<u2").tobytes())
                sizes.append(2 * (len(ids) + 1))
            n = len(bodies)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), keys, pa.array(sizes, pa.int64())],
                names=["path", "ordinal", "doc_key", "bytes"],
            )
            ordinal += n
        if out:
            out.close()

    slim = docs.select(F.col(key).cast("bigint").alias("doc_key"), F.col(text))
    listed = scratch.store(slim.mapInArrow(run, "path string, ordinal bigint, doc_key bigint, bytes bigint"), "listed")
    files = scratch.store(listed.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_docs")), "files")
    return TokenFiles(files, listed.select("path", "ordinal", "doc_key"), 2, separator)


def scan_separators(files: DataFrame, width: int = 2, separator: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, start, n_tokens) of every document in flat files given as (path, bytes).

    ``start`` counts ids before the document in its file, ``n_tokens`` leaves
    the separator out; documents of no tokens are rows too. Ids after a file's
    last separator are its last document, if there are any. An empty file has
    no documents. A file whose size is no multiple of the width is an error.
    """
    require(files, "path", "bytes")
    if block_bytes % width:
        raise ValueError("a block must hold whole ids")
    spark = prepare(files.sparkSession)
    kind = np.dtype(f"<u{width}")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(block_bytes).cast("bigint"))
    blocks = files.filter("bytes > 0").select("path", "bytes", F.explode(starts).alias("at"))
    blocks = blocks.select("path", "bytes", "at", F.expr(f"least({block_bytes}, bytes - at)").alias("size"))
    per_task = max(1, BLOCKS_PER_TASK)
    n_tasks = spark.sparkContext.defaultParallelism
    total = blocks.count()
    blocks = blocks.repartition(max(n_tasks, total // per_task), "path", "at")

    def run(frames):
        """Separator places of each block, as positions in the file."""
        for frame in frames:
            for path, size_all, at, size in zip(frame["path"], frame["bytes"], frame["at"], frame["size"], strict=True):
                if size_all % width:
                    raise ValueError(f"{path}: {size_all} bytes are no whole ids of {width}")
                with open_file(path) as file:
                    ids = np.frombuffer(file.read_at(int(size), int(at)), kind)
                first = at // width
                ends = np.flatnonzero(ids == separator) + first
                yield pd.DataFrame(
                    {
                        "path": path, "at": at, "n_ends": len(ends), "first_end": ends[0] if len(ends) else -1,
                        "last_end": ends[-1] if len(ends) else -1, "stop": first + len(ids), "last": at + size == size_all,
                        "inner_start": [ends[:-1] + 1], "inner_n": [np.diff(ends) - 1],
                    }
                )

    schema = "path string, at bigint, n_ends bigint, first_end bigint, last_end bigint, stop bigint, last boolean"
    scanned = blocks.mapInPandas(run, f"{schema}, inner_start array<bigint>, inner_n array<bigint>")
    found = Scratch(spark, "separators").store(scanned, "blocks")
    seams = _prefix(found.drop("inner_start", "inner_n"), block_bytes)
    edge = seams.filter("n_ends > 0").select("path", "ordinal", F.col("begin").alias("start"), (F.col("first_end") - F.col("begin")).alias("n_tokens"))
    tail_begin = F.when(F.col("n_ends") > 0, F.col("last_end") + 1).otherwise(F.col("begin"))
    tail = seams.withColumn("tail", tail_begin).filter("last AND tail < stop")
    tail = tail.select("path", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), F.col("tail").alias("start"), (F.col("stop") - F.col("tail")).alias("n_tokens"))
    held = found.filter("n_ends > 1").join(seams.select("path", "at", "ordinal"), ["path", "at"])
    inner = held.select("path", "ordinal", F.posexplode(F.arrays_zip("inner_start", "inner_n")).alias("i", "document")).select(
        "path", (F.col("ordinal") + F.col("i") + 1).alias("ordinal"), F.col("document.inner_start").alias("start"), F.col("document.inner_n").alias("n_tokens")
    )
    return edge.unionByName(tail).unionByName(inner)


def _prefix(blocks: DataFrame, block_bytes: int) -> DataFrame:
    """``blocks`` with the number of documents that ended before and the place where the open one begins.

    A two-level scan: within stretches of blocks, then over the stretches of a file.
    """
    blocks = blocks.withColumn("stretch", F.floor(F.col("at") / (block_bytes * STRETCH)).cast("bigint"))
    end = F.when(F.col("n_ends") > 0, F.col("last_end"))

    def before(*keys: str, order: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    stretches = blocks.groupBy("path", "stretch").agg(F.sum("n_ends").alias("n"), F.max(end).alias("end"))
    over = before("path", order="stretch")
    stretches = stretches.select("path", "stretch", F.sum("n").over(over).alias("n_before"), F.max("end").over(over).alias("end_before"))
    near = before("path", "stretch", order="at")
    placed = blocks.withColumns({"n_near": F.sum("n_ends").over(near), "end_near": F.max(end).over(near)})
    zero = F.lit(0).cast("bigint")
    return placed.join(stretches, ["path", "stretch"]).withColumns(
        {
            "ordinal": F.coalesce("n_before", zero) + F.coalesce("n_near", zero),
            "begin": F.coalesce("end_near", "end_before", F.lit(-1).cast("bigint")) + 1,
        }
    )


def token_counts(files: TokenFiles, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_key, path, ordinal, start, n_tokens): what the scan found, with the documents' names."""
    found = scan_separators(files.files, files.width, files.separator, block_bytes)
    return found.join(files.names, ["path", "ordinal"], "left")
