"""What the operators share: inputs, shared scratch tables and text as byte arrays."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.session import ensure_checkpoint_dir, tune

#: Texts may be long, so a batch holds fewer rows and bytes than Spark's defaults.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of every operator: adaptive execution and bounded Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


class Scratch:
    """Tables of one run in a folder of its own under ``spark.checkpoint.dir``.

    A stored table cuts the lineage, survives a lost executor and is read back
    column by column. ``drop`` frees a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = prepare(spark)
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def store(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and return a frame that reads what was written."""
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            target = jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(conf).delete(target, True)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, lengthened until no column of that name exists (Spark compares without case)."""
    lowered = {t.lower() for t in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def with_fields(df: DataFrame, **fields: str) -> T.StructType:
    """The schema of ``df`` followed by new fields given as name=type."""
    extra = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields.items()))
    return T.StructType([*df.schema.fields, *extra.fields])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column laid end to end, and each row's start; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def sums_per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row ``starts[i]:starts[i+1]``, also where rows are empty."""
    running = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return running[starts[1:]] - running[starts[:-1]]


def bounded_sample(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows of ``df``, chosen by a hash of their key: all of them, if there are no more.

    The rows are counted first and then filtered where they lie, so that no
    task sends more than its share. The bound is made sure of by a limit, which
    a hash of many equal keys might need.
    """
    n = df.count()
    if n <= most:
        return df
    share = int(0.95 * most / n * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) < share).limit(most)


def most_counted(counts: DataFrame, n: str, most: int, scratch: Scratch, name: str) -> DataFrame:
    """About ``most`` rows with the largest ``n``, 1 or more: all of them, if there are no more.

    A histogram of the counts, sixteen steps to each doubling, tells from which
    step on all rows fit; of the step below, as many as still fit are chosen by
    a hash of the row. So no task sends more than its share of the result.
    """
    held = scratch.store(counts, name)
    step = F.floor(F.log2(F.col(n)) * 16).cast("int")
    sizes = {r["step"]: r["rows"] for r in held.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()}
    left, cut = most, None
    for at in sorted(sizes, reverse=True):
        if sizes[at] > left:
            cut = at
            break
        left -= sizes[at]
    if cut is None:
        return held
    share = int(0.99 * left / sizes[cut] * (1 << 30))
    chosen = F.pmod(F.xxhash64(*held.columns), F.lit(1 << 30)) < share
    return held.filter((step > cut) | ((step == cut) & chosen))
