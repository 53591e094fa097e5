"""Output of binary inspection tools as ordered lines.

Each file is inspected inside a task and its output streamed out in batches, so
a disassembly larger than memory never exists as one value.
"""

from __future__ import annotations

import subprocess
import tempfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The read-only inspections used, each given one file.
DEFINED_SYMBOLS = ("nm", "--defined-only", "--format=posix")
DISASSEMBLY = ("objdump", "-d", "--demangle", "--no-show-raw-insn")
RELOCATIONS = ("objdump", "-r")
SYMBOL_TABLE = ("objdump", "-t")
DEBUG_INFO = ("llvm-dwarfdump", "--debug-info")
DEBUG_LINE = ("llvm-dwarfdump", "--debug-line")

LINES_PER_BLOCK = 1 << 16
#: Functions of a binary that one task disassembles, and blocks that the lines of one such part may fill.
FUNCTIONS_PER_PART, BLOCKS_PER_PART = 20_000, 1 << 32
CELLS_PER_PART = 256


def address_parts(files: DataFrame, functions: DataFrame, per_part: int = FUNCTIONS_PER_PART) -> DataFrame:
    """``(file, path, part, start, stop)``: each file cut into ranges of about ``per_part`` of its ``functions`` (file, address).

    Ranges begin at a function, so that none is disassembled from its middle.
    The first one has no start and the last one no stop: what lies outside of
    all functions is in one of them. A file without functions is one range.
    """
    at = functions.select("file", F.conv("address", 16, 10).cast("decimal(20,0)").alias("at")).filter("at IS NOT NULL").distinct()
    spans = at.groupBy("file").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("n"))
    # Functions are counted on a grid of addresses, finer than the parts, so that gaps between them do no harm.
    share = (F.col("at") - F.col("low")).cast("double") / (F.col("high") - F.col("low") + 1).cast("double")
    cell = F.floor(share * F.ceil(F.col("n") / per_part) * CELLS_PER_PART).cast("long")
    cells = at.join(spans, "file").groupBy("file", cell.alias("cell")).agg(F.min("at").alias("at"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / per_part).cast("long")
    starts = cells.withColumn("part", part).groupBy("file", "part").agg(F.min("at").alias("start"))
    order = Window.partitionBy("file").orderBy("part")
    parts = starts.select(
        "file", "part", F.when(F.row_number().over(order) > 1, F.col("start")).alias("start"), F.lead("start").over(order).alias("stop")
    )
    return files.select("file", "path").join(parts, "file", "left").withColumn("part", F.coalesce("part", F.lit(0)))


def run(files: DataFrame, command: tuple[str, ...], keep: str | None = None) -> DataFrame:
    """Lines ``(file, block, pos, line)`` of ``command`` on every ``(file, path)`` row.

    ``keep`` is a Python regex; other lines are dropped where they are read.
    Rows of ``address_parts`` are inspected each by itself; their blocks follow
    one another as their addresses do.
    """
    parted = "part" in files.columns

    def inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        wanted = re.compile(keep).search if keep else (lambda line: True)
        for batch in batches:
            for file, path, part, start, stop in batch.itertuples(index=False):
                bounds = [f"--{name}-address={int(at):#x}" for name, at in (("start", start), ("stop", stop)) if at is not None]
                # Messages go to a file: a pipe that nobody reads meanwhile would fill up and stop the tool.
                with tempfile.TemporaryFile() as messages, subprocess.Popen(
                    [*command, *bounds, path], stdout=subprocess.PIPE, stderr=messages, text=True, errors="replace"
                ) as process:
                    numbered = (
                        (n, line.rstrip("\n")) for n, line in enumerate(process.stdout)
                    )
                    useful = ((n, line) for n, line in numbered if wanted(line))
                    while chunk := list(islice(useful, 10_000)):
                        yield pd.DataFrame(
                            {
                                "file": file,
                                "block": [part * BLOCKS_PER_PART + n // LINES_PER_BLOCK for n, _ in chunk],
                                "pos": [n for n, _ in chunk],
                                "line": [line for _, line in chunk],
                            }
                        )
                    if process.wait():
                        messages.seek(0)
                        message = messages.read(500).decode(errors="replace")
                        raise RuntimeError(f"{command[0]} failed on {path}: {message}")

    if not parted:
        none = F.lit(None).cast("decimal(20,0)")
        files = files.select("file", "path", F.lit(0).alias("part"), none.alias("start"), none.alias("stop"))
    # One inspection can be long, so work is handed out finely: a stated number of tasks is not merged again.
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    rows = files.select("file", "path", "part", "start", "stop").repartition(tasks, "file", "part")
    return rows.mapInPandas(inspect, "file string, block long, pos long, line string")
