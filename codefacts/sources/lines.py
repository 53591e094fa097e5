"""Ordered text lines and carrying context from line to line.

A line is ``(file, block, pos, line)``: ``block`` is the byte offset of the
split it was read from and ``pos`` grows inside the split, so ``(block, pos)``
orders a file while no task has to hold more than one split of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.functions import paths


def read_lines(spark: SparkSession, root: str | list[str], pattern: str | None = None) -> DataFrame:
    """Lines of every file under ``root`` whose name matches ``pattern``."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(root).select(
        paths.local_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def carry_forward(
    rows: DataFrame,
    values: dict[str, Column],
    by: tuple[str, ...] = ("file",),
    include_current: bool = True,
) -> DataFrame:
    """Add, for each name in ``values``, its latest non-NULL value at or before each row.

    The scan happens per block; one summary row per block then carries the
    last values of earlier blocks in. A file as large as a third of the input is
    so split over as many tasks as it has blocks. The summary is aggregated
    before it is shuffled, so it costs a second read of ``rows`` but next to no
    traffic; values that do not depend on each other should share one call.
    """
    keys = list(by)
    here = Window.partitionBy(*keys, "block").orderBy("pos")
    frame = here.rowsBetween(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    tagged = rows.withColumns({f"__v_{n}": v for n, v in values.items()})
    local = tagged.withColumns(
        {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(frame) for n in values}
    )

    ends = tagged.groupBy(*keys, "block").agg(
        *[
            F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col("pos"))).alias(f"__e_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "block",
        *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values],
    )
    return (
        local.join(carried, [*keys, "block"], "left")
        .withColumns({n: F.coalesce(f"__l_{n}", f"__c_{n}") for n in values})
        .drop(*[f"__{k}_{n}" for k in ("v", "l", "c") for n in values])
    )
