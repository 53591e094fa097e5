"""Dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.session import cut_lineage


def assign_ids(df: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """Number rows 1..n in the order of ``order``.

    Rows are range-partitioned and sorted in parallel and written once, so that
    both passes below see the same partitions. Each partition's row count is
    then turned into an offset; only that list, one row per partition, goes
    through an unpartitioned window and to every task.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = ranged.select(
        "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__seq")
    )
    sizes = tagged.groupBy("__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    # One row per partition: bounded by the partition count, never by the data.
    numbered = tagged.join(F.broadcast(offsets), "__part")
    return numbered.select(
        (F.col("__offset") + F.col("__seq") - F.col("__first") + 1).alias(id_col), *df.columns
    )
