"""Portable-format symbol listings of objects and binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators import link_ingest


def symbols(lines: DataFrame) -> DataFrame:
    """``name kind [address [size]]`` lines; fewer than two fields say nothing."""
    fields = F.split(F.trim("line"), r"\s+")

    def field(i: int):
        return F.coalesce(F.get(fields, F.lit(i)), F.lit(""))

    size = F.when(field(3).rlike("^[0-9a-fA-F]{1,15}$"), F.conv(field(3), 16, 10).cast("long"))
    return lines.filter(F.size(fields) >= 2).select(
        "file",
        "block",
        "pos",
        field(0).alias("name"),
        field(1).alias("nm_kind"),
        field(2).alias("address"),
        F.coalesce(size, F.lit(0)).alias("size"),
        link_ingest.linkage_kind(field(1)).alias("linkage_kind"),
        link_ingest.is_local(field(1)).alias("is_local"),
        field(1).isin(*link_ingest.FUNCTION_KINDS).alias("is_function"),
    )


def object_defs(listing: DataFrame) -> DataFrame:
    """``(name, object, nm_kind)`` of everything the objects define."""
    return listing.filter((F.col("name") != "") & (F.col("nm_kind") != "")).select(
        "name", F.col("file").alias("object"), "nm_kind"
    )
