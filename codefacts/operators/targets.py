"""Build targets and their makeup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import common


def list_targets(facts: Facts) -> DataFrame:
    sources = facts.target_sources.groupBy(F.col("target").alias("name")).agg(
        F.count(F.lit(1)).alias("source_count")
    )
    linked = facts.link_resolutions.groupBy(F.col("target").alias("name")).agg(
        F.count(F.lit(1)).alias("linked_symbols")
    )
    return (
        facts.targets.select("name", "kind")
        .join(sources, "name", "left")
        .join(linked, "name", "left")
        .select(
            "name",
            "kind",
            F.coalesce("source_count", F.lit(0)).alias("source_count"),
            F.coalesce("linked_symbols", F.lit(0)).alias("linked_symbols"),
        )
    )


def describe_target(facts: Facts, name: str | Column) -> DataFrame:
    """Identity and exact counts of one target."""
    t = common.value(name)
    links = facts.by("link_resolutions", "target").filter(F.col("target") == t)
    linked = links.agg(F.count(F.lit(1))).scalar()
    reachable = (
        links.join(facts.symbols.select("usr"), "usr", "left_semi").agg(F.count(F.lit(1))).scalar()
    )
    return facts.targets.filter(F.col("name") == t).select(
        "name",
        "kind",
        "link_command",
        linked.alias("linked_symbols"),
        reachable.alias("reachable"),
    )


def target_source_files(facts: Facts, name: str | Column) -> DataFrame:
    files = facts.target_sources.filter(F.col("target") == common.value(name)).select("file")
    known = facts.sources.select(F.col("path").alias("file"), "blob_hash")
    return files.join(known, "file", "left").select(
        "file", F.coalesce("blob_hash", F.lit("")).alias("blob_hash")
    )


def target_archives(facts: Facts, name: str | Column) -> DataFrame:
    return (
        facts.by("link_resolutions", "target")
        .filter((F.col("target") == common.value(name)) & (F.col("archive") != ""))
        .select("archive")
        .distinct()
    )


def target_entry_points(facts: Facts, name: str | Column) -> DataFrame:
    """``main`` per defining file; files of the target's own list order first (``own``)."""
    mains = common.in_target(facts.by("symbols", "name").filter(F.col("name") == "main"), facts, name)
    at = facts.symbol_definitions.groupBy("usr", "file").agg(F.min("line").alias("line"))
    own = (
        facts.target_sources.filter(F.col("target") == common.value(name))
        .select("file")
        .distinct()
        .withColumn("own", F.lit(1))
    )
    return (
        mains.join(at, "usr", "left")
        .join(own, "file", "left")
        .select(
            "usr",
            "name",
            F.coalesce("signature", F.lit("")).alias("signature"),
            F.coalesce("file", F.lit("")).alias("file"),
            F.coalesce("line", F.lit(0)).alias("line"),
            F.coalesce("own", F.lit(0)).alias("own"),
            F.lit("main").alias("reason"),
        )
    )
