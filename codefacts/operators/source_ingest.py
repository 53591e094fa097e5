"""Which files belong in the index, and their content-addressed storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions import paths


def dedup_blobs(contents: DataFrame) -> DataFrame:
    """``(hash, size, content)``, one row per distinct content.

    Copies collapse map-side before the shuffle, so a content that makes up a
    third of all files costs one row per input partition.
    """
    hashed = contents.select(
        F.sha2(F.col("content"), 256).alias("hash"),
        F.octet_length("content").cast("long").alias("size"),
        "content",
    )
    return hashed.dropDuplicates(["hash"])


def pack_sources(
    declared: DataFrame,
    dependencies: DataFrame,
    build_dir: str,
    project_root: str,
    external_patterns: tuple[str, ...] = (),
) -> DataFrame:
    """Classify every file the build touched.

    ``declared``: path, generated (from the build description).
    ``dependencies``: object, path (from the dependency log).
    Gives ``bucket, key, is_generated, required`` with bucket ``project``,
    ``generated``, ``external`` or ``outside``; flags once set stay set.
    """
    spot = paths.resolve(F.col("path"), build_dir, project_root)
    full = paths.absolute(F.col("path"), build_dir)
    in_build = paths.is_under(full, build_dir)
    external = reduce(
        lambda a, b: a | b, [paths.glob_condition(full, p) for p in external_patterns], F.lit(False)
    )
    named = declared.select("path", F.col("generated").alias("is_generated"), F.lit(True).alias("required"))
    seen = dependencies.select(
        "path", F.lit(False).alias("is_generated"), F.lit(False).alias("required")
    ).distinct()
    rows = named.unionByName(seen).select(
        F.when(spot["in_project"], "project")
        .when(in_build & (F.col("is_generated") | ~F.col("required")), "generated")
        .when(~F.col("required") & external, "external")
        .otherwise("outside")
        .alias("bucket"),
        F.when(spot["in_project"], spot["rel"])
        .when(in_build, paths.relative_to(full, build_dir))
        .otherwise(full)
        .alias("key"),
        (F.col("is_generated") | (spot["in_project"] & in_build & ~F.col("required"))).alias("is_generated"),
        "required",
    )
    return rows.groupBy("bucket", "key").agg(
        F.bool_or("is_generated").alias("is_generated"), F.bool_or("required").alias("required")
    )


def misplaced_sources(packed: DataFrame) -> DataFrame:
    """Files the build description requires that lie outside every known root."""
    return packed.filter((F.col("bucket") == "outside") & F.col("required")).select("key")


def unmatched_patterns(dependencies: DataFrame, build_dir: str, patterns: tuple[str, ...]) -> list[str]:
    """Include patterns no dependency matches; they are reported as an error."""
    if not patterns:
        return []
    full = paths.absolute(F.col("path"), build_dir)
    hits = dependencies.select(
        *[F.bool_or(paths.glob_condition(full, p)).alias(f"p{i}") for i, p in enumerate(patterns)]
    ).first()
    return [p for i, p in enumerate(patterns) if not hits[f"p{i}"]]


def newer_than_consumers(consumers: DataFrame, source_times: DataFrame, object_times: DataFrame) -> DataFrame:
    """Sources modified after an object built from them.

    ``consumers``: path, object. ``source_times``: path, mtime.
    ``object_times``: object, mtime. An object that is gone is not held
    against its sources.
    """
    built = object_times.select("object", F.col("mtime").alias("object_mtime"))
    oldest = (
        consumers.distinct()
        .join(built, "object")
        .groupBy("path")
        .agg(F.min(F.struct("object_mtime", "object")).alias("oldest"))
    )
    return (
        source_times.select("path", F.col("mtime").alias("source_mtime"))
        .join(oldest, "path")
        .filter(F.col("source_mtime") > F.col("oldest.object_mtime"))
        .select("path", "source_mtime", "oldest.object", "oldest.object_mtime")
    )
