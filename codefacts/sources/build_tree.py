"""The build directory: objects, the dumps beside them and linker maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import paths

# Top-level directories that hold no translation units, and the
# file name form of each dump kind, relative to an object's base name.
SKIPPED_DIRS = ("meson-private", "meson-info", "meson-logs")
SIDECARS = {
    "ci": r"^\.ci$",
    "preprocessed": r"^\.i$",
    "opt_record": r"opt-record\.json\.gz$",
    "cgraph": r"^\..*i\.cgraph$",
    "inline": r"^\..*i\.inline$",
    "icf": r"^\..*i\.icf$",
}


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mtime, length)``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            paths.plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("mtime"), "length"
        )
    )


def _below(files: DataFrame, root: str) -> DataFrame:
    return files.withColumn("rel", paths.relative_to(F.col("path"), root))


def objects(files: DataFrame, root: str) -> DataFrame:
    """``(object, dir, base, mtime)`` of every object outside the skipped directories."""
    top = F.substring_index("rel", "/", 1)
    name = F.substring_index("rel", "/", -1)
    nested = F.col("rel").contains("/")
    return (
        _below(files, root)
        .filter(name.endswith(".o") & ~(nested & top.isin(*SKIPPED_DIRS)))
        .select(
            F.col("rel").alias("object"),
            paths.directory_of(F.col("rel")).alias("dir"),
            F.regexp_replace(name, r"\.o$", "").alias("base"),
            "mtime",
        )
    )


def artifacts(files: DataFrame, root: str) -> DataFrame:
    """One row per object with the path of each dump kind found beside it.

    A dump belongs to the object whose base name it starts with, so candidates
    join on directory and on the base name cut from the dump's own name.
    """
    found = objects(files, root)
    name = F.substring_index("rel", "/", -1)
    sidecars = _below(files, root).select(
        F.col("path").alias("sidecar"), paths.directory_of(F.col("rel")).alias("dir"), name.alias("file_name")
    )
    # Every dot-delimited prefix of a dump's name could be the base name.
    dumps = sidecars.filter(
        F.col("file_name").rlike(r"\.(ci|i|cgraph|inline|icf)$|opt-record\.json\.gz$")
    )
    parts = F.split("file_name", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
    stretched = dumps.select("sidecar", "dir", "file_name", F.explode(prefixes).alias("base"))
    rest = F.substring(F.col("file_name"), F.length("base") + 1, F.lit(1 << 20))
    kind = F.lit(None).cast("string")
    for label, form in SIDECARS.items():
        kind = F.coalesce(kind, F.when(rest.rlike(form), label))
    matched = (
        stretched.join(found.select("dir", "base"), ["dir", "base"])
        .withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
    )
    per_kind = matched.groupBy("dir", "base").agg(
        *[F.min(F.when(F.col("kind") == label, F.col("sidecar"))).alias(label) for label in SIDECARS]
    )
    return found.join(per_kind, ["dir", "base"], "left").drop("dir", "base")


def linker_maps(files: DataFrame, root: str) -> DataFrame:
    """``(target, path)`` of top-level maps; the file name is the target's."""
    rel = F.col("rel")
    return (
        _below(files, root)
        .filter(rel.endswith(".map") & ~rel.contains("/"))
        .select(F.regexp_replace(rel, r"\.map$", "").alias("target"), "path")
    )
