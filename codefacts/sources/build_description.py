"""The build system's introspection files: targets, their sources and the compiler."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INFO_DIR = "meson-info"
TARGETS_SCHEMA = (
    "name string, id string, type string, defined_in string, filename array<string>, "
    "installed boolean, subproject string, target_sources array<struct<language:string,"
    "compiler:array<string>,linker:array<string>,parameters:array<string>,sources:array<string>,"
    "generated_sources:array<string>>>"
)
COMPILERS_SCHEMA = (
    "host struct<c:struct<id:string,version:string,full_version:string,exelist:array<string>,"
    "linker_id:string>>"
)
INFO_SCHEMA = (
    "meson_version struct<full:string>, directories struct<source:string,build:string>"
)
DEPENDENCIES_SCHEMA = "name string, version string, type string"


def read(spark: SparkSession, build_dir: str, name: str, schema: str) -> DataFrame:
    path = f"{build_dir.rstrip('/')}/{INFO_DIR}/{name}.json"
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def targets(raw: DataFrame) -> DataFrame:
    """``(name, kind, link_command, filenames)``; kinds use underscores."""
    kind = (
        F.when(F.col("type") == "static library", "static_library")
        .when(F.col("type") == "shared library", "shared_library")
        .otherwise(F.col("type"))
    )
    linked = F.filter("target_sources", lambda g: F.coalesce(F.size(g["linker"]), F.lit(0)) > 0)
    group = F.try_element_at(linked, F.lit(1))
    command = F.concat(
        group["linker"], F.coalesce(group["parameters"], F.array().cast("array<string>"))
    )
    return raw.select(
        "name",
        kind.alias("kind"),
        F.coalesce(F.array_join(command, " "), F.lit("")).alias("link_command"),
        F.col("filename").alias("filenames"),
    )


def target_files(raw: DataFrame) -> DataFrame:
    """``(target, path, generated)`` of the C source groups, repeats kept."""
    groups = raw.select(F.col("name").alias("target"), F.explode("target_sources").alias("g")).filter(
        F.col("g.language") == "c"
    )
    written = groups.select("target", F.explode("g.sources").alias("path"), F.lit(False).alias("generated"))
    made = groups.select(
        "target", F.explode("g.generated_sources").alias("path"), F.lit(True).alias("generated")
    )
    return written.unionByName(made)


def compiler(raw: DataFrame) -> DataFrame:
    return raw.select("host.c.*")
