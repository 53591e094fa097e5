"""Build-level facts and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The oldest compiler accepted, and the kinds of finding.
OLDEST_COMPILER = 10
COMPILER_TOO_OLD = "gcc_too_old"
NO_TARGETS = "no_targets"
NO_DEBUG_INFO = "no_debug_info"
MISSING = {"ci": "missing_ci", "cgraph": "missing_cgraph", "opt_record": "missing_opt_record"}


def preflight(artifacts: DataFrame, compiler_version: Column | str, has_debug_info: DataFrame) -> DataFrame:
    """Findings about a build tree: ``(kind, n_missing, n_objects, sample)``.

    ``artifacts``: object plus one column per dump kind, NULL where missing.
    ``has_debug_info``: one row ``(object, has_debug)`` for the first object.
    """
    version = compiler_version if isinstance(compiler_version, Column) else F.lit(compiler_version)
    major = F.substring_index(version, ".", 1)
    too_old = ~major.rlike("^[0-9]+$") | (F.try_to_number(major, F.lit("9999")) < OLDEST_COMPILER)
    counts = artifacts.agg(
        F.count(F.lit(1)).alias("n_objects"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in MISSING],
        *[F.min(F.when(F.col(c).isNull(), F.col("object"))).alias(f"s_{c}") for c in MISSING],
    )
    debug = has_debug_info.agg(F.bool_and("has_debug").alias("debug"), F.min("object").alias("first"))

    def finding(kind: str, when: Column, n: Column, sample: Column) -> Column:
        row = F.struct(
            F.lit(kind).alias("kind"),
            n.cast("long").alias("n_missing"),
            F.col("n_objects"),
            F.coalesce(sample, F.lit("")).alias("sample"),
        )
        return F.when(F.coalesce(when, F.lit(True)), row)

    nothing = F.col("n_objects") == 0
    found = [
        finding(COMPILER_TOO_OLD, too_old, F.lit(0), version),
        finding(NO_TARGETS, nothing, F.lit(0), F.lit("")),
        *[
            finding(kind, ~nothing & (F.col(f"n_{c}") > 0), F.col(f"n_{c}"), F.col(f"s_{c}"))
            for c, kind in MISSING.items()
        ],
        finding(
            NO_DEBUG_INFO,
            ~nothing & ~F.coalesce(debug.select("debug").scalar(), F.lit(False)),
            F.lit(1),
            debug.select("first").scalar(),
        ),
    ]
    rows = counts.select(F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("f.*")


def filter_targets(targets: DataFrame, wanted: list[str]) -> DataFrame:
    """Keep named targets; names may be comma lists. An unknown name is an error."""
    names = sorted({n.strip() for item in wanted for n in item.split(",") if n.strip()})
    if not names:
        return targets
    kept = targets.filter(F.col("name").isin(names))
    # Bounded by the names given on the call.
    found = {r["name"] for r in kept.select("name").distinct().collect()}
    unknown = [n for n in names if n not in found]
    if unknown:
        known = [r["name"] for r in targets.select("name").orderBy("name").limit(50).collect()]
        raise ValueError(f"unknown target(s) {', '.join(unknown)}; known: {', '.join(known)}")
    return kept
