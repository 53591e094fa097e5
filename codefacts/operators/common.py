"""Pieces shared by the query operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import text_index

CGRAPH = "compiler_cgraph"
OBJDUMP = "objdump"
LINKED_KINDS = ("executable", "shared_library")

# Fixed value: the number of context lines on each side in a location snippet.
SNIPPET_CONTEXT = 5
# The usual page of each query that can be paged. No query is cut unless a page is asked for,
# except call paths, whose number grows exponentially.
PAGE = {
    "find_symbol": 100,
    "callers": 500,
    "call_paths": 50,
    "inline_rows": 50,
    "find_type": 100,
    "linkage_rows": 500,
    "indirect_sites": 500,
    "search_source": 200,
    "search_top": 200,
    "sql_rows": 500,
}


def value(x: Column | str | int) -> Column:
    """A query parameter: a literal, or a scalar subquery column."""
    return x if isinstance(x, Column) else F.lit(x)


def page_size(limit: int | None) -> int | None:
    """A page as asked for; none means all rows."""
    if limit is not None and limit < 1:
        raise ValueError(f"a page has at least one row, not {limit}")
    return limit


def symbol_ref(facts: Facts) -> DataFrame:
    return facts.symbols.select(
        "usr", "name", "kind", F.coalesce("signature", F.lit("")).alias("signature")
    )


def in_target(df: DataFrame, facts: Facts, target: Column | str, usr: str = "usr") -> DataFrame:
    """Rows whose symbol the link kept in ``target``."""
    kept = (
        facts.by("link_resolutions", "target")
        .filter(F.col("target") == value(target))
        .select(F.col("usr").alias(usr))
        .distinct()
    )
    return df.join(kept, usr, "left_semi")


def targets_of(facts: Facts, hits: DataFrame, usr: str = "usr") -> DataFrame:
    """``(usr, target)`` rows for the symbols in ``hits``, one per link row."""
    wanted = hits.select(F.col(usr).alias("usr")).distinct()
    return facts.link_resolutions.select("usr", "target").join(wanted, "usr", "left_semi")


def with_location(
    df: DataFrame,
    facts: Facts,
    snippets: bool,
    context: int = SNIPPET_CONTEXT,
    project_root: str = "",
) -> DataFrame:
    """Attach blob hash, absolute path and, if asked, a line window to ``file``/``line`` rows."""
    by_path = facts.sources.select(F.col("path").alias("file"), "blob_hash")
    out = df.join(by_path, "file", "left")
    if project_root:
        root = project_root.rstrip("/") + "/"
        out = out.withColumn(
            "absolute_path",
            F.when(F.col("file").startswith("/"), F.col("file")).otherwise(
                F.concat(F.lit(root), F.col("file"))
            ),
        )
    return text_index.with_windows(facts, out, context) if snippets else out
