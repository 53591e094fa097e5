"""Call-graph information dumps: one graph, its nodes and edges per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The quoted-field form of the grammar, a source position, the
# frame-size and dynamic-object notes, and the node standing for indirect calls.
FIELD = r'\b{name}\s*:\s*"((?:[^"\\]|\\.)*)"'
POSITION = r"^(.*?):(\d+):(\d+)$"
STACK = r"^(\d+)\s+bytes\s+\((\w+)\)$"
DYNAMIC = r"^(\d+)\s+dynamic\s+objects?$"
INDIRECT = "__indirect_call"


def _field(line: Column, name: str) -> Column:
    raw = F.regexp_extract(line, FIELD.format(name=name), 1)
    return F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))


def _first(notes: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(notes, lambda n: n.rlike(pattern)), F.lit(1))


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.coalesce(F.regexp_extract(text, pattern, index), F.lit(""))


def _number(text: Column, pattern: str, index: int) -> Column:
    """Captured digits as an int, zero when the pattern does not match."""
    return F.coalesce(F.nullif(_group(text, pattern, index), F.lit("")).cast("int"), F.lit(0))


def titles(lines: DataFrame) -> DataFrame:
    """``(file, title)``: the source path each dump was compiled from."""
    row = F.trim("line")
    return (
        lines.filter(row.startswith("graph:"))
        .select("file", "block", "pos", _field(row, "title").alias("title"))
        .filter(F.col("title") != "")
        .groupBy("file")
        .agg(F.max_by("title", F.struct("block", "pos")).alias("title"))
    )


def nodes(lines: DataFrame) -> DataFrame:
    """Functions and external references, the last mention of a name per dump."""
    row = F.trim("line")
    found = lines.filter(row.startswith("node:")).select(
        "file",
        "block",
        "pos",
        _field(row, "title").alias("name"),
        (row.contains("shape") & row.contains("ellipse")).alias("is_external"),
        F.transform(
            F.slice(F.split(_field(row, "label"), "\n"), 2, 1 << 20), lambda n: F.trim(n)
        ).alias("notes"),
    )
    at, stack, dynamic = (_first(F.col("notes"), p) for p in (POSITION, STACK, DYNAMIC))
    parsed = found.select(
        "file",
        "block",
        "pos",
        "name",
        _group(at, POSITION, 1).alias("decl_file"),
        _number(at, POSITION, 2).alias("decl_line"),
        _number(at, POSITION, 3).alias("decl_column"),
        _number(stack, STACK, 1).alias("stack_bytes"),
        _group(stack, STACK, 2).alias("stack_kind"),
        _number(dynamic, DYNAMIC, 1).alias("dynamic_objects"),
        "is_external",
        (F.col("name") == INDIRECT).alias("is_indirect"),
    )
    keep = [c for c in parsed.columns if c not in ("file", "name", "block", "pos")]
    last = F.max_by(F.struct(*keep), F.struct("block", "pos"))
    return parsed.groupBy("file", "name").agg(last.alias("n")).select("file", "name", "n.*")


def edges(lines: DataFrame) -> DataFrame:
    row = F.trim("line")
    label = _field(row, "label")
    return lines.filter(row.startswith("edge:")).select(
        "file",
        _field(row, "sourcename").alias("caller"),
        _field(row, "targetname").alias("callee"),
        _group(label, POSITION, 1).alias("site_file"),
        _number(label, POSITION, 2).alias("site_line"),
        _number(label, POSITION, 3).alias("site_column"),
        (_field(row, "targetname") == INDIRECT).alias("is_indirect"),
    )
