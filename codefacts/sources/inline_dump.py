"""Inliner summary dumps: which callees a function took in, by the last summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.sources.lines import carry_forward

# The dump's grammar.
SUMMARY = r"^IPA function summary for ([A-Za-z_][\w.$]*)/(\d+)\s+(not inlinable|inlinable)"
CALL = (
    r"^\s+([A-Za-z_][\w.$]*)/(\d+)\s+"
    r"(inlined|function body not available|function not considered for inlining)"
)


def _starts() -> Column:
    return F.col("line").rlike(SUMMARY)


def _headers(lines: DataFrame) -> DataFrame:
    """``(file, local_id, name, inlinable, at)`` of every summary."""
    row = F.col("line")
    return lines.filter(_starts()).select(
        "file",
        F.regexp_extract(row, SUMMARY, 2).alias("local_id"),
        F.regexp_extract(row, SUMMARY, 1).alias("name"),
        (F.regexp_extract(row, SUMMARY, 3) == "inlinable").alias("inlinable"),
        F.struct("block", "pos").alias("at"),
    )


def summaries(lines: DataFrame) -> DataFrame:
    """``(file, local_id, name, inlinable)`` of the last summary per function."""
    last = F.max(F.struct("at", "name", "inlinable")).alias("s")
    return _headers(lines).groupBy("file", "local_id").agg(last).select("file", "local_id", "s.name", "s.inlinable")


def inlined_callees(lines: DataFrame) -> DataFrame:
    """``(file, local_id, callee_id)`` of calls the last summary marks inlined.

    Of the lines only inlined calls and those that open or close a summary or
    its list of calls are looked at, and of these no text is kept.
    """
    row, starts = F.col("line"), _starts()
    ends = ~starts & (row != "") & ~row.startswith(" ")
    header = F.struct(
        F.when(starts, F.regexp_extract(row, SUMMARY, 2)).alias("local_id"), F.struct("block", "pos").alias("at")
    )
    section = (
        F.when(F.trim("line") == "calls:", F.lit(True))
        .when(starts | ends | (F.trim("line") == ""), F.lit(False))
    )
    read = lines.select(
        "file", "block", "pos",
        F.when(starts | ends, header).alias("header"),
        section.alias("section"),
        F.when(F.regexp_extract(row, CALL, 3) == "inlined", F.regexp_extract(row, CALL, 2)).alias("callee_id"),
    )
    said = F.col("header").isNotNull() | F.col("section").isNotNull() | F.col("callee_id").isNotNull()
    marked = carry_forward(read.filter(said), {"obs": F.col("header"), "in_calls": F.col("section")})
    entries = marked.filter(
        F.col("obs.local_id").isNotNull() & F.col("in_calls") & F.col("callee_id").isNotNull()
    ).select("file", F.col("obs.local_id").alias("local_id"), F.col("obs.at").alias("at"), "callee_id")
    last = _headers(lines).groupBy("file", "local_id").agg(F.max("at").alias("at"))
    return entries.join(last, ["file", "local_id", "at"], "left_semi").drop("at")
