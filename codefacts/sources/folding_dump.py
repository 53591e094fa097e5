"""Identical-code folding dumps: surviving function and functions folded into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.sources.lines import carry_forward

# The dump's grammar.
INTRODUCED = r"Introduced new external node \(([A-Za-z_][\w.$]*)\.localalias/\d+\)"
ANALYZING = r"^Analyzing function:\s+([A-Za-z_][\w.$]*)/\d+"
ALIAS_CALL = r"\b([A-Za-z_][\w.$]*)\.localalias\s*\("


def members(lines: DataFrame) -> DataFrame:
    """``(file, winner, loser)``, distinct.

    A winner must be announced; a loser is the function being analysed when a
    call to the winner's local alias shows up. Either alone says nothing.
    """
    row = F.col("line")
    announces, analyses = row.rlike(INTRODUCED), row.rlike(ANALYZING)
    # Lines without either signal never matter: drop them before any shuffle.
    signal = lines.filter(announces | analyses | row.rlike(ALIAS_CALL))
    winners = (
        signal.filter(announces)
        .select("file", F.regexp_extract(row, INTRODUCED, 1).alias("winner"))
        .distinct()
    )
    current = F.when(analyses & ~announces, F.regexp_extract(row, ANALYZING, 1))
    calls = (
        carry_forward(signal, {"loser": current})
        .filter(~announces & ~analyses & F.col("loser").isNotNull())
        .select(
            "file", "loser", F.explode(F.regexp_extract_all(row, F.lit(ALIAS_CALL), F.lit(1))).alias("winner")
        )
        .filter(F.col("loser") != F.col("winner"))
        .distinct()
    )
    return calls.join(winners, ["file", "winner"], "left_semi").select("file", "winner", "loser")
