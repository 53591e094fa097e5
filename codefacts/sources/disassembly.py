"""Disassembly listings: direct calls and jumps with the function they sit in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.sources.lines import carry_forward

# A function label and a direct branch; an indirect operand
# starts with '*' and so never matches.
LABEL = r"^([0-9a-fA-F]+)\s+<([^>]+)>:$"
BRANCH = r"^\s+[0-9a-fA-F]+:\s+(?:call|jmp)\s+([0-9a-fA-F]+)\s+<([^>]+)>"


def direct_calls(lines: DataFrame) -> DataFrame:
    """``(file, caller, caller_address, callee, callee_address)``, one row per instruction.

    Only labels and branches leave the scan; the rest of a listing, nearly all
    of it, is filtered before anything is shuffled.
    """
    row = F.col("line")
    is_label = row.rlike(LABEL)
    relevant = lines.filter(is_label | row.rlike(BRANCH))
    label = F.when(
        is_label,
        F.struct(
            F.regexp_extract(row, LABEL, 2).alias("name"), F.regexp_extract(row, LABEL, 1).alias("address")
        ),
    )
    return (
        carry_forward(relevant, {"function": label})
        .filter(~is_label & F.col("function").isNotNull())
        .select(
            "file",
            F.col("function.name").alias("caller"),
            F.col("function.address").alias("caller_address"),
            F.regexp_extract(row, BRANCH, 2).alias("callee"),
            F.regexp_extract(row, BRANCH, 1).alias("callee_address"),
        )
    )
