"""Linker maps: which object supplied each symbol, which members an archive gave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.session import cut_lineage
from codefacts.sources.lines import carry_forward

# The map's grammar.
LOAD_LIST = "Archive member included"
LOAD_LIST_ENDS = (
    "Merging program properties",
    "Discarded input sections",
    "As-needed library",
    "Memory Configuration",
)
CONTRIBUTION = r"^\s+\.[\w.]+\s+0x[0-9a-fA-F]+\s+0x[0-9a-fA-F]+\s+(\S+\.o)$"
SECTION_ALONE = r"^\s+\.[\w.]+\s*$"
REST_OF_SPLIT = r"^\s+0x[0-9a-fA-F]+\s+0x[0-9a-fA-F]+\s+(\S+\.o)$"
SYMBOL = r"^\s+0x[0-9a-fA-F]+\s+([A-Za-z_][\w.$@]*)$"
LOADED = r"^(\S+\.o)$"
LOADED_FOR = r"^\s+(\S+\.o)\s+\(([^)]+)\)$"


def _phases(lines: DataFrame) -> DataFrame:
    """Lines with ``phase`` 1 inside the load list and 2 in the section listing."""
    text = F.trim("line")
    opens = text.startswith(LOAD_LIST)
    ends = F.lit(False)
    for words in LOAD_LIST_ENDS:
        ends = ends | text.startswith(words)
    # A handful of lines per map decide the phases; find them in one read.
    marks = cut_lineage(
        lines.filter(opens | ends).select(
            "file", F.struct("block", "pos").alias("at"), opens.alias("opens"), ends.alias("ends")
        )
    )
    opened = marks.filter("opens").groupBy("file").agg(F.min("at").alias("opened"))
    closed = (
        marks.filter("ends")
        .join(opened, "file")
        .filter(F.col("at") > F.col("opened"))
        .groupBy("file")
        .agg(F.min("at").alias("closed"))
    )
    bounds = opened.join(closed, "file", "left")
    here = F.struct("block", "pos")
    phase = F.when(F.col("closed").isNull() | (here < F.col("closed")), 1).when(here > F.col("closed"), 2)
    return (
        lines.join(bounds, "file")
        .filter(here > F.col("opened"))
        .withColumn("phase", phase)
        .drop("opened", "closed")
    )


def origins(lines: DataFrame) -> DataFrame:
    """``(file, name, object)``: the first contribution that lists a symbol wins."""
    row = F.col("line")
    body = _phases(lines).filter(F.col("phase") == 2).drop("phase")
    # Long section names push address, size and object to the next line. What
    # a line means depends on the line before it and what scope it is in on all
    # lines before it, so the first answer is stored before the second is asked.
    body = cut_lineage(
        carry_forward(body, {"after_section": row.rlike(SECTION_ALONE)}, include_current=False)
    )
    completes = F.coalesce("after_section", F.lit(False)) & row.rlike(REST_OF_SPLIT)
    contributes = row.rlike(CONTRIBUTION)
    alone = row.rlike(SECTION_ALONE)
    names = row.rlike(SYMBOL)
    scope = (
        F.when(completes, F.regexp_extract(row, REST_OF_SPLIT, 1))
        .when(contributes, F.regexp_extract(row, CONTRIBUTION, 1))
        .when(~alone & ~names & ~row.startswith("  "), F.lit(""))
    )
    return (
        carry_forward(body, {"object": scope})
        .filter(names & (F.col("object") != ""))
        .select("file", "block", "pos", F.regexp_extract(row, SYMBOL, 1).alias("name"), "object")
        .groupBy("file", "name")
        .agg(F.min_by("object", F.struct("block", "pos")).alias("object"))
    )


def archive_pulls(lines: DataFrame) -> DataFrame:
    """``(file, object, referrer, symbol)`` of the load list."""
    row, text = F.col("line"), F.trim("line")
    body = _phases(lines).filter(F.col("phase") == 1)
    loaded, because = text.rlike(LOADED), row.rlike(LOADED_FOR)
    event = F.when(loaded, F.regexp_extract(text, LOADED, 1)).when(because, F.lit(""))
    return (
        carry_forward(body.filter(loaded | because), {"object": event}, include_current=False)
        .filter(because & ~loaded & (F.col("object") != ""))
        .select(
            "file",
            "object",
            F.regexp_extract(row, LOADED_FOR, 1).alias("referrer"),
            F.regexp_extract(row, LOADED_FOR, 2).alias("symbol"),
        )
    )
