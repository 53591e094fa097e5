"""Inter-procedural symbol-table dumps.

A dump prints its symbol table several times, early and late. A symbol block
starts at a header in column 0 and ends at a blank line, a table title or any
other line in column 0. Blocks become rows by carrying their header forward,
and the several observations of one symbol fold by aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.sources.lines import carry_forward

# The dump's grammar.
NAME = r"[A-Za-z_][\w.$]*"
HEADER = rf"^({NAME})/(\d+)\s+\(([^)]*)\)\s*$"
REFERENCE = rf"({NAME})/(\d+)((?:(?!{NAME}/\d).)*)"
CLONE_OF = rf"^Clone of {NAME}/(\d+)$"
TABLE_TITLE = "Symbol table:"
NEEDED = "Trivially needed"
BLOCK_ENDS = ("Removing ", "Reclaiming ", "Clearing ")
# Lines of a block that say something kept; the rest is dropped where it is read.
KEPT = ("Type:", "Body removed", "Visibility:", "Address is taken.", "Clone of ", "Referring:", "Calls:")


def observations(lines: DataFrame, kept: tuple[str, ...] = KEPT) -> DataFrame:
    """Headers (empty ``text``) and attribute lines, each with the identity of the block it belongs to.

    Nodes and calls are both read off these rows: whoever needs both stores
    them, a fraction of the dump, rather than its lines.
    """
    # Each test is a column of its own so that it runs once per line.
    row, text = F.col("line"), F.col("text")
    says = F.lit(False)
    for label in kept:
        says = says | text.startswith(label)
    ends = text.startswith(NEEDED) | text.endswith(TABLE_TITLE) | (text == "") | ~row.startswith(" ")
    for label in BLOCK_ENDS:
        ends = ends | text.startswith(label)
    read = lines.withColumn("text", F.trim("line")).withColumn(
        "role",
        F.when(~row.startswith(" ") & row.rlike(HEADER), F.lit("start"))
        .when(ends, F.lit("end"))
        .when(says, F.lit("says")),
    )
    starts = F.col("role") == "start"
    header = F.struct(
        F.when(starts, F.regexp_extract(row, HEADER, 2)).alias("local_id"),
        F.when(starts, F.regexp_extract(row, HEADER, 1)).alias("name"),
        F.when(starts, F.regexp_extract(row, HEADER, 3)).alias("linkage_name"),
        F.struct("block", "pos").alias("at"),
    )
    # Only what is asked of a line later travels with it.
    relevant = read.filter(F.col("role").isNotNull()).withColumn("text", F.when(F.col("role") == "says", text).otherwise(""))
    marked = carry_forward(relevant, {"obs": F.when(F.col("role") != "says", header)})
    # After this only headers and attribute lines are left.
    return marked.filter(F.col("obs.local_id").isNotNull() & (F.col("role") != "end")).select(
        "file",
        F.col("obs.local_id").alias("local_id"),
        F.col("obs.name").alias("name"),
        F.col("obs.linkage_name").alias("linkage_name"),
        F.col("obs.at").alias("at"),
        "block",
        "pos",
        "text",
    )


def _after(text: Column, label: str) -> Column:
    return F.trim(F.substring(text, len(label) + 1, 1 << 30))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def nodes(lines: DataFrame) -> DataFrame:
    """The nodes of dumps given as lines, see :func:`nodes_of`."""
    return nodes_of(observations(lines, tuple(label for label in KEPT if label != "Calls:")))


def calls(lines: DataFrame) -> DataFrame:
    """The calls of dumps given as lines, see :func:`calls_of`."""
    return calls_of(observations(lines, ("Calls:",)))


def nodes_of(observed: DataFrame) -> DataFrame:
    """One row per dump and local id.

    Flags seen once stay; names, kind and clone parent keep the latest value;
    the visibility list is the longest one observed, the later on a tie, since
    late tables may be stripped.
    """
    text = F.col("text")
    kind_line = text.startswith("Type:")
    visibility = _words(_after(text, "Visibility:"))
    referring = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(3))
    by_address = F.exists(referring, lambda tail: tail.rlike(r"^[^(]*\(addr\)"))
    order = F.struct("block", "pos")

    def latest(condition: Column, value: Column) -> Column:
        return F.max(F.when(condition, F.struct(order.alias("at"), value.alias("v"))))["v"]

    def flag(condition: Column) -> Column:
        return F.bool_or(condition)

    longest = F.max(
        F.when(
            text.startswith("Visibility:") & (F.size(visibility) > 0),
            F.struct(F.size(visibility).alias("n"), order.alias("at"), visibility.alias("v")),
        )
    )["v"]
    folded = observed.groupBy("file", "local_id").agg(
        latest((text == "") & (F.col("name") != ""), F.col("name")).alias("name"),
        latest((text == "") & (F.col("linkage_name") != ""), F.col("linkage_name")).alias("linkage_name"),
        latest(kind_line & (F.size(_words(_after(text, "Type:"))) > 0),
               F.try_element_at(_words(_after(text, "Type:")), F.lit(1))).alias("kind"),
        flag(kind_line & text.contains("definition analyzed")).alias("analyzed"),
        flag(text.startswith("Body removed")).alias("body_removed"),
        longest.alias("visibility"),
        flag((text == "Address is taken.") | (text.startswith("Referring:") & by_address)).alias(
            "address_taken"
        ),
        latest(text.rlike(CLONE_OF), F.regexp_extract(text, CLONE_OF, 1)).alias("clone_of"),
    )
    return folded.select(
        "file",
        "local_id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("linkage_name", F.lit("")).alias("linkage_name"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        "analyzed",
        "body_removed",
        F.coalesce("visibility", F.array().cast("array<string>")).alias("visibility"),
        "address_taken",
        F.coalesce("clone_of", F.lit("")).alias("clone_of"),
    )


def calls_of(observed: DataFrame) -> DataFrame:
    """Outgoing calls per dump: those of the observation that lists most, the later on a tie."""
    rows = observed.filter(F.col("text").startswith("Calls:"))
    found = rows.select(
        "file",
        "local_id",
        "at",
        F.explode(
            F.arrays_zip(
                F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(2)).alias("callee_id"),
                F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(3)).alias("tail"),
            )
        ).alias("c"),
    ).select(
        "file",
        F.col("local_id").alias("caller_id"),
        "at",
        F.col("c.callee_id").alias("callee_id"),
        F.col("c.tail").contains("(inlined)").alias("inlined"),
    )
    counted = found.groupBy("file", "caller_id", "at").agg(F.count(F.lit(1)).alias("n"))
    richest = counted.groupBy("file", "caller_id").agg(F.max(F.struct("n", "at")).alias("best")).select(
        "file", "caller_id", F.col("best.at").alias("at")
    )
    return found.join(richest, ["file", "caller_id", "at"], "left_semi").drop("at")
