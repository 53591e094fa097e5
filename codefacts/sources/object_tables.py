"""Line tables, relocations and function symbols of objects, from text dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.sources.lines import carry_forward

# The dumps' grammars.
DIRECTORY = r'^include_directories\[\s*(\d+)\] = "(.*)"$'
FILE_HEAD = r"^file_names\[\s*(\d+)\]:$"
FILE_NAME = r'^\s+name: "(.*)"$'
FILE_DIR = r"^\s+dir_index: (\d+)$"
LINE_ROW = r"^0x([0-9a-f]{8,16})\s+(\d+)\s+(\d+)\s+(\d+)\s"
RELOCATION_SECTION = r"^RELOCATION RECORDS FOR \[(.+)\]:$"
RELOCATION = r"^([0-9a-fA-F]{8,16}) (\S+)\s+(\S+?)(?:([+-])0x([0-9a-fA-F]+))?$"
FUNCTION_SYMBOL = r"^([0-9a-fA-F]{8,16}) .{6}F (\S+)\s+([0-9a-fA-F]{8,16})\s+(?:\.\w+ )?(\S+)$"


def _hex(text):
    return F.conv(text, 16, 10).try_cast("long")


def line_rows(lines: DataFrame) -> DataFrame:
    """``(file, address, line, column, source)`` of a decoded line table."""
    row = F.col("line")
    relevant = lines.filter(
        row.rlike(DIRECTORY) | row.rlike(FILE_HEAD) | row.rlike(FILE_NAME) | row.rlike(FILE_DIR) | row.rlike(LINE_ROW)
    )
    number = F.when(row.rlike(FILE_HEAD), F.regexp_extract(row, FILE_HEAD, 1).try_cast("int"))
    headed = carry_forward(relevant, {"file_index": number})
    directories = relevant.filter(row.rlike(DIRECTORY)).groupBy(
        "file", F.regexp_extract(row, DIRECTORY, 1).try_cast("int").alias("dir_index")
    ).agg(F.max(F.regexp_extract(row, DIRECTORY, 2)).alias("directory"))
    names = (
        headed.filter(F.col("file_index").isNotNull() & (row.rlike(FILE_NAME) | row.rlike(FILE_DIR)))
        .groupBy("file", "file_index")
        .agg(
            F.max(F.when(row.rlike(FILE_NAME), F.regexp_extract(row, FILE_NAME, 1))).alias("name"),
            F.max(F.when(row.rlike(FILE_DIR), F.regexp_extract(row, FILE_DIR, 1).try_cast("int"))).alias("dir_index"),
        )
        .join(directories, ["file", "dir_index"], "left")
        .select(
            "file",
            "file_index",
            F.when(F.col("name").startswith("/") | F.col("directory").isNull(), F.col("name"))
            .otherwise(F.concat_ws("/", "directory", "name"))
            .alias("source"),
        )
    )
    rows = relevant.filter(row.rlike(LINE_ROW)).select(
        "file",
        "block",
        "pos",
        _hex(F.regexp_extract(row, LINE_ROW, 1)).alias("address"),
        F.regexp_extract(row, LINE_ROW, 2).try_cast("int").alias("line"),
        F.regexp_extract(row, LINE_ROW, 3).try_cast("int").alias("column"),
        F.regexp_extract(row, LINE_ROW, 4).try_cast("int").alias("file_index"),
    )
    # Of several rows at one address the last is in force.
    last = F.max_by(F.struct("line", "column", "file_index"), F.struct("block", "pos")).alias("r")
    return (
        rows.groupBy("file", "address").agg(last).select("file", "address", "r.*")
        .join(names, ["file", "file_index"], "left")
        .select("file", "address", "line", "column", F.coalesce("source", F.lit("")).alias("source"))
    )


def relocations(lines: DataFrame) -> DataFrame:
    """``(file, section, address, symbol, addend)``."""
    row = F.col("line")
    relevant = lines.filter(row.rlike(RELOCATION_SECTION) | row.rlike(RELOCATION))
    section = F.when(row.rlike(RELOCATION_SECTION), F.regexp_extract(row, RELOCATION_SECTION, 1))
    amount = F.coalesce(_hex(F.nullif(F.regexp_extract(row, RELOCATION, 5), F.lit(""))), F.lit(0))
    return (
        carry_forward(relevant, {"section": section})
        .filter(row.rlike(RELOCATION) & F.col("section").isNotNull())
        .select(
            "file",
            "section",
            _hex(F.regexp_extract(row, RELOCATION, 1)).alias("address"),
            F.regexp_extract(row, RELOCATION, 3).alias("symbol"),
            F.when(F.regexp_extract(row, RELOCATION, 4) == "-", -amount).otherwise(amount).alias("addend"),
        )
    )


def function_symbols(lines: DataFrame) -> DataFrame:
    """``(file, name, section, value, size)`` of function entries in a symbol table."""
    row = F.col("line")
    return lines.filter(row.rlike(FUNCTION_SYMBOL)).select(
        "file",
        F.regexp_extract(row, FUNCTION_SYMBOL, 4).alias("name"),
        F.regexp_extract(row, FUNCTION_SYMBOL, 2).alias("section"),
        _hex(F.regexp_extract(row, FUNCTION_SYMBOL, 1)).alias("value"),
        _hex(F.regexp_extract(row, FUNCTION_SYMBOL, 3)).alias("size"),
    )
