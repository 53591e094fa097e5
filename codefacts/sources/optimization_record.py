"""Optimisation records: compressed JSON of every decision a pass logged."""

from __future__ import annotations

import json
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.functions import paths

# The format understood, the option group that marks inliner
# passes, and the outcomes that are decisions.
FORMAT = "1"
INLINE_GROUP = "inline"
SUCCESS, FAILURE = "success", "failure"
RECORD = (
    "array<struct<kind:string,pass:string,message:array<variant>,"
    "location:struct<file:string,line:int,column:int>>>"
)
NODE = r"^(.+)/([^/]+)$"


def read_documents(spark: SparkSession, root: str, pattern: str = "*opt-record.json.gz") -> DataFrame:
    """``(file, document)``; a record file is one translation unit's, so one row each."""
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", pattern).text(root).select(
        paths.local_path(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("document")
    )


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def inline_passes(trees: pd.Series) -> pd.Series:
    """Pass id to pass name for the passes of the inline group, at any depth."""

    # Documents of one compiler run share their tree of passes.
    @lru_cache(maxsize=256)
    def walk(tree: str | None) -> dict[str, str]:
        found, todo = {}, list(json.loads(tree or "[]"))
        while todo:
            node = todo.pop()
            if INLINE_GROUP in (node.get("optgroups") or []):
                found[node.get("id", "")] = node.get("name", "")
            todo.extend(node.get("children") or [])
        return found

    return pd.Series([walk(tree) for tree in trees], index=trees.index, dtype=object)


def _text(item: Column) -> Column:
    is_text = F.schema_of_variant(item) == "STRING"
    return F.when(is_text, F.try_variant_get(item, "$", "string")).otherwise(F.lit(""))


def _node(item: Column) -> Column:
    return F.nullif(F.try_variant_get(item, "$.symtab_node", "string"), F.lit(""))


def _once(value: Column) -> Column:
    """The value as one generated row: what is read off it later does not compute it again."""
    return F.explode(F.array(value))


def _reason(tail: Column) -> Column:
    first = F.trim(F.substring_index(tail, "\n", 1))
    no_comma = F.trim(F.regexp_replace(first, "^,", ""))
    return F.trim(F.regexp_replace(no_comma, r"\.$", ""))


def records(documents: DataFrame) -> DataFrame:
    """Inlining decisions with caller and callee told apart by the message's wording.

    ``a -> b`` names the caller first, ``a into b`` and ``a to b`` the callee;
    a message with fewer than two nodes or other wording is no decision.
    """
    read = documents.select("file", _once(F.from_json("document", "array<string>")).alias("top"))
    top = F.col("top")
    version = F.get_json_object(top[0], "$.format")
    checked = F.when(
        version.eqNullSafe(F.lit(FORMAT)), top[2]
    ).otherwise(F.raise_error(F.concat(F.lit("unsupported optimization-record format "),
                                       F.coalesce(version, F.lit("?")))).cast("string"))
    # The tree of passes is read once a document, not once a record.
    rows = read.select("file", "top", _once(inline_passes(top[1])).alias("passes")).select(
        "file", "passes", F.explode(F.from_json(checked, RECORD)).alias("r")
    ).filter(F.col("r.kind").isin(SUCCESS, FAILURE))
    nodes = F.transform("r.message", _node)
    named = rows.select(
        "file",
        F.col("passes")[F.col("r.pass")].alias("pass"),
        (F.col("r.kind") == SUCCESS).alias("inlined"),
        _once(F.struct(F.transform("r.message", _text).alias("texts"), nodes.alias("nodes"))).alias("said"),
        "r.location",
    ).filter(F.col("pass").isNotNull()).select("file", "pass", "inlined", "location", "said.*")

    spots = F.filter(
        F.sequence(F.lit(1), F.size("nodes")), lambda i: F.try_element_at("nodes", i).isNotNull()
    )
    two = named.filter(F.size(F.col("nodes")) > 0).select("*", _once(spots).alias("spots")).filter(F.size("spots") >= 2)
    a, b, last = (F.try_element_at("spots", F.lit(i)) for i in (1, 2, -1))
    # The two nodes a decision names, the words between them and those after the last node.
    between = F.array_join(F.slice("texts", a + 1, b - a - 1), "")
    after = F.array_join(F.slice("texts", last + 1, F.size("texts") - last), "")
    parts = F.struct(
        F.try_element_at("nodes", a).alias("first"), F.try_element_at("nodes", b).alias("second"),
        between.alias("between"), after.alias("tail"),
    )
    between = F.col("parts.between")
    split = two.select("file", "pass", "inlined", "location", _once(parts).alias("parts")).select(
        "file",
        "pass",
        "inlined",
        "location",
        "parts.first",
        "parts.second",
        F.when(between.contains("->"), "caller_first")
        .when(between.contains(" into ") | between.contains(" to "), "callee_first")
        .alias("order"),
        "parts.tail",
    ).filter(F.col("order").isNotNull() & F.col("first").rlike(NODE) & F.col("second").rlike(NODE))
    caller = F.when(F.col("order") == "caller_first", F.col("first")).otherwise(F.col("second"))
    callee = F.when(F.col("order") == "caller_first", F.col("second")).otherwise(F.col("first"))
    return split.select(
        "file",
        "pass",
        F.regexp_extract(caller, NODE, 1).alias("caller"),
        F.regexp_extract(caller, NODE, 2).alias("caller_id"),
        F.regexp_extract(callee, NODE, 1).alias("callee"),
        F.regexp_extract(callee, NODE, 2).alias("callee_id"),
        "inlined",
        F.when(F.col("inlined"), "").otherwise(_reason(F.col("tail"))).alias("reason"),
        F.coalesce("location.file", F.lit("")).alias("site_file"),
        F.coalesce("location.line", F.lit(0)).alias("line"),
        F.coalesce("location.column", F.lit(0)).alias("column"),
    ).distinct()
