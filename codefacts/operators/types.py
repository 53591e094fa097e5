"""Type lookup and layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import text
from codefacts.operators import common
from codefacts.operators.symbols import prefix_hits

ENUM_CONSTANT = "enum_constant"


def _type_hits(facts: Facts, query: str, exact: bool, kind: str | None) -> DataFrame | None:
    if exact:
        rows = facts.by("types", "name").filter(F.col("name") == query)
    else:
        hits = prefix_hits(facts.type_tokens, query)
        if hits is None:
            return None
        rows = facts.types.join(hits, "usr", "left_semi")
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    return rows.select(
        F.lit(0).alias("ord"),
        "usr",
        "name",
        "kind",
        F.coalesce("decl_file", F.lit("")).alias("decl_file"),
        F.coalesce("decl_line", F.lit(0)).alias("decl_line"),
        F.coalesce("underlying", F.lit("")).alias("underlying"),
        F.coalesce("byte_size", F.lit(0)).alias("byte_size"),
        F.lit("").alias("enum_name"),
        F.lit(None).cast("long").alias("value"),
    )


def _constant_hits(facts: Facts, query: str, exact: bool) -> DataFrame:
    name = F.col("name")
    rows = facts.enum_constants.filter(name == query if exact else text.like_contains(name, query))
    owners = facts.types.select(
        F.col("usr").alias("type_usr"),
        F.col("name").alias("enum_name"),
        "decl_file",
        "decl_line",
    )
    return rows.join(owners, "type_usr", "left").select(
        F.lit(1).alias("ord"),
        "usr",
        "name",
        F.lit(ENUM_CONSTANT).alias("kind"),
        F.coalesce("decl_file", F.lit("")).alias("decl_file"),
        F.coalesce("decl_line", F.lit(0)).alias("decl_line"),
        F.lit("").alias("underlying"),
        F.lit(0).alias("byte_size"),
        F.coalesce("enum_name", F.lit("")).alias("enum_name"),
        "value",
    )


def find_type(facts: Facts, query: str, exact: bool = False, kind: str | None = None) -> DataFrame:
    """Types by prefix search and enum constants by containment.

    Types come before constants (``ord``), so a page can be all types.
    """
    parts = []
    if kind != ENUM_CONSTANT:
        hits = _type_hits(facts, query, exact, kind)
        if hits is not None:
            parts.append(hits)
    if kind in (None, "", ENUM_CONSTANT):
        parts.append(_constant_hits(facts, query, exact))
    if not parts:
        return _constant_hits(facts, query, exact).limit(0)
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def describe_type(facts: Facts, usr: str | Column) -> DataFrame:
    return facts.types.filter(F.col("usr") == common.value(usr))


def fields(facts: Facts, usr: str | Column) -> DataFrame:
    """Order by ``ordinal``."""
    return facts.type_fields.filter(F.col("type_usr") == common.value(usr)).select(
        "name", "type", "ordinal", "byte_offset"
    )


def constants(facts: Facts, usr: str | Column) -> DataFrame:
    """Order by ``(value, name)``."""
    return facts.enum_constants.filter(F.col("type_usr") == common.value(usr)).select(
        "usr", "name", "value"
    )


def empty_note(query: str, exact: bool) -> str:
    note = (
        f'No type or enum constant equals "{query}".' if exact else "No type or enum constant matched."
    )
    note += " Only types some translation unit used are recorded, so absence is not proof."
    return note if exact else note + " Use exact=True to test for one literal name."
