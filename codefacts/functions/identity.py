"""Identity strings for C entities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One marker letter per entity kind, the anonymous-tag form and
# the suffixes a compiler appends to the name of a specialised copy.
MARKERS = {
    "function": "F",
    "variable": "V",
    "typedef": "T",
    "struct": "S",
    "union": "U",
    "enum": "E",
}
ANONYMOUS_PREFIX = "__anon_"
CLONE_SUFFIXES = ("constprop", "isra", "part", "localalias", "cold", "hot", "resolver")
CLONE_PATTERN = rf"^(.*?)(\.({'|'.join(CLONE_SUFFIXES)})(\.\d+)?)$"


def _text(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def symbol_usr(kind: Column, path: Column, name: Column) -> Column:
    """Function or variable identity; an empty path means external linkage."""
    marker = F.when(kind == "variable", F.lit("@V@")).otherwise(F.lit("@F@"))
    return F.concat(F.lit("c:"), F.coalesce(path, F.lit("")), marker, name)


def tag_name(name: Column, line: Column, column: Column) -> Column:
    anonymous = F.concat(
        F.lit(ANONYMOUS_PREFIX), line.cast("string"), F.lit("_"), column.cast("string")
    )
    return F.when(F.coalesce(name, F.lit("")) == "", anonymous).otherwise(name)


def type_usr(kind: Column, path: Column, name: Column, line: Column, column: Column) -> Column:
    """Type identity: always scoped to the declaring file."""
    marker = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])[kind]
    tag = F.when(kind == "typedef", name).otherwise(tag_name(name, line, column))
    return F.concat(F.lit("c:"), path, F.lit("@"), marker, F.lit("@"), tag)


def enum_member_usr(enum_usr: Column, member: Column) -> Column:
    return F.concat(enum_usr, F.lit("@"), member)


def field_usr(container_usr: Column, field: Column) -> Column:
    return F.concat(container_usr, F.lit("@F@"), field)


def clone_base(name: Column) -> Column:
    """Name without its clone suffix; the name itself when it has none."""
    base = F.regexp_extract(name, CLONE_PATTERN, 1)
    return F.when(name.rlike(CLONE_PATTERN), base).otherwise(name)


def clone_suffix(name: Column) -> Column:
    return F.regexp_extract(name, CLONE_PATTERN, 2)


def normalize_project_path(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashed, r"^\./", ""), "/$", "")
