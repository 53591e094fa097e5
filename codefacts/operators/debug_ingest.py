"""Debug-information rows to facts: signatures, sites, inlined bodies, types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import identity

# Kinds of type record in the order one object lists them.
KIND_ORDER = {"struct": 0, "union": 0, "typedef": 1, "enum": 2}


def lookup_symbols(rows: DataFrame, symbols: DataFrame, name: str, out: str) -> DataFrame:
    """Resolve a function name seen in an object: the external identity first, then the object's own.

    ``rows`` need ``source``, the project-relative path of the object's unit.
    """
    known = symbols.select("usr").distinct()
    outer = known.select(F.col("usr").alias("__outer"), F.lit(True).alias("__is_outer"))
    inner = known.select(F.col("usr").alias("__inner"), F.lit(True).alias("__is_inner"))
    fn = F.lit("function")
    as_outer = identity.symbol_usr(fn, F.lit(""), F.col(name))
    as_inner = F.when(
        F.coalesce("source", F.lit("")) != "", identity.symbol_usr(fn, F.col("source"), F.col(name))
    )
    # The identities are spelled where they are compared: rows cross each shuffle with a mark in their place.
    found = rows.join(outer, as_outer == F.col("__outer"), "left").drop("__outer")
    found = found.join(inner, as_inner == F.col("__inner"), "left").drop("__inner")
    usr = F.when(F.col("__is_outer"), as_outer).when(F.col("__is_inner"), as_inner)
    return found.withColumn(out, F.when(F.col(name) != "", usr)).drop("__is_outer", "__is_inner")


def signatures(subprograms: DataFrame) -> DataFrame:
    """``(usr, signature)``: of several objects the last one's definition stands."""
    defined = subprograms.filter(F.col("definition") & (F.col("signature") != ""))
    return defined.groupBy("usr").agg(
        F.max_by("signature", F.struct("object", "ordinal")).alias("signature")
    )


def enrich_symbols(symbols: DataFrame, subprograms: DataFrame) -> DataFrame:
    found = signatures(subprograms)
    return (
        symbols.drop("signature")
        .join(found, "usr", "left")
        .withColumn("signature", F.coalesce("signature", F.lit("")))
    )


def enrich_definitions(definitions: DataFrame, subprograms: DataFrame) -> DataFrame:
    """Repair fallback sites and fill declaration sites.

    A site at line 0 takes the place where the body was written; a missing
    declaration takes the first declaration seen. First means by object, then
    by position inside it.
    """
    order = F.struct("object", "ordinal")
    site = F.struct("decl_file", "decl_line")
    located = (F.col("decl_file") != "") & (F.col("decl_line") > 0)
    written = (
        subprograms.filter(F.col("abstract_inline") & located)
        .groupBy("usr")
        .agg(F.min_by(site, order).alias("written"))
    )
    declared = (
        subprograms.filter(F.col("declaration") & located)
        .groupBy("usr")
        .agg(F.min_by(site, order).alias("declared"))
    )
    unsited = (F.col("line") == 0) & F.col("written").isNotNull()
    undeclared = (F.coalesce("decl_file", F.lit("")) == "") & F.col("declared").isNotNull()
    return (
        definitions.join(written, "usr", "left")
        .join(declared, "usr", "left")
        .select(
            "usr",
            F.when(unsited, F.col("written.decl_file")).otherwise(F.col("file")).alias("file"),
            F.when(unsited, F.col("written.decl_line")).otherwise(F.col("line")).alias("line"),
            F.when(undeclared, F.col("declared.decl_file"))
            .otherwise(F.coalesce("decl_file", F.lit("")))
            .alias("decl_file"),
            F.when(undeclared, F.col("declared.decl_line"))
            .otherwise(F.coalesce("decl_line", F.lit(0)))
            .alias("decl_line"),
            "is_weak",
            "linkage_name",
        )
    )


def indirect_sites(call_sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Indirect calls whose source-level caller is a known symbol."""
    rows = call_sites.filter(F.col("indirect") & (F.col("caller") != ""))
    return (
        lookup_symbols(rows, symbols, "caller", "caller_usr")
        .filter(F.col("caller_usr").isNotNull())
        .select("caller_usr", "file", "line", "column", "callee_type", "field_hint", "object", "ordinal")
    )


def inline_instances(bodies: DataFrame, symbols: DataFrame) -> DataFrame:
    """Inlined bodies with callee and host resolved; an unknown parent stays NULL."""
    rows = lookup_symbols(bodies, symbols, "callee", "callee_usr")
    rows = lookup_symbols(rows, symbols, "caller", "caller_usr")
    rows = rows.filter(F.col("callee_usr").isNotNull() & F.col("caller_usr").isNotNull())
    rows = lookup_symbols(rows, symbols, "parent_callee", "parent_callee_usr")
    return rows.select(
        "callee_usr", "caller_usr", "parent_callee_usr", "depth", "file", "line", "column", "object"
    )


def _kind_order(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair])[kind]


def type_sightings(records: DataFrame) -> DataFrame:
    """Type records declared inside the project, with identity.

    ``records``: object, type_offset, ordinal, name, kind, decl_file,
    in_project, decl_line, decl_column, byte_size, underlying.
    """
    rows = records.filter(
        F.col("in_project") & (F.col("decl_file") != "") & ((F.col("kind") != "typedef") | (F.col("name") != ""))
    )
    usr = identity.type_usr(
        F.col("kind"), F.col("decl_file"), F.col("name"), F.col("decl_line"), F.col("decl_column")
    )
    return rows.withColumn("usr", usr)


def first_sightings(sightings: DataFrame) -> DataFrame:
    """``(usr, object, type_offset)``: the sighting that speaks for each type."""
    order = F.struct("object", _kind_order(F.col("kind")).alias("kind_order"), "ordinal")
    return sightings.groupBy("usr").agg(
        F.min_by(F.struct("object", "type_offset"), order).alias("w")
    ).select("usr", "w.object", "w.type_offset")


def dedup_types(sightings: DataFrame) -> DataFrame:
    chosen = first_sightings(sightings)
    return sightings.join(chosen, ["usr", "object", "type_offset"], "left_semi").select(
        "usr",
        "name",
        "kind",
        "decl_file",
        "decl_line",
        F.when(F.col("byte_size") > 0, F.col("byte_size")).alias("byte_size"),
        "underlying",
    )


def children_of(children: DataFrame, sightings: DataFrame) -> DataFrame:
    """Fields or constants of the sighting that speaks for its type, with ``type_usr``."""
    chosen = first_sightings(sightings).withColumnRenamed("usr", "type_usr")
    return children.join(chosen, ["object", "type_offset"]).drop("object", "type_offset")


def dedup_constants(constants: DataFrame, sightings: DataFrame) -> DataFrame:
    rows = children_of(constants, sightings)
    return (
        rows.withColumn("usr", identity.enum_member_usr(F.col("type_usr"), F.col("name")))
        .groupBy("usr")
        .agg(F.min_by(F.struct("type_usr", "name", "value"), "ordinal").alias("c"))
        .select("usr", "c.*")
    )
