"""Compiler dumps to symbols: observation, clones, merging, pruning, edges.

Dump rows carry the ``object`` they came from; a dump's own symbol numbers
(``local_id``) mean something only within that object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import identity
from codefacts.session import store

# Visibility words that decide linkage, and linkage by strength.
PUBLIC_WORDS = ("public", "externally_visible")
WEAK_WORD = "weak"
LINKAGE_RANK = {"external": 3, "weak": 2, "common": 2, "internal": 1}


def linkage_of(visibility: Column) -> Column:
    public = F.array_contains(visibility, PUBLIC_WORDS[0]) | F.array_contains(visibility, PUBLIC_WORDS[1])
    return (
        F.when(F.array_contains(visibility, WEAK_WORD), "weak").when(public, "external").otherwise("internal")
    )


def linkage_rank(linkage: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in LINKAGE_RANK.items() for x in pair])
    return F.coalesce(ranks[linkage], F.lit(0))


def observe(nodes: DataFrame, ci_nodes: DataFrame, object_sources: DataFrame) -> DataFrame:
    """One row per object and non-clone symbol, with identity and definition site.

    ``ci_nodes``: object, name, decl_file, decl_line (project-relative paths).
    ``object_sources``: object, source. A definition without a call-graph node
    falls back to the object's source at line 0.
    """
    own = F.coalesce(F.nullif("name", F.lit("")), F.col("linkage_name"))
    # Only what the result is made of crosses the shuffles of the joins below.
    named = nodes.filter((own != "") & (F.col("clone_of") == "")).select(
        "object",
        "local_id",
        "name",
        "linkage_name",
        F.coalesce(F.nullif("kind", F.lit("")), F.lit("function")).alias("kind"),
        linkage_of(F.col("visibility")).alias("linkage"),
        "address_taken",
        (F.col("analyzed") & ~F.col("body_removed")).alias("has_body"),
        F.array_contains("visibility", WEAK_WORD).alias("is_weak"),
    )
    sources = object_sources.select("object", F.col("source").alias("tu"))
    sites = ci_nodes.select(F.col("object").alias("__object"), F.col("name").alias("__own"), "decl_file", "decl_line")
    at = (F.col("object") == F.col("__object")) & (own == F.col("__own"))
    rows = named.join(sources, "object", "left").join(sites, at, "left").withColumn("own", own)
    scope = F.when(F.col("linkage") == "internal", F.coalesce("tu", F.lit(""))).otherwise(F.lit(""))
    file = F.coalesce(F.nullif("decl_file", F.lit("")), F.col("tu"), F.lit(""))
    return rows.select(
        "object",
        "local_id",
        identity.symbol_usr(F.col("kind"), scope, F.col("own")).alias("usr"),
        F.col("own").alias("name"),
        "kind",
        "linkage",
        "address_taken",
        F.col("name").alias("plain_name"),
        "linkage_name",
        "has_body",
        file.alias("file"),
        F.coalesce("decl_line", F.lit(0)).alias("line"),
        "is_weak",
    )


def attribute_clones(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """Clones take their parent's identity within the object; orphans are dropped.

    A clone's parent can be a clone itself, to any depth: levels are resolved
    until one resolves nothing new. Clones that only refer to each other never
    meet a symbol and are orphans.
    """
    clones = nodes.filter(F.col("clone_of") != "").select(
        "object", "local_id", "clone_of", "name", "linkage_name", "address_taken"
    )
    clones = store(clones)
    parents, out = observed.select("object", "local_id", "usr"), None
    while True:
        known = parents.select("object", F.col("local_id").alias("clone_of"), "usr")
        level = clones.join(known, ["object", "clone_of"]).select(
            "object", "local_id", "usr", "name", "linkage_name", "address_taken"
        )
        level = store(level)
        out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out
        parents = level.select("object", "local_id", "usr")


def local_identities(observed: DataFrame, clones: DataFrame) -> DataFrame:
    """``(object, local_id, usr)`` for everything that resolved."""
    return observed.select("object", "local_id", "usr").unionByName(
        clones.select("object", "local_id", "usr")
    )


def merge_symbols(observed: DataFrame, clones: DataFrame) -> DataFrame:
    """One row per identity: strongest linkage, address taken anywhere."""
    best = F.max(F.struct(linkage_rank(F.col("linkage")).alias("rank"), "linkage"))
    own = observed.groupBy("usr").agg(
        F.min("name").alias("name"),
        F.min("kind").alias("kind"),
        best.alias("best"),
        F.bool_or("address_taken").alias("own_taken"),
        F.bool_or("has_body").alias("has_def"),
    )
    taken = clones.groupBy("usr").agg(F.bool_or("address_taken").alias("clone_taken"))
    return own.join(taken, "usr", "left").select(
        "usr",
        "name",
        "kind",
        F.col("best.linkage").alias("linkage"),
        (F.col("own_taken") | F.coalesce("clone_taken", F.lit(False))).alias("address_taken"),
        "has_def",
    )


def merge_names(observed: DataFrame, clones: DataFrame) -> DataFrame:
    """``(usr, linkage_name)``: every link-time name, clone names included."""
    own = observed.select("usr", F.explode(F.array("plain_name", "linkage_name")).alias("linkage_name"))
    cloned = clones.select("usr", F.explode(F.array("name", "linkage_name")).alias("linkage_name"))
    return own.unionByName(cloned).filter(F.col("linkage_name") != "").distinct()


def merge_definitions(observed: DataFrame) -> DataFrame:
    """Definitions, distinct by site and linkage name; the first object's flag stands."""
    return (
        observed.filter("has_body")
        .groupBy("usr", "file", "line", "linkage_name")
        .agg(F.min_by("is_weak", "object").alias("is_weak"))
        .select(
            "usr",
            "file",
            "line",
            F.lit("").alias("decl_file"),
            F.lit(0).alias("decl_line"),
            "is_weak",
            "linkage_name",
        )
    )


def resolve_ends(rows: DataFrame, identities: DataFrame) -> DataFrame:
    """Replace ``caller_id``/``callee_id`` by identities; unresolved rows drop out."""
    out = rows
    for end in ("caller", "callee"):
        ids = identities.select(
            "object", F.col("local_id").alias(f"{end}_id"), F.col("usr").alias(f"{end}_usr")
        )
        out = out.join(ids, ["object", f"{end}_id"]).drop(f"{end}_id")
    return out


def edges_cgraph(resolved_calls: DataFrame) -> DataFrame:
    return resolved_calls.select(
        "caller_usr",
        "callee_usr",
        F.lit("compiler_cgraph").alias("source"),
        F.lit(None).cast("string").alias("target"),
    ).distinct()


def inline_decisions(resolved_calls: DataFrame) -> DataFrame:
    return resolved_calls.groupBy("caller_usr", "callee_usr").agg(F.bool_or("inlined").alias("inlined"))


def inline_records(records: DataFrame, identities: DataFrame) -> DataFrame:
    """Decisions with both ends resolved; repeats across objects are kept."""
    return resolve_ends(records, identities).select(
        "caller_usr", "callee_usr", "pass", "inlined", "reason", "file", "line", "column", "object"
    )


def icf_members(folds: DataFrame, nodes: DataFrame, identities: DataFrame) -> DataFrame:
    """``(winner_usr, object_file, loser_usr)`` of folds whose names resolve.

    A name several local ids share means the least of them.
    """
    names = (
        nodes.filter(F.col("name") != "")
        .join(identities, ["object", "local_id"])
        .groupBy("object", "name")
        .agg(F.min_by("usr", "local_id").alias("usr"))
    )
    out = folds
    for role in ("winner", "loser"):
        own = names.select(
            "object", F.col("name").alias(role), F.col("usr").alias(f"{role}_usr")
        )
        out = out.join(own, ["object", role])
    return (
        out.filter(F.col("winner_usr") != F.col("loser_usr"))
        .select("winner_usr", F.col("object").alias("object_file"), "loser_usr")
        .distinct()
    )


def referenced_usrs(resolved_calls: DataFrame, records: DataFrame, folds: DataFrame) -> DataFrame:
    """Every identity some other fact row points at."""
    ends = [
        df.select(F.explode(F.array(*columns)).alias("usr"))
        for df, columns in (
            (resolved_calls, ("caller_usr", "callee_usr")),
            (records, ("caller_usr", "callee_usr")),
            (folds, ("winner_usr", "loser_usr")),
        )
    ]
    return ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct()


def prune_unreferenced(symbols: DataFrame, referenced: DataFrame) -> DataFrame:
    """Drop internal symbols nothing defines, takes the address of, or points at."""
    pointed = referenced.select("usr").distinct().withColumn("pointed", F.lit(True))
    keep = (
        F.col("has_def")
        | F.col("address_taken")
        | (F.col("linkage") != "internal")
        | F.coalesce("pointed", F.lit(False))
    )
    return symbols.join(pointed, "usr", "left").filter(keep).drop("pointed")


def object_sources(titles: DataFrame) -> DataFrame:
    """``(object, source)`` for objects whose source is inside the project.

    ``titles``: object, rel, in_project.
    """
    return titles.filter("in_project").select("object", F.col("rel").alias("source"))
