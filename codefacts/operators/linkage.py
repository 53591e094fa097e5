"""Link-time truth: winners, weak and undefined symbols, folds, dead code, entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import common


def describe_link_resolution(facts: Facts, usr: str | Column, target: str | Column) -> DataFrame:
    """The winning row; more than one row orders by ``(winning_object, linkage_kind)``."""
    return (
        facts.link_resolutions.filter(
            (F.col("usr") == common.value(usr)) & (F.col("target") == common.value(target))
        )
        .orderBy("winning_object", "linkage_kind")
        .limit(1)
        .withColumn("reachable", F.lit(1))
    )


def losing_objects(facts: Facts, usr: str | Column, target: str | Column) -> DataFrame:
    return facts.link_losers.filter(
        (F.col("usr") == common.value(usr)) & (F.col("target") == common.value(target))
    ).select("object")


def list_weak_symbols(
    facts: Facts, target: str | Column | None = None, strict: bool = False
) -> DataFrame:
    """Symbols with a weak definition or weak linkage.

    A target filter applies only to the weak-linkage arm unless ``strict``: a
    symbol with a weak definition is listed whatever the target keeps, which is
    what callers of the query have always been given.
    """
    weak_defs = facts.symbol_definitions.filter("is_weak").select("usr").distinct()
    by_linkage = facts.symbols.filter(F.col("linkage") == "weak").select("usr")
    if target is not None:
        by_linkage = common.in_target(by_linkage, facts, target)
        if strict:
            weak_defs = common.in_target(weak_defs, facts, target)
    weak = weak_defs.unionByName(by_linkage).distinct()
    return common.symbol_ref(facts).join(weak, "usr", "left_semi")


def weak_definitions(facts: Facts, snippets: bool = True) -> DataFrame:
    rows = facts.symbol_definitions.filter("is_weak").select("usr", "file", "line")
    return common.with_location(rows, facts, snippets)


def list_undefined_symbols(facts: Facts, target: str | Column | None = None) -> DataFrame:
    """Linked callees without any definition, with the calls into each per target."""
    edges = facts.call_edges.filter(F.col("source") == common.OBJDUMP)
    if target is not None:
        edges = edges.filter(F.col("target") == common.value(target))
    # Count before joining: one row per (target, callee) meets the symbols.
    calls = edges.groupBy("target", F.col("callee_usr").alias("usr")).agg(
        F.count(F.lit(1)).alias("called_count")
    )
    defined = facts.symbol_definitions.select("usr").distinct()
    return (
        calls.join(defined, "usr", "left_anti")
        .join(common.symbol_ref(facts), "usr")
        .select("target", "usr", "name", "kind", "signature", "called_count")
    )


def list_icf_groups(facts: Facts, target: str | Column | None = None) -> DataFrame:
    groups = facts.icf_groups.select("winner_usr", "object_file")
    if target is not None:
        groups = common.in_target(groups, facts, target, "winner_usr")
    losers = facts.icf_group_members.groupBy("winner_usr", "object_file").agg(
        F.count(F.lit(1)).alias("n_losers")
    )
    names = facts.symbols.select(F.col("usr").alias("winner_usr"), F.col("name").alias("winner"))
    return groups.join(losers, ["winner_usr", "object_file"], "left").join(names, "winner_usr")


def icf_losers(facts: Facts, target: str | Column | None = None) -> DataFrame:
    members = facts.icf_group_members
    if target is not None:
        members = common.in_target(members, facts, target, "winner_usr")
    names = facts.symbols.select(F.col("usr").alias("loser_usr"), F.col("name").alias("loser"))
    return members.join(names, "loser_usr").select("winner_usr", "object_file", "loser_usr", "loser")


def list_unreachable_symbols(facts: Facts, target: str | Column) -> DataFrame:
    """Symbols the link of ``target`` did not keep; nothing for a static library.

    Declared-only externals are included: a symbol counts when it has no link
    row, defined or not. Order by ``(name, usr)`` for a page.
    """
    t = common.value(target)
    linked_kind = (
        facts.targets.filter((F.col("name") == t) & F.col("kind").isin(*common.LINKED_KINDS))
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    kept = facts.by("link_resolutions", "target").filter(F.col("target") == t).select("usr").distinct()
    return (
        common.symbol_ref(facts)
        .join(kept, "usr", "left_anti")
        .filter(linked_kind > 0)
        .withColumn("section_kept", F.lit(1))
    )


def list_entry_points(facts: Facts, target: str | Column) -> DataFrame:
    """``main`` and kept external symbols, one row per symbol with its first definition.

    Order by ``(is_main desc, name, usr)`` for a page.
    """
    candidates = facts.symbols.filter((F.col("name") == "main") | (F.col("linkage") == "external"))
    kept = common.in_target(candidates, facts, target)
    first = facts.symbol_definitions.groupBy("usr").agg(F.min(F.struct("file", "line")).alias("at"))
    is_main = F.col("name") == "main"
    return kept.join(first, "usr", "left").select(
        "usr",
        "name",
        "kind",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.when(is_main, "main").otherwise("exported").alias("reason"),
        is_main.cast("int").alias("is_main"),
        F.coalesce(F.col("at.file"), F.lit("")).alias("file"),
        F.coalesce(F.col("at.line"), F.lit(0)).alias("line"),
    )
