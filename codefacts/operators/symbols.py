"""Symbol lookup: prefix search, exact names, one symbol's record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import text
from codefacts.operators import common


def prefix_hits(token_table: DataFrame, query: str) -> DataFrame | None:
    """Identities whose tokens include, for every query word, one that starts with it.

    Each word is a prefix filter on the token table, pushed down to the sorted
    files; the words combine by semi-joins on identity. ``None`` when the query
    has no words.
    """
    words = text.query_words(query)
    if not words:
        return None
    hits = None
    for word in dict.fromkeys(words):
        # A prefix can match several tokens of one symbol; distinct merges map-side.
        match = token_table.filter(F.col("token").startswith(word)).select("usr").distinct()
        hits = match if hits is None else hits.join(match, "usr", "left_semi")
    return hits


def find_symbol(
    facts: Facts,
    query: str | Column,
    exact: bool = False,
    kind: str | None = None,
    target: str | Column | None = None,
) -> DataFrame:
    """Matching symbols, uncapped; order by ``(name, usr)`` and cut for a page."""
    if exact:
        q = common.value(query)
        named = facts.symbol_names.filter(F.col("linkage_name") == q).select("usr")
        own = facts.by("symbols", "name").filter(F.col("name") == q).select("usr")
        hits = named.unionByName(own).distinct()
    else:
        hits = prefix_hits(facts.symbol_tokens, query)
    symbols = facts.symbols.select(
        "usr", "name", "kind", "linkage", F.coalesce("signature", F.lit("")).alias("signature")
    )
    if hits is None:
        return symbols.limit(0)
    found = symbols.join(hits, "usr", "left_semi")
    if kind:
        found = found.filter(F.col("kind") == kind)
    if target is not None:
        found = common.in_target(found, facts, target)
    return found


def page(hits: DataFrame, limit: int, keys: tuple[str, ...] = ("name", "usr")) -> DataFrame:
    return hits.orderBy(*keys).limit(limit)


def describe_symbol(facts: Facts, usr: str | Column) -> DataFrame:
    return facts.symbols.filter(F.col("usr") == common.value(usr)).select(
        "usr",
        "name",
        "kind",
        "linkage",
        F.coalesce("signature", F.lit("")).alias("signature"),
        F.col("address_taken").cast("int").alias("address_taken"),
    )


def linkage_names(facts: Facts, usr: str | Column) -> DataFrame:
    names = facts.by("symbol_names", "usr").filter(F.col("usr") == common.value(usr))
    return names.select("linkage_name").distinct()


def definitions(facts: Facts, usr: str | Column, snippets: bool = True) -> DataFrame:
    rows = facts.symbol_definitions.filter(F.col("usr") == common.value(usr))
    return common.with_location(rows, facts, snippets)


def symbol_targets(facts: Facts, usr: str | Column) -> DataFrame:
    return facts.link_resolutions.filter(F.col("usr") == common.value(usr)).select("target").distinct()


def resolutions(facts: Facts, usr: str | Column) -> DataFrame:
    """Per target: the object that won and how many lost (losers are rows of ``link_losers``)."""
    u = common.value(usr)
    lost = facts.link_losers.filter(F.col("usr") == u).groupBy("target", "usr").agg(
        F.count(F.lit(1)).alias("n_losing")
    )
    return (
        facts.link_resolutions.filter(F.col("usr") == u)
        .join(lost, ["target", "usr"], "left")
        .select(
            "target",
            "usr",
            "winning_object",
            "linkage_kind",
            "archive",
            F.coalesce("n_losing", F.lit(0)).alias("n_losing"),
        )
    )


def empty_note(query: str, exact: bool, target: str | None) -> str:
    """Says which kind of nothing an empty hit list is."""
    parts = [
        f'No symbol or linkage name equals "{query}".' if exact else "Nothing matched in names or signatures.",
        "Only functions and variables are symbols: look for types and enum constants with find_type, "
        "for macros with search_source.",
    ]
    if target:
        parts.append("File-local symbols have no link rows, so a target filter always hides them.")
    if not exact:
        parts.append("Use exact=True to test for one literal name.")
    return " ".join(parts)
