"""From symbol-table listings, linker maps and disassembly to link facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import identity, paths

# Nm kind letters by how strongly they claim a name, the linkage
# kind each one is reported as, and the letters of file-local data.
STRONG = ("T", "D", "B", "R")
WEAK = ("W", "V")
COMMON = ("C",)
UNIQUE_GLOBAL = ("u",)
LOCAL_DATA = ("d", "b", "r")
FUNCTION_KINDS = ("T", "t", "W", "w")


def nm_rank(kind: Column) -> Column:
    local = kind.rlike("^[a-z]$")
    return (
        F.when(kind.isin(*STRONG), 3)
        .when(kind.isin(*WEAK), 2)
        .when(kind.isin(*COMMON), 1)
        .when(local, 0)
        .otherwise(-1)
    )


def linkage_kind(kind: Column) -> Column:
    """Reported linkage of an nm kind; empty for kinds that take no part in linking."""
    return (
        F.when(kind.isin(*WEAK), "weak")
        .when(kind.isin(*COMMON), "common")
        .when(kind.isin(*UNIQUE_GLOBAL), "unique_global")
        .when(kind.isin(*STRONG), "strong")
        .otherwise("")
    )


def is_local(kind: Column) -> Column:
    return kind.rlike("^[a-z]$") & ~kind.isin("w", "v")


def address_key(hex_text: Column) -> Column:
    """Join key for a hexadecimal address: no leading zeros, lower case.

    Addresses are unsigned 64-bit, beyond a signed long, so text is the key.
    """
    return F.lower(F.regexp_replace(hex_text, "^(0[xX])?0*(?=[0-9a-fA-F])", ""))


def pick_winners(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the candidate of highest rank, ties to the least object path."""
    best = F.min(F.struct((-nm_rank(F.col("nm_kind"))).alias("rank"), "object", "nm_kind"))
    return candidates.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.object", "best.nm_kind")


def collect_losers(candidates: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Every other object per key, one row each."""
    won = winners.select(*keys, F.col("winning_object").alias("object"))
    keyed = candidates.join(won.select(*keys).distinct(), keys, "left_semi")
    return keyed.select(*keys, "object").distinct().join(won, [*keys, "object"], "left_anti")


def name_lookup(symbols: DataFrame, symbol_names: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(name, usr)``: the symbol a linker-level name means.

    Own names and linkage names both count. A symbol with a definition beats
    one without, then the least identity.
    """
    defined = definitions.select("usr").distinct().withColumn("has_def", F.lit(True))
    names = (
        symbols.select("usr", "name")
        .unionByName(symbol_names.select("usr", F.col("linkage_name").alias("name")))
        .filter(F.col("name") != "")
        .distinct()
        .join(defined, "usr", "left")
    )
    first = F.min(F.struct(F.col("has_def").isNull().alias("undefined"), "usr"))
    return names.groupBy("name").agg(first.alias("pick")).select("name", "pick.usr")


def resolve_nm_symbols(
    listing: DataFrame,
    map_origins: DataFrame,
    object_defs: DataFrame,
    object_sources: DataFrame,
    symbols: DataFrame,
    names: DataFrame,
) -> DataFrame:
    """Attach ``usr`` and ``map_object`` to every listed symbol that resolves.

    ``listing``: target, name, nm_kind, address, pos. Global symbols resolve by
    name. File-local ones resolve through the object that supplied them: the
    one the map names, else the only object defining the name; failing both,
    by name as well.
    """
    sole = (
        object_defs.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("object").alias("sole_object"))
        .filter(F.col("n") == 1)
        .select("name", "sole_object")
    )
    origin = map_origins.select("target", "name", F.col("object").alias("map_object"))
    rows = listing.join(origin, ["target", "name"], "left").join(sole, "name", "left")

    def through(rows: DataFrame, object_col: str, out: str) -> DataFrame:
        sources = object_sources.select(
            F.col("object").alias(object_col), F.col("source").alias(f"{out}_source")
        )
        scoped = identity.symbol_usr(
            F.when(F.col("nm_kind").isin(*LOCAL_DATA), "variable").otherwise("function"),
            F.col(f"{out}_source"),
            F.col("name"),
        )
        candidate = F.when(F.col(f"{out}_source").isNotNull() & is_local(F.col("nm_kind")), scoped)
        known = symbols.select(F.col("usr").alias(f"{out}_try"), F.col("usr").alias(out))
        return (
            rows.join(sources, object_col, "left")
            .withColumn(f"{out}_try", candidate)
            .join(known, f"{out}_try", "left")
            .drop(f"{out}_try", f"{out}_source")
        )

    rows = through(rows, "map_object", "map_usr")
    rows = through(rows, "sole_object", "sole_usr")
    by_name = names.select("name", F.col("usr").alias("name_usr"))
    rows = rows.join(by_name, "name", "left")
    return (
        rows.withColumn("usr", F.coalesce("map_usr", "sole_usr", "name_usr"))
        .filter(F.col("usr").isNotNull())
        .select("target", "name", "nm_kind", "address", "pos", "map_object", "usr")
    )


def address_index(resolved: DataFrame) -> DataFrame:
    """``(target, address, usr)`` of functions; the later listing entry wins."""
    functions = resolved.filter(F.col("nm_kind").isin(*FUNCTION_KINDS) & (F.col("address") != ""))
    return (
        functions.withColumn("address", address_key(F.col("address")))
        .groupBy("target", "address")
        .agg(F.max_by("usr", "pos").alias("usr"))
    )


def link_resolutions(resolved: DataFrame, object_defs: DataFrame) -> DataFrame:
    """One row per target and listed symbol that takes part in linking.

    Losing objects are not stored per target: they are the other objects in
    ``object_defs`` under the same name, see :func:`losers_view`.
    """
    picked = pick_winners(object_defs, ["name"]).select("name", F.col("object").alias("picked"))
    rows = resolved.filter(linkage_kind(F.col("nm_kind")) != "").join(picked, "name", "left")
    winner = F.coalesce("map_object", "picked", F.lit(""))
    return rows.select(
        "target",
        "usr",
        "name",
        winner.alias("winning_object"),
        linkage_kind(F.col("nm_kind")).alias("linkage_kind"),
        paths.archive_of(winner).alias("archive"),
    )


def losers_view(resolutions: DataFrame, object_defs: DataFrame) -> DataFrame:
    """``(target, usr, object)`` for losing objects, derived when asked for."""
    candidates = object_defs.select("name", "object").distinct()
    return (
        resolutions.select("target", "usr", "name", "winning_object")
        .join(candidates, "name")
        .filter(F.col("object") != F.col("winning_object"))
        .select("target", "usr", "object")
    )


def loser_counts(resolutions: DataFrame, object_defs: DataFrame) -> DataFrame:
    """``(target, usr, n_losing)`` without listing a name's candidates once per target.

    Objects are counted per name; a winner that is among them is not a loser.
    """
    candidates = object_defs.select("name", "object").distinct()
    per_name = candidates.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    own = candidates.select("name", F.col("object").alias("winning_object")).withColumn("own", F.lit(1))
    losing = F.col("n") - F.coalesce("own", F.lit(0))
    return (
        resolutions.join(per_name, "name")
        .join(own, ["name", "winning_object"], "left")
        .groupBy("target", "usr")
        .agg(F.sum(losing).alias("n_losing"))
        .filter(F.col("n_losing") > 0)
    )


def edges_objdump(calls: DataFrame, addresses: DataFrame, names: DataFrame) -> DataFrame:
    """Direct calls of the linked binaries as edges, distinct per target.

    ``calls``: target, caller, caller_address, callee, callee_address. An end
    resolves by address first, which tells same-named statics apart, and else
    by its name without version or stub decoration.
    """
    distinct = calls.select(
        "target",
        "caller",
        address_key(F.col("caller_address")).alias("caller_address"),
        F.substring_index("callee", "@", 1).alias("callee"),
        address_key(F.col("callee_address")).alias("callee_address"),
    ).distinct()

    def resolve(rows: DataFrame, end: str) -> DataFrame:
        by_address = addresses.select(
            "target", F.col("address").alias(f"{end}_address"), F.col("usr").alias("by_address")
        )
        by_name = names.select(F.col("name").alias(end), F.col("usr").alias("by_name"))
        return (
            rows.join(by_address, ["target", f"{end}_address"], "left")
            .join(by_name, end, "left")
            .withColumn(f"{end}_usr", F.coalesce("by_address", "by_name"))
            .drop("by_address", "by_name")
            .filter(F.col(f"{end}_usr").isNotNull())
        )

    return (
        resolve(resolve(distinct, "caller"), "callee")
        .select("caller_usr", "callee_usr", F.lit("objdump").alias("source"), "target")
        .distinct()
    )
