"""Indirect calls and what they could reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import common

TYPE_MATCH = "type_match"
ADDRESS_TAKEN = "address_taken"
CANDIDATE = "candidate"


def list_indirect_call_sites(
    facts: Facts,
    caller_usr: str | Column | None = None,
    callee_type: str | None = None,
    target: str | Column | None = None,
) -> DataFrame:
    """Sites with their caller; order by ``(file, line, column, site_id)`` for a page."""
    # by caller the table itself is sorted
    typed = caller_usr is None and callee_type is not None
    rows = facts.by("indirect_call_sites", "callee_type") if typed else facts.indirect_call_sites
    if caller_usr is not None:
        rows = rows.filter(F.col("caller_usr") == common.value(caller_usr))
    if callee_type is not None:
        rows = rows.filter(F.col("callee_type") == callee_type)
    callers = facts.symbols.select(F.col("usr").alias("caller_usr"), F.col("name").alias("caller"))
    rows = rows.join(callers, "caller_usr")
    return rows if target is None else common.in_target(rows, facts, target, "caller_usr")


def list_address_taken_functions(
    facts: Facts, fn_ptr_type: str | Column | None = None, target: str | Column | None = None
) -> DataFrame:
    rows = facts.symbols.filter(F.col("address_taken") & (F.col("kind") == "function"))
    if fn_ptr_type is not None:
        rows = rows.filter(F.col("signature") == common.value(fn_ptr_type))
    rows = rows.select("usr", "name", "kind", F.coalesce("signature", F.lit("")).alias("signature"))
    return rows if target is None else common.in_target(rows, facts, target)


def resolve_indirect_call(facts: Facts, site_id: int | Column) -> DataFrame:
    """Functions one site could call.

    With a known callee type: address-taken functions of exactly that
    signature. Without one: every address-taken function. Each is only ever a
    candidate.
    """
    site = facts.by("indirect_call_sites", "site_id").filter(F.col("site_id") == common.value(site_id))
    wanted = site.select(F.coalesce(F.max("callee_type"), F.lit(""))).scalar()
    pool = list_address_taken_functions(facts)
    typed = F.col("callee_type") != ""
    return (
        pool.withColumn("callee_type", wanted)
        .filter(~typed | (F.col("signature") == F.col("callee_type")))
        .select(
            "usr",
            "name",
            "signature",
            F.when(typed, TYPE_MATCH).otherwise(ADDRESS_TAKEN).alias("evidence"),
            F.lit(CANDIDATE).alias("confidence"),
        )
    )


def candidate_counts(facts: Facts) -> DataFrame:
    """How many candidates every site has, without listing them site by site.

    Candidates depend on the site only through its type, so functions are
    counted per signature first and the small counts join the sites.
    """
    pool = list_address_taken_functions(facts)
    per_type = pool.groupBy(F.col("signature").alias("callee_type")).agg(
        F.count(F.lit(1)).alias("typed_n")
    )
    everything = pool.agg(F.count(F.lit(1))).scalar()
    typed = F.col("callee_type") != ""
    return facts.indirect_call_sites.join(per_type, "callee_type", "left").select(
        "site_id",
        "callee_type",
        F.when(typed, TYPE_MATCH).otherwise(ADDRESS_TAKEN).alias("evidence"),
        F.when(typed, F.coalesce("typed_n", F.lit(0))).otherwise(everything).alias("n_candidates"),
    )
