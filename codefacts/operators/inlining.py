"""Inlining decisions, surviving bodies and the verdict on a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import common

PRESENT = "inlined_and_present"
FOLDED = "inlined_then_folded"
DECLINED = "declined"
MIXED = "mixed"
NO_DECISION = "no_decision_logged"

PAIR = ["caller_usr", "callee_usr"]


def _named(df: DataFrame, facts: Facts, usr: str, out: str) -> DataFrame:
    names = facts.symbols.select(F.col("usr").alias(usr), F.col("name").alias(out))
    return df.join(names, usr, "inner")


def records(facts: Facts, usr: str | Column, end: str = "caller_usr") -> DataFrame:
    rows = facts.by("inline_records", end).filter(F.col(end) == common.value(usr))
    return _named(_named(rows, facts, "caller_usr", "caller"), facts, "callee_usr", "callee")


def instances(facts: Facts, usr: str | Column, end: str = "caller_usr") -> DataFrame:
    rows = facts.by("inline_instances", end).filter(F.col(end) == common.value(usr))
    rows = _named(_named(rows, facts, "caller_usr", "caller"), facts, "callee_usr", "callee")
    parents = facts.symbols.select(
        F.col("usr").alias("parent_callee_usr"), F.col("name").alias("parent_callee")
    )
    return rows.join(parents, "parent_callee_usr", "left")


def decisions(facts: Facts, usr: str | Column) -> DataFrame:
    rows = facts.inline_decisions.filter(F.col("caller_usr") == common.value(usr))
    return _named(rows, facts, "callee_usr", "callee").select("callee_usr", "callee", "inlined")


def summary(facts: Facts, usr: str | Column, end: str = "caller_usr") -> DataFrame:
    """Exact counts whatever page is shown: ``(plane, key, inlined, n)`` rows.

    Records count by pass and outcome, instances by nesting depth, calls of
    the compiler's graph by whether they were inlined.
    """
    u = common.value(usr)
    by_pass = (
        facts.by("inline_records", end).filter(F.col(end) == u)
        .groupBy(F.col("pass").alias("key"), F.col("inlined").cast("int").alias("inlined"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("records").alias("plane"), "key", "inlined", "n")
    )
    by_depth = (
        facts.by("inline_instances", end).filter(F.col(end) == u)
        .groupBy(F.col("depth").cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("instances").alias("plane"), "key", F.lit(1).alias("inlined"), "n")
    )
    by_edge = (
        facts.by("inline_decisions", end).filter(F.col(end) == u)
        .groupBy(F.col("inlined").cast("int").alias("inlined"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("cgraph_edges").alias("plane"), F.lit("").alias("key"), "inlined", "n")
    )
    return by_pass.unionByName(by_depth).unionByName(by_edge)


def per_object_verdicts(records: DataFrame, instances: DataFrame) -> DataFrame:
    """Verdict per ``(caller, callee, object)`` over any set of calls.

    A surviving body outranks any remark, an accepted record outranks declined
    ones, and of the declined ones the later pass explains best: the first
    remark of the ``inline`` pass, else the last one of an earlier pass. Rows
    of one pass order by their text and position so the choice is stable.
    """
    keys = [*PAIR, "object"]
    # Remark order within one object: by source position, then by text.
    position = F.struct("file", "line", "column", "reason")
    declined = ~F.col("inlined")
    late = declined & (F.col("pass") == "inline")
    early = declined & (F.col("pass") != "inline")
    remark = F.struct(position.alias("at"), F.col("pass").alias("pass"), F.col("reason").alias("reason"))
    from_records = records.select(
        *keys,
        F.lit(False).alias("has_body"),
        F.col("inlined").alias("accepted"),
        F.when(late, remark).alias("late"),
        F.when(early, remark).alias("early"),
    )
    nothing = F.lit(None).cast(from_records.schema["late"].dataType)
    from_bodies = instances.select(
        *keys,
        F.lit(True).alias("has_body"),
        F.lit(False).alias("accepted"),
        nothing.alias("late"),
        nothing.alias("early"),
    )
    folded = (
        from_records.unionByName(from_bodies)
        .groupBy(*keys)
        .agg(
            F.bool_or("has_body").alias("has_body"),
            F.bool_or("accepted").alias("accepted"),
            F.min("late").alias("late"),
            F.max("early").alias("early"),
        )
    )
    verdict = F.when(F.col("has_body"), PRESENT).when(F.col("accepted"), FOLDED).otherwise(DECLINED)
    why = F.coalesce("late", "early")
    only_declined = verdict == DECLINED
    return folded.select(
        *keys,
        verdict.alias("verdict"),
        F.when(only_declined, why["pass"]).otherwise("").alias("pass"),
        F.when(only_declined, why["reason"]).otherwise("").alias("reason"),
    )


def overall_verdicts(per_object: DataFrame) -> DataFrame:
    """One verdict per call; objects that disagree make it ``mixed``."""
    folded = per_object.groupBy(*PAIR).agg(
        F.min("verdict").alias("low"),
        F.max("verdict").alias("high"),
        F.min_by("reason", "object").alias("reason"),
    )
    agreed = F.col("low") == F.col("high")
    return folded.select(
        *PAIR,
        F.when(agreed, F.col("low")).otherwise(MIXED).alias("verdict"),
        F.when(agreed & (F.col("low") == DECLINED), F.col("reason")).otherwise("").alias("reason"),
    )


def explain_calls(facts: Facts) -> DataFrame:
    """The verdict on every call of the source view and every call with evidence."""
    evidence = overall_verdicts(per_object_verdicts(facts.inline_records, facts.inline_instances))
    edges = facts.call_edges
    calls = edges.filter(F.col("source") == common.CGRAPH).select(*PAIR)
    linked = (
        edges.filter(F.col("source") == common.OBJDUMP)
        .select(*PAIR)
        .distinct()
        .withColumn("linked_edge", F.lit(1))
    )
    universe = calls.unionByName(evidence.select(*PAIR)).distinct()
    return (
        universe.join(evidence, PAIR, "left")
        .join(facts.inline_decisions, PAIR, "left")
        .join(linked, PAIR, "left")
        .select(
            *PAIR,
            F.coalesce("verdict", F.lit(NO_DECISION)).alias("verdict"),
            F.coalesce("reason", F.lit("")).alias("reason"),
            F.col("inlined").cast("int").alias("cgraph_inlined"),
            F.coalesce("linked_edge", F.lit(0)).alias("linked_edge"),
        )
    )


def explain_call(
    facts: Facts, caller_usr: str | Column, callee_usr: str | Column, target: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(one overall row, per-object rows)`` for a single call."""
    a, b = common.value(caller_usr), common.value(callee_usr)

    def this_call(df: DataFrame) -> DataFrame:
        return df.filter((F.col("caller_usr") == a) & (F.col("callee_usr") == b))

    per_object = per_object_verdicts(this_call(facts.inline_records), this_call(facts.inline_instances))
    verdict = overall_verdicts(per_object).agg(
        F.coalesce(F.max("verdict"), F.lit(NO_DECISION)).alias("verdict"),
        F.coalesce(F.max("reason"), F.lit("")).alias("reason"),
    )
    cgraph = this_call(facts.inline_decisions).agg(F.max("inlined").alias("cgraph_inlined"))
    linked = this_call(facts.call_edges).filter(F.col("source") == common.OBJDUMP)
    if target is not None:
        linked = linked.filter(F.col("target") == target)
    overall = verdict.select(
        "verdict",
        "reason",
        cgraph.scalar().alias("cgraph_inlined"),
        (linked.agg(F.count(F.lit(1))).scalar() > 0).alias("linked_edge"),
    )
    return overall, per_object
