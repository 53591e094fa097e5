"""One-hop neighbours in the compiler view and in the linked view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import common


def _neighbours(
    facts: Facts,
    plane: str,
    anchor: str,
    far: str,
    usr: str | Column,
    edge_target: str | Column | None,
) -> DataFrame:
    edges = facts.by("call_edges", anchor).filter(
        (F.col("source") == plane) & (F.col(anchor) == common.value(usr))
    )
    if edge_target is not None:
        edges = edges.filter(F.col("target") == common.value(edge_target))
    ends = edges.select(F.col(far).alias("usr")).distinct()
    return common.symbol_ref(facts).join(ends, "usr", "left_semi")


def list_callers(facts: Facts, callee_usr: str | Column, target: str | Column | None = None) -> DataFrame:
    """Callers the compiler recorded; ``target`` keeps callers linked into it."""
    rows = _neighbours(facts, common.CGRAPH, "callee_usr", "caller_usr", callee_usr, None)
    return rows if target is None else common.in_target(rows, facts, target)


def list_callees(facts: Facts, caller_usr: str | Column, target: str | Column | None = None) -> DataFrame:
    rows = _neighbours(facts, common.CGRAPH, "caller_usr", "callee_usr", caller_usr, None)
    return rows if target is None else common.in_target(rows, facts, target)


def list_linked_callers(facts: Facts, callee_usr: str | Column, target: str | Column) -> DataFrame:
    """Callers whose call instruction is in the linked binary of ``target``."""
    return _neighbours(facts, common.OBJDUMP, "callee_usr", "caller_usr", callee_usr, target)


def list_linked_callees(facts: Facts, caller_usr: str | Column, target: str | Column) -> DataFrame:
    return _neighbours(facts, common.OBJDUMP, "caller_usr", "callee_usr", caller_usr, target)


def plane_diff(facts: Facts) -> DataFrame:
    """Calls in the source view with no counterpart in any binary: inlined or removed."""
    edges = facts.call_edges
    source = edges.filter(F.col("source") == common.CGRAPH).select("caller_usr", "callee_usr")
    linked = edges.filter(F.col("source") == common.OBJDUMP).select("caller_usr", "callee_usr")
    return source.join(linked, ["caller_usr", "callee_usr"], "left_anti").distinct()


def degree(facts: Facts, plane: str, end: str) -> DataFrame:
    """Distinct neighbours per symbol on one end of a plane's edges."""
    far = "callee_usr" if end == "caller_usr" else "caller_usr"
    pairs = facts.call_edges.filter(F.col("source") == plane).select(end, far).distinct()
    return pairs.groupBy(F.col(end).alias("usr")).agg(F.count(F.lit(1)).alias("n"))


def busiest(facts: Facts, plane: str, end: str) -> Column:
    """The symbol with most neighbours, ties to the least identity."""
    top = degree(facts, plane, end).orderBy(F.desc("n"), "usr").limit(1)
    return top.select("usr").scalar()
