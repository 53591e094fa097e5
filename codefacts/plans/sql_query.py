"""Read-only SQL over a snapshot.

Spark's own parser gives the plan; only query nodes over the snapshot's tables
pass, anything else is refused before it is analysed.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.operators import common
from codefacts.plans.snapshot import Snapshot

TIMEOUT_SECONDS = 30
# Plan nodes a query may consist of, and functions that reach
# outside the data.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "UnresolvedRelation", "SubqueryAlias", "Join", "LateralJoin", "Sort",
    "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Except", "Intersect", "UnresolvedWith",
    "UnresolvedHaving", "OneRowRelation", "Generate", "UnresolvedInlineTable", "LocalRelation",
    "WithWindowDefinition", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "Pivot",
    "Unpivot", "Sample", "UnresolvedTableSubqueryColumnAliases", "UnresolvedTVFAliases", "CTERelationRef",
    "UnresolvedTransposeRelation", "Window",
}
SUBQUERY_EXPRESSIONS = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"}
FORBIDDEN_FUNCTIONS = ("reflect", "java_method", "try_reflect", "input_file_name", "raise_error")


class SqlRefused(Exception):
    """The statement is not a read-only query over the snapshot."""


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _check(plan, tables: set[str]) -> None:
    name = plan.nodeName()
    simple = plan.getClass().getSimpleName()
    if simple not in QUERY_NODES:
        raise SqlRefused(f"only queries are allowed, not {simple or name}")
    known = set(tables)
    if simple == "UnresolvedWith":
        for pair in _items(plan.cteRelations()):
            known.add(pair.productElement(0).lower())
        for pair in _items(plan.cteRelations()):
            _check(pair.productElement(1), known)
    if simple == "UnresolvedRelation":
        parts = [str(p).lower() for p in _items(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in known:
            raise SqlRefused(f"unknown table {'.'.join(parts)}; known: {', '.join(sorted(tables))}")
    for expression in _items(plan.expressions()):
        _check_expression(expression, known)
    for child in _items(plan.children()):
        _check(child, known)


def _check_expression(expression, tables: set[str]) -> None:
    simple = expression.getClass().getSimpleName()
    if simple == "UnresolvedFunction":
        function = [str(p).lower() for p in _items(expression.nameParts())]
        if len(function) != 1 or function[0] in FORBIDDEN_FUNCTIONS:
            raise SqlRefused(f"function {'.'.join(function)} is not allowed")
    if simple in SUBQUERY_EXPRESSIONS:
        _check(expression.plan(), tables)
    for child in _items(expression.children()):
        _check_expression(child, tables)


def tables_of(snapshot: Snapshot) -> set[str]:
    return {*snapshot.facts.names, "symbol_reachability"}


def guarded(snapshot: Snapshot, sql: str, params=None) -> DataFrame:
    """The query as a DataFrame; raises :class:`SqlRefused` for anything else."""
    session = snapshot.facts.spark
    try:
        plan = session._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise SqlRefused(f"cannot parse: {str(error).splitlines()[0]}") from error
    _check(plan, tables_of(snapshot))
    snapshot.facts.register_views()
    reach = _reachability_with_ids(snapshot)
    if reach is not None:
        reach.createOrReplaceTempView("symbol_reachability")
    return session.sql(sql, args=params) if params else session.sql(sql)


def _reachability_with_ids(snapshot: Snapshot) -> DataFrame | None:
    facts = snapshot.facts
    if not {"symbols", "link_resolutions"} <= set(facts.names) or "id" not in facts.symbols.columns:
        return None
    ids = facts.symbols.select("usr", F.col("id").alias("symbol_id"))
    return facts.link_resolutions.join(ids, "usr").select(
        "target_id", "symbol_id", "target", "usr", F.lit(1).alias("reachable"), F.lit(1).alias("section_kept")
    )


def _shown(df: DataFrame) -> DataFrame:
    """Binary columns as text where they are text, else as a size note."""
    binary = [f.name for f in df.schema.fields if f.dataType.typeName() == "binary"]
    note = lambda c: F.concat(F.lit("<blob:"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    return df.withColumns(
        {
            c: F.when(F.is_valid_utf8(F.col(c).cast("string")), F.col(c).cast("string")).otherwise(note(F.col(c)))
            for c in binary
        }
    )


def row_limit(limit: int | None) -> int:
    """Rows that come to the driver: as many as asked for, or the usual page."""
    return common.PAGE["sql_rows"] if limit is None else common.page_size(limit)


def sql_frame(snapshot: Snapshot, sql: str, params=None) -> DataFrame:
    """All rows of one read-only query, as a DataFrame that nothing cuts or cancels."""
    return _shown(guarded(snapshot, sql, params))


def sql_query(
    snapshot: Snapshot, sql: str, params=None, limit: int | None = None, timeout: float = TIMEOUT_SECONDS
) -> dict:
    """Rows of one read-only query, at most ``limit``, cancelled after ``timeout`` seconds."""
    n = row_limit(limit)
    df = sql_frame(snapshot, sql, params)
    session = snapshot.facts.spark
    tag = f"codefacts-sql-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout, lambda: session.interruptTag(tag))
    timer.daemon = True
    session.addTag(tag)
    timer.start()
    try:
        rows = df.limit(n + 1).collect()
    finally:
        timer.cancel()
        session.removeTag(tag)
    return {
        "columns": df.columns,
        "rows": [list(r) for r in rows[:n]],
        "rowcount": min(len(rows), n),
        "truncated": len(rows) > n,
    }
