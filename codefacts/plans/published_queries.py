"""Registered queries over a published snapshot: stored copies, line offsets, trigrams, raw SQL.

The facts of a data directory are published once per application; every query
then reads the snapshot as a user of it would, by literal values, so that the
layout can be skipped by.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import call_paths, callgraph, common, inlining, source_text, symbols, types
from codefacts.plans import snapshot, sql_query
from codefacts.plans.queries import TARGET, TEXT_REGEX, facts_of, joined_paths, longs, query
from codefacts.seed import Seed
from codefacts.session import ensure_checkpoint_dir

#: A literal of several trigrams, and a statement over the snapshot's tables.
TEXT_LITERAL = "ment la"
STATEMENT = """
SELECT s.kind, e.source, count(*) AS n, count(DISTINCT e.target_id) AS n_targets
FROM call_edges e JOIN symbols s ON s.id = e.callee_id
WHERE EXISTS (SELECT 1 FROM symbol_names n WHERE n.usr = s.usr)
GROUP BY s.kind, e.source
"""


@lru_cache(maxsize=8)
def published_of(seed: Seed) -> snapshot.Snapshot:
    root = f"{ensure_checkpoint_dir(seed.spark)}/codefacts-published-{uuid.uuid4().hex}"
    snapshot.publish(facts_of(seed), root)
    return snapshot.open_snapshot(seed.spark, root)


def published_query(name: str):
    """Register a function of the snapshot's facts under ``published_`` and ``name``."""

    def add(fn: Callable[[Facts], DataFrame]):
        def run(facts: Facts, seed: Seed) -> DataFrame:
            return longs(fn(published_of(seed).facts))

        run.__doc__ = fn.__doc__
        query(f"published_{name}")(run)
        return fn

    return add


def _busiest(facts: Facts, plane: str, end: str) -> str:
    top = callgraph.degree(facts, plane, end).orderBy(F.desc("n"), "usr")
    return top.first()["usr"]


def _most(df: DataFrame, *keys: str):
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), *keys).first()


@published_query("list_callers")
def _list_callers(facts: Facts) -> DataFrame:
    return callgraph.list_callers(facts, _busiest(facts, common.CGRAPH, "callee_usr"))


@published_query("list_callers_target")
def _list_callers_target(facts: Facts) -> DataFrame:
    return callgraph.list_callers(facts, _busiest(facts, common.CGRAPH, "callee_usr"), TARGET)


@published_query("list_linked_callers")
def _list_linked_callers(facts: Facts) -> DataFrame:
    return callgraph.list_linked_callers(facts, _busiest(facts, common.OBJDUMP, "callee_usr"), TARGET)


@published_query("list_inline_instances")
def _list_inline_instances(facts: Facts) -> DataFrame:
    usr = _most(facts.inline_instances, "callee_usr")["callee_usr"]
    rows = inlining.instances(facts, usr, "callee_usr").withColumnRenamed("column", "col")
    ids = ("caller_id", "callee_id", "parent_callee_id")
    return rows.drop(*ids)


@published_query("in_target")
def _in_target(facts: Facts) -> DataFrame:
    """Every symbol that the link kept in one target."""
    return common.in_target(common.symbol_ref(facts), facts, TARGET)


@published_query("find_symbol_exact")
def _find_symbol_exact(facts: Facts) -> DataFrame:
    name = facts.symbol_names.filter(F.col("linkage_name").contains(".constprop")).agg(F.min("linkage_name")).first()[0]
    return symbols.find_symbol(facts, name, exact=True)


@published_query("describe_type")
def _describe_type(facts: Facts) -> DataFrame:
    """Fields of the widest type."""
    return types.fields(facts, _most(facts.type_fields, "type_usr")["type_usr"])


@published_query("explain_call")
def _explain_call(facts: Facts) -> DataFrame:
    """One call, its binary evidence from one target only."""
    pair = _most(facts.inline_records, "caller_usr", "callee_usr")
    return inlining.explain_call(facts, pair["caller_usr"], pair["callee_usr"], TARGET)[0]


@published_query("list_call_paths")
def _list_call_paths(facts: Facts) -> DataFrame:
    """The first paths from the busiest caller to the busiest callee."""
    ends = (_busiest(facts, common.CGRAPH, end) for end in ("caller_usr", "callee_usr"))
    return joined_paths(call_paths.first_call_paths(facts, *ends))


@published_query("location_snippets")
def _location_snippets(facts: Facts) -> DataFrame:
    rows = common.with_location(facts.symbol_definitions.select("file", "line").distinct(), facts, True)
    return rows.select(
        "file", "line", "blob_hash",
        F.coalesce(F.col("snippet.start_line"), F.lit(0)).alias("start_line"),
        F.coalesce(F.col("snippet.end_line"), F.lit(0)).alias("end_line"),
        F.sha2(F.coalesce(F.col("snippet.text"), F.lit("")).cast("binary"), 256).alias("text_hash"),
    )


@published_query("search_source")
def _search_source(facts: Facts) -> DataFrame:
    """Every match of a literal in the project's own files, with a line of context on each side."""
    wanted = source_text.files(facts)
    found = source_text.file_matches(source_text.blob_matches(facts, TEXT_LITERAL, wanted=wanted), wanted)
    shown = source_text.with_context(facts, found, 1)
    return shown.select(
        "path", "line", F.col("column").alias("col"), F.sha2(F.col("snippet.text").cast("binary"), 256).alias("snippet_hash")
    )


@published_query("search_source_regex")
def _search_source_regex(facts: Facts) -> DataFrame:
    """Every match of a regular expression with its byte column."""
    wanted = source_text.files(facts)
    found = source_text.file_matches(source_text.blob_matches(facts, TEXT_REGEX, True, wanted), wanted)
    return found.select("path", "line", F.col("column").alias("col"), "match_text")


@query("published_sql_query")
def _sql_query(facts: Facts, seed: Seed) -> DataFrame:
    """A guarded statement over the snapshot's tables and their ids."""
    return longs(sql_query.sql_frame(published_of(seed), STATEMENT))
