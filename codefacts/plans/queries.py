"""Registered queries over the seeded facts: one per operator.

Every query reads whole tables. A limit appears only where the operator itself
returns a page; the page order always ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts import schemas
from codefacts.facts import Facts
from codefacts.operators import (
    call_paths,
    callgraph,
    common,
    indirect,
    inlining,
    linkage,
    source_text,
    symbols,
    targets,
    types,
)
from codefacts.seed import Seed
from codefacts.session import tune

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TARGET = "NATION_1"
SYMBOL_QUERY = "hot gea"
TYPE_QUERY = "brand 1"
CONSTANT_QUERY = "ur"
TEXT_PATTERN = "ou"
TEXT_REGEX = "[aeé]ux"


_SEEDS: dict[tuple[str, str], Seed] = {}


def seed_for(spark: SparkSession, sf_dir: str) -> Seed:
    """One seed per application and directory, so tables are analysed once."""
    key = (spark.sparkContext.applicationId, str(sf_dir).rstrip("/"))
    if key not in _SEEDS:
        _SEEDS[key] = Seed(tune(spark), key[1])
    return _SEEDS[key]


def query(name: str):
    """Register a function of ``(facts, seed)`` under ``name``."""

    def add(fn: Callable[[Facts, Seed], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            seed = seed_for(spark, sf_dir)
            return fn(facts_of(seed), seed)

        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn

    return add


@lru_cache(maxsize=8)
def facts_of(seed: Seed) -> Facts:
    return seed.facts()


def flags(df: DataFrame, *names: str) -> DataFrame:
    """Booleans as 0/1, the form the SQL side compares."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def longs(df: DataFrame) -> DataFrame:
    """Integer columns widened to one type."""
    narrow = [f.name for f in df.schema.fields if f.dataType.typeName() in ("integer", "short", "boolean")]
    return flags(df, *narrow)


# -- tables -----------------------------------------------------------------


def _table_query(name: str, columns: list[str]):
    @query(f"table_{name}")
    def read(facts: Facts, seed: Seed) -> DataFrame:
        df = getattr(facts, name).select(*columns)
        if "column" in df.columns:
            df = df.withColumnRenamed("column", "col")
        return longs(df)


TABLE_COLUMNS = {
    "targets": ["name", "kind", "link_command"],
    "target_sources": ["target", "file"],
    "sources": ["path", "blob_hash", "is_generated"],
    "external_sources": ["abs_path", "blob_hash"],
    "generated_sources": ["builddir_rel", "blob_hash"],
    "symbols": ["usr", "name", "kind", "linkage", "signature", "address_taken"],
    "symbol_names": ["usr", "linkage_name"],
    "symbol_definitions": [
        "usr", "file", "line", "decl_file", "decl_line", "is_weak", "linkage_name",
    ],
    "types": ["usr", "name", "kind", "decl_file", "decl_line", "byte_size", "underlying"],
    "type_fields": ["type_usr", "name", "type", "ordinal", "byte_offset"],
    "enum_constants": ["usr", "type_usr", "name", "value"],
    "call_edges": ["caller_usr", "callee_usr", "source", "target"],
    "indirect_call_sites": [
        "site_id", "caller_usr", "file", "line", "column", "callee_type", "field_hint",
    ],
    "inline_decisions": ["caller_usr", "callee_usr", "inlined"],
    "inline_records": [
        "caller_usr", "callee_usr", "pass", "inlined", "reason", "file", "line", "column", "object",
    ],
    "inline_instances": [
        "callee_usr", "caller_usr", "parent_callee_usr", "depth", "file", "line", "column", "object",
    ],
    "icf_groups": ["winner_usr", "object_file"],
    "icf_group_members": ["winner_usr", "object_file", "loser_usr"],
    "link_resolutions": ["target", "usr", "winning_object", "linkage_kind", "archive"],
    "symbol_tokens": ["token", "usr"],
    "type_tokens": ["token", "usr"],
}
for _name, _columns in TABLE_COLUMNS.items():
    _table_query(_name, _columns)


@query("symbol_reachability")
def _reachability(facts: Facts, seed: Seed) -> DataFrame:
    return longs(facts.symbol_reachability)


@query("sources_blob_dedup")
def _blobs(facts: Facts, seed: Seed) -> DataFrame:
    return facts.blobs.select("hash", "size", F.sha2("content", 256).alias("content_hash"))


# -- call graph ---------------------------------------------------------------


@query("list_callers")
def _list_callers(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.CGRAPH, "callee_usr")
    return symbols.page(callgraph.list_callers(facts, usr), common.PAGE["callers"])


@query("list_callers_target")
def _list_callers_target(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.CGRAPH, "callee_usr")
    return symbols.page(callgraph.list_callers(facts, usr, TARGET), common.PAGE["callers"])


@query("list_callers_all")
def _list_callers_all(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.list_callers(facts, callgraph.busiest(facts, common.CGRAPH, "callee_usr"))


@query("list_callers_target_all")
def _list_callers_target_all(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.list_callers(facts, callgraph.busiest(facts, common.CGRAPH, "callee_usr"), TARGET)


@query("list_callers_targets_of_hits")
def _list_callers_hits(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.CGRAPH, "callee_usr")
    hits = symbols.page(callgraph.list_callers(facts, usr), common.PAGE["callers"])
    return common.targets_of(facts, hits)


@query("list_callees")
def _list_callees(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.CGRAPH, "caller_usr")
    return symbols.page(callgraph.list_callees(facts, usr), common.PAGE["callers"])


@query("list_callees_target")
def _list_callees_target(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.CGRAPH, "caller_usr")
    return symbols.page(callgraph.list_callees(facts, usr, TARGET), common.PAGE["callers"])


@query("list_callees_all")
def _list_callees_all(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.list_callees(facts, callgraph.busiest(facts, common.CGRAPH, "caller_usr"))


@query("list_callees_target_all")
def _list_callees_target_all(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.list_callees(facts, callgraph.busiest(facts, common.CGRAPH, "caller_usr"), TARGET)


@query("list_linked_callers")
def _linked_callers(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.OBJDUMP, "callee_usr")
    return callgraph.list_linked_callers(facts, usr, TARGET)


@query("list_linked_callees")
def _linked_callees(facts: Facts, seed: Seed) -> DataFrame:
    usr = callgraph.busiest(facts, common.OBJDUMP, "caller_usr")
    return callgraph.list_linked_callees(facts, usr, TARGET)


@query("neighbors_in")
def _neighbors_in(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.degree(facts, common.CGRAPH, "callee_usr")


@query("neighbors_out")
def _neighbors_out(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.degree(facts, common.CGRAPH, "caller_usr")


@query("plane_diff")
def _plane_diff(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph.plane_diff(facts)


def _path_ends(facts: Facts) -> tuple[str, str]:
    row = facts.symbols.limit(1).select(
        callgraph.busiest(facts, common.CGRAPH, "caller_usr").alias("a"),
        callgraph.busiest(facts, common.CGRAPH, "callee_usr").alias("b"),
    )
    ends = row.first()
    return ends["a"], ends["b"]


def joined_paths(paths: DataFrame) -> DataFrame:
    return paths.select(
        F.array_join("names", " -> ").alias("names"),
        F.array_join("usrs", " -> ").alias("usrs"),
        F.col("hops").cast("bigint").alias("hops"),
    )


@query("list_call_paths")
def _call_paths(facts: Facts, seed: Seed) -> DataFrame:
    a, b = _path_ends(facts)
    return joined_paths(call_paths.first_call_paths(facts, a, b))


@query("simple_paths")
def _simple_paths(facts: Facts, seed: Seed) -> DataFrame:
    """All simple paths of the usual depth, no page."""
    a, b = _path_ends(facts)
    return joined_paths(call_paths.list_call_paths(facts, a, b))


# -- symbols --------------------------------------------------------------------


@query("find_symbol_fts")
def _find_fts(facts: Facts, seed: Seed) -> DataFrame:
    return symbols.page(symbols.find_symbol(facts, SYMBOL_QUERY), common.PAGE["find_symbol"])


@query("find_symbol_fts_all")
def _find_fts_all(facts: Facts, seed: Seed) -> DataFrame:
    return symbols.find_symbol(facts, SYMBOL_QUERY)


@query("find_symbol_target")
def _find_target(facts: Facts, seed: Seed) -> DataFrame:
    hits = symbols.find_symbol(facts, SYMBOL_QUERY, kind="function", target=TARGET)
    return symbols.page(hits, common.PAGE["find_symbol"])


@query("find_symbol_target_all")
def _find_target_all(facts: Facts, seed: Seed) -> DataFrame:
    return symbols.find_symbol(facts, SYMBOL_QUERY, kind="function", target=TARGET)


def _clone_name(facts: Facts):
    clones = facts.symbol_names.filter(F.col("linkage_name").contains(".constprop"))
    return clones.agg(F.min("linkage_name")).scalar()


@query("find_symbol_exact")
def _find_exact(facts: Facts, seed: Seed) -> DataFrame:
    return symbols.find_symbol(facts, _clone_name(facts), exact=True)


def _multi_defined(facts: Facts):
    """The symbol with most definitions."""
    counts = facts.symbol_definitions.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "usr").limit(1).select("usr").scalar()


@query("describe_symbol")
def _describe_symbol(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbols.describe_symbol(facts, _multi_defined(facts)))


@query("describe_symbol_definitions")
def _describe_definitions(facts: Facts, seed: Seed) -> DataFrame:
    rows = symbols.definitions(facts, _multi_defined(facts))
    return longs(
        rows.select(
            "file", "line", "decl_file", "decl_line", "is_weak", "linkage_name",
            F.coalesce("blob_hash", F.lit("")).alias("blob_hash"),
            F.coalesce(F.col("snippet.start_line"), F.lit(0)).alias("start_line"),
            F.coalesce(F.col("snippet.end_line"), F.lit(0)).alias("end_line"),
            F.coalesce(F.col("snippet.text"), F.lit("")).alias("snippet"),
        )
    )


@query("location_snippets")
def _snippets(facts: Facts, seed: Seed) -> DataFrame:
    """The line window around every definition of every symbol."""
    rows = common.with_location(
        facts.symbol_definitions.select("file", "line").distinct(), facts, True
    )
    return longs(
        rows.select(
            "file", "line", "blob_hash",
            F.coalesce(F.col("snippet.start_line"), F.lit(0)).alias("start_line"),
            F.coalesce(F.col("snippet.end_line"), F.lit(0)).alias("end_line"),
            F.sha2(F.coalesce(F.col("snippet.text"), F.lit("")).cast("binary"), 256).alias("text_hash"),
        )
    )


def _most_linked(facts: Facts):
    counts = facts.link_losers.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "usr").limit(1).select("usr").scalar()


@query("describe_symbol_targets")
def _describe_targets(facts: Facts, seed: Seed) -> DataFrame:
    return symbols.symbol_targets(facts, _most_linked(facts))


@query("describe_symbol_resolutions")
def _describe_resolutions(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbols.resolutions(facts, _most_linked(facts)))


@query("targets_per_symbol")
def _targets_per_symbol(facts: Facts, seed: Seed) -> DataFrame:
    return facts.link_resolutions.groupBy("usr").agg(F.count(F.lit(1)).alias("n_targets"))


# -- targets ----------------------------------------------------------------------


@query("list_targets")
def _list_targets(facts: Facts, seed: Seed) -> DataFrame:
    return targets.list_targets(facts)


@query("describe_target")
def _describe_target(facts: Facts, seed: Seed) -> DataFrame:
    return targets.describe_target(facts, TARGET)


@query("describe_target_sources")
def _describe_target_sources(facts: Facts, seed: Seed) -> DataFrame:
    return targets.target_source_files(facts, TARGET)


@query("describe_target_archives")
def _describe_target_archives(facts: Facts, seed: Seed) -> DataFrame:
    return targets.target_archives(facts, TARGET)


# -- linkage ------------------------------------------------------------------------


@query("pick_winner")
def _pick_winner(facts: Facts, seed: Seed) -> DataFrame:
    from codefacts.operators import link_ingest

    return link_ingest.pick_winners(seed.object_candidates(), ["target", "usr"])


@query("collect_losers")
def _collect_losers(facts: Facts, seed: Seed) -> DataFrame:
    return facts.link_losers


@query("describe_link_resolution")
def _describe_link(facts: Facts, seed: Seed) -> DataFrame:
    usr = _most_linked(facts)
    target = (
        facts.link_losers.filter(F.col("usr") == usr).agg(F.min("target")).scalar()
    )
    return longs(linkage.describe_link_resolution(facts, usr, target))


@query("describe_link_losers")
def _describe_losers(facts: Facts, seed: Seed) -> DataFrame:
    usr = _most_linked(facts)
    target = facts.link_losers.filter(F.col("usr") == usr).agg(F.min("target")).scalar()
    return linkage.losing_objects(facts, usr, target)


@query("list_weak_symbols")
def _weak(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_weak_symbols(facts)


@query("list_weak_symbols_target")
def _weak_target(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_weak_symbols(facts, TARGET)


@query("list_weak_symbols_target_strict")
def _weak_strict(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_weak_symbols(facts, TARGET, strict=True)


@query("list_weak_definitions")
def _weak_defs(facts: Facts, seed: Seed) -> DataFrame:
    return longs(
        linkage.weak_definitions(facts, snippets=False).select("usr", "file", "line", "blob_hash")
    )


@query("list_undefined_symbols")
def _undefined(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_undefined_symbols(facts, TARGET)


@query("list_undefined_symbols_all_targets")
def _undefined_all(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_undefined_symbols(facts)


@query("list_icf_groups")
def _icf(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_icf_groups(facts).select("winner_usr", "winner", "object_file", "n_losers")


@query("list_icf_groups_target")
def _icf_target(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.list_icf_groups(facts, TARGET).select(
        "winner_usr", "winner", "object_file", "n_losers"
    )


@query("list_icf_losers")
def _icf_losers(facts: Facts, seed: Seed) -> DataFrame:
    return linkage.icf_losers(facts)


@query("list_unreachable_symbols")
def _unreachable(facts: Facts, seed: Seed) -> DataFrame:
    rows = linkage.list_unreachable_symbols(facts, TARGET)
    return longs(symbols.page(rows, common.PAGE["linkage_rows"]))


@query("list_unreachable_symbols_all")
def _unreachable_all(facts: Facts, seed: Seed) -> DataFrame:
    return longs(linkage.list_unreachable_symbols(facts, TARGET))


@query("list_unreachable_symbols_static")
def _unreachable_static(facts: Facts, seed: Seed) -> DataFrame:
    """A static library links nothing, so nothing is unreachable in it."""
    static = (
        facts.targets.filter(F.col("kind") == "static_library").agg(F.min("name")).scalar()
    )
    return longs(linkage.list_unreachable_symbols(facts, static))


@query("list_entry_points")
def _entry_points(facts: Facts, seed: Seed) -> DataFrame:
    rows = linkage.list_entry_points(facts, TARGET)
    page = rows.orderBy(F.desc("is_main"), "name", "usr").limit(common.PAGE["linkage_rows"])
    return longs(page)


@query("list_entry_points_all")
def _entry_points_all(facts: Facts, seed: Seed) -> DataFrame:
    return longs(linkage.list_entry_points(facts, TARGET))


# -- inlining -----------------------------------------------------------------------


def _most_inlined(facts: Facts, end: str):
    counts = facts.inline_records.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), end).limit(1).select(end).scalar()


@query("describe_inlining_summary")
def _inlining_summary(facts: Facts, seed: Seed) -> DataFrame:
    return longs(inlining.summary(facts, _most_inlined(facts, "caller_usr")))


@query("describe_inlining_records")
def _inlining_records(facts: Facts, seed: Seed) -> DataFrame:
    rows = inlining.records(facts, _most_inlined(facts, "caller_usr"))
    return longs(rows.withColumnRenamed("column", "col"))


@query("describe_inlining_instances")
def _inlining_instances(facts: Facts, seed: Seed) -> DataFrame:
    counts = facts.inline_instances.groupBy("caller_usr").agg(F.count(F.lit(1)).alias("n"))
    usr = counts.orderBy(F.desc("n"), "caller_usr").limit(1).select("caller_usr").scalar()
    return longs(inlining.instances(facts, usr).withColumnRenamed("column", "col"))


@query("describe_inlining_decisions")
def _inlining_decisions(facts: Facts, seed: Seed) -> DataFrame:
    return longs(inlining.decisions(facts, _most_inlined(facts, "caller_usr")))


@query("list_inline_instances")
def _list_inline_instances(facts: Facts, seed: Seed) -> DataFrame:
    counts = facts.inline_instances.groupBy("callee_usr").agg(F.count(F.lit(1)).alias("n"))
    usr = counts.orderBy(F.desc("n"), "callee_usr").limit(1).select("callee_usr").scalar()
    rows = inlining.instances(facts, usr, "callee_usr")
    return longs(rows.withColumnRenamed("column", "col"))


@query("inline_summary_all")
def _inline_summary_all(facts: Facts, seed: Seed) -> DataFrame:
    return longs(
        facts.inline_records.groupBy("caller_usr", "pass", "inlined").agg(F.count(F.lit(1)).alias("n"))
    )


@query("explain_call_per_object")
def _explain_per_object(facts: Facts, seed: Seed) -> DataFrame:
    return inlining.per_object_verdicts(facts.inline_records, facts.inline_instances)


@query("explain_call_overall")
def _explain_overall(facts: Facts, seed: Seed) -> DataFrame:
    return longs(inlining.explain_calls(facts))


# -- indirect calls and types ----------------------------------------------------------


@query("list_indirect_call_sites")
def _indirect_sites(facts: Facts, seed: Seed) -> DataFrame:
    rows = indirect.list_indirect_call_sites(facts)
    return longs(rows.withColumnRenamed("column", "col"))


@query("list_indirect_call_sites_target")
def _indirect_sites_target(facts: Facts, seed: Seed) -> DataFrame:
    rows = indirect.list_indirect_call_sites(facts, callee_type="int (int, int)", target=TARGET)
    page = rows.orderBy("file", "line", "column", "site_id").limit(common.PAGE["indirect_sites"])
    return longs(page.withColumnRenamed("column", "col"))


@query("list_indirect_call_sites_target_all")
def _indirect_sites_target_all(facts: Facts, seed: Seed) -> DataFrame:
    rows = indirect.list_indirect_call_sites(facts, callee_type="int (int, int)", target=TARGET)
    return longs(rows.withColumnRenamed("column", "col"))


@query("list_address_taken_functions")
def _address_taken(facts: Facts, seed: Seed) -> DataFrame:
    return indirect.list_address_taken_functions(facts)


@query("list_address_taken_functions_typed")
def _address_taken_typed(facts: Facts, seed: Seed) -> DataFrame:
    return indirect.list_address_taken_functions(facts, "int (int, int)", TARGET)


def _site(facts: Facts, typed: bool):
    known = F.col("callee_type") != ""
    return facts.indirect_call_sites.filter(known if typed else ~known).agg(F.min("site_id")).scalar()


@query("resolve_indirect_call")
def _resolve_typed(facts: Facts, seed: Seed) -> DataFrame:
    return indirect.resolve_indirect_call(facts, _site(facts, True))


@query("resolve_indirect_call_untyped")
def _resolve_untyped(facts: Facts, seed: Seed) -> DataFrame:
    return indirect.resolve_indirect_call(facts, _site(facts, False))


@query("resolve_indirect_call_counts")
def _resolve_counts(facts: Facts, seed: Seed) -> DataFrame:
    return longs(indirect.candidate_counts(facts))


@query("find_type")
def _find_type(facts: Facts, seed: Seed) -> DataFrame:
    rows = types.find_type(facts, TYPE_QUERY)
    page = rows.orderBy("ord", "name", "usr").limit(common.PAGE["find_type"])
    return longs(page)


@query("find_type_all")
def _find_type_all(facts: Facts, seed: Seed) -> DataFrame:
    return longs(types.find_type(facts, TYPE_QUERY))


@query("find_type_constants")
def _find_constants(facts: Facts, seed: Seed) -> DataFrame:
    return longs(types.find_type(facts, CONSTANT_QUERY, kind=types.ENUM_CONSTANT))


@query("find_type_exact")
def _find_type_exact(facts: Facts, seed: Seed) -> DataFrame:
    return longs(types.find_type(facts, "event_type", exact=True))


def _widest_type(facts: Facts):
    counts = facts.type_fields.groupBy("type_usr").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "type_usr").limit(1).select("type_usr").scalar()


@query("describe_type")
def _describe_type(facts: Facts, seed: Seed) -> DataFrame:
    return longs(types.describe_type(facts, _widest_type(facts)))


@query("describe_type_fields")
def _describe_fields(facts: Facts, seed: Seed) -> DataFrame:
    return longs(types.fields(facts, _widest_type(facts)))


@query("describe_type_constants")
def _describe_constants(facts: Facts, seed: Seed) -> DataFrame:
    usr = facts.types.filter(F.col("kind") == "enum").agg(F.min("usr")).scalar()
    return types.constants(facts, usr)


# -- sources ---------------------------------------------------------------------------


@query("list_source_files")
def _source_files(facts: Facts, seed: Seed) -> DataFrame:
    return longs(source_text.list_source_files(facts, include_external=True))


@query("list_source_files_headers")
def _source_files_headers(facts: Facts, seed: Seed) -> DataFrame:
    return longs(source_text.list_source_files(facts, kind="header"))


@query("list_source_files_target")
def _source_files_target(facts: Facts, seed: Seed) -> DataFrame:
    return longs(source_text.list_source_files(facts, target=TARGET))


@query("list_source_files_membership")
def _source_membership(facts: Facts, seed: Seed) -> DataFrame:
    return source_text.file_targets(facts)


@query("read_source")
def _read_source(facts: Facts, seed: Seed) -> DataFrame:
    path = facts.sources.agg(F.max("path")).scalar()
    return longs(source_text.read_source(facts, path, 2, 5))


@query("read_source_slice")
def _read_slice(facts: Facts, seed: Seed) -> DataFrame:
    """Lines 2 to 5 of every project source."""
    located = facts.sources.select("path", "blob_hash")
    rows = source_text.slice_files(facts, located, 2, 5)
    return longs(
        rows.select("path", "line_count", F.sha2(F.col("content").cast("binary"), 256).alias("text_hash"))
    )


@query("verify_source")
def _verify_source(facts: Facts, seed: Seed) -> DataFrame:
    path = facts.sources.agg(F.max("path")).scalar()
    digest = facts.sources.agg(F.upper(F.max_by("blob_hash", "path"))).scalar()
    return longs(source_text.verify_source(facts, path, digest))


@query("verify_source_live")
def _verify_live(facts: Facts, seed: Seed) -> DataFrame:
    path = facts.sources.agg(F.max("path")).scalar()
    return longs(source_text.verify_live(facts, path, seed.live_files()))


@query("list_source_drift")
def _drift(facts: Facts, seed: Seed) -> DataFrame:
    return longs(source_text.list_source_drift(facts, seed.live_files()))


@query("list_source_drift_target")
def _drift_target(facts: Facts, seed: Seed) -> DataFrame:
    return longs(source_text.list_source_drift(facts, seed.live_files(), target=TARGET))


@query("search_source_matches")
def _search_matches(facts: Facts, seed: Seed) -> DataFrame:
    """Every match in every indexed file."""
    rows = source_text.search_matches(facts, TEXT_PATTERN, include_external=True)
    return longs(rows.select("table_ord", "path", "line", F.col("column").alias("col")))


@query("search_source_page")
def _search_page(facts: Facts, seed: Seed) -> DataFrame:
    rows = source_text.search_matches(facts, TEXT_PATTERN)
    page = rows.orderBy("table_ord", "path", "line", "column").limit(common.PAGE["search_source"])
    shown = source_text.with_context(facts, page, 1)
    return longs(
        shown.select(
            "path", "line", F.col("column").alias("col"),
            F.sha2(F.col("snippet.text").cast("binary"), 256).alias("snippet_hash"),
        )
    )


@query("search_source_regex")
def _search_regex(facts: Facts, seed: Seed) -> DataFrame:
    rows = source_text.search_matches(facts, TEXT_REGEX, regex=True)
    return longs(rows.groupBy("path", "line", "match_text").agg(F.count(F.lit(1)).alias("n")))


@query("search_source_by_file")
def _search_by_file(facts: Facts, seed: Seed) -> DataFrame:
    by_file = source_text.search_by_file(facts, TEXT_PATTERN)
    return source_text.top_counts(by_file, "path", common.PAGE["search_top"])


@query("search_source_by_dir")
def _search_by_dir(facts: Facts, seed: Seed) -> DataFrame:
    by_file = source_text.search_by_file(facts, TEXT_PATTERN)
    return source_text.top_counts(source_text.search_by_directory(by_file), "directory", common.PAGE["search_top"])


@query("search_source_by_file_all")
def _search_by_file_all(facts: Facts, seed: Seed) -> DataFrame:
    return source_text.search_by_file(facts, TEXT_PATTERN)


@query("search_source_by_dir_all")
def _search_by_dir_all(facts: Facts, seed: Seed) -> DataFrame:
    return source_text.search_by_directory(source_text.search_by_file(facts, TEXT_PATTERN))


@query("search_source_summary")
def _search_summary(facts: Facts, seed: Seed) -> DataFrame:
    by_file = source_text.search_by_file(facts, TEXT_PATTERN)
    return source_text.search_summary(by_file, source_text.files(facts))


# -- schema ------------------------------------------------------------------------------


def _recipe_parameters(facts: Facts, name: str) -> dict[str, str]:
    """One value per parameter, chosen inside the data."""

    def one(df: DataFrame) -> str:
        return df.first()[0]

    def busiest(plane: str) -> str:
        edges = facts.call_edges.filter(F.col("source") == plane)
        top = edges.groupBy("callee_usr").agg(F.count(F.lit(1)).alias("n"))
        return one(top.orderBy(F.desc("n"), "callee_usr").select("callee_usr"))

    match name:
        case "symbol_by_name":
            clones = facts.symbol_names.filter(F.col("linkage_name").contains(".constprop"))
            return {"name": one(clones.agg(F.min("linkage_name")))}
        case "definitions" | "external_declaration":
            top = facts.symbol_definitions.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))
            return {"usr": one(top.orderBy(F.desc("n"), "usr").select("usr"))}
        case "source_callers":
            return {"usr": busiest(common.CGRAPH)}
        case "runtime_callers":
            return {"usr": busiest(common.OBJDUMP)}
        case "call_decisions":
            top = facts.inline_records.groupBy("caller_usr", "callee_usr").agg(F.count(F.lit(1)).alias("n"))
            row = top.orderBy(F.desc("n"), "caller_usr", "callee_usr").first()
            return {"caller_usr": row["caller_usr"], "callee_usr": row["callee_usr"]}
        case "inlined_into":
            top = facts.inline_instances.groupBy("callee_usr").agg(F.count(F.lit(1)).alias("n"))
            return {"usr": one(top.orderBy(F.desc("n"), "callee_usr").select("callee_usr"))}
        case "source_blob":
            return {"path": one(facts.sources.agg(F.max("path")))}
        case "reachability":
            top = facts.link_resolutions.groupBy("usr").agg(F.count(F.lit(1)).alias("n"))
            return {"usr": one(top.orderBy(F.desc("n"), "usr").select("usr"))}
        case "link_winner":
            row = facts.link_resolutions.agg(F.min(F.struct("usr", "target")).alias("k")).first()["k"]
            return {"usr": row["usr"], "target": row["target"]}
        case "generated_file":
            return {"builddir_rel": one(facts.generated_sources.agg(F.max("builddir_rel")))}
    raise KeyError(name)


def _recipe_query(name: str, sql: str):
    @query(f"recipe_{name}")
    def run(facts: Facts, seed: Seed) -> DataFrame:
        facts.register_views()
        return longs(facts.spark.sql(sql, args=_recipe_parameters(facts, name)))


for _name, (_purpose, _sql) in schemas.RECIPES.items():
    _recipe_query(_name, _sql)
