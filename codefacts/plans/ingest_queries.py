"""Registered queries of the collection side: readers and fact resolution."""

from __future__ import annotations

import uuid
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import paths
from codefacts.operators import (
    build_ingest,
    debug_ingest,
    ids,
    link_ingest,
    source_ingest,
    symbol_ingest,
)
from codefacts.plans import snapshot
from codefacts.plans.queries import facts_of, longs, query
from codefacts.seed import Seed
from codefacts.seed_dumps import BUILD_DIR, PROJECT_ROOT, Dumps
from codefacts.session import ensure_checkpoint_dir, store
from codefacts.sources import (
    build_description,
    build_tree,
    callgraph_info,
    debug_info,
    dependency_log,
    disassembly,
    dump_source,
    folding_dump,
    inline_dump,
    linker_map,
    optimization_record,
    symbol_listing,
    symbol_table_dump,
)

INCLUDE_PATTERNS = ("/usr/include/**", "/opt/vendor/*.h")


@lru_cache(maxsize=8)
def dumps_of(seed: Seed) -> Dumps:
    return Dumps(seed)


class Compiled:
    """The compiler-plane chain over the derived rows, each step built once.

    As in collection, what several later steps read is stored once: the
    observations and the identities they resolve to.
    """

    def __init__(self, seed: Seed):
        self.dumps = dumps_of(seed)
        self.nodes = self.dumps.cgraph_nodes()

    @cached_property
    def titles(self) -> DataFrame:
        """Each object's source, stored: joins then know that it is a row per object and need not shuffle what meets it."""
        spot = paths.resolve(F.col("title"), BUILD_DIR, PROJECT_ROOT)
        return store(self.dumps.titles().select("object", spot["rel"].alias("rel"), spot["in_project"].alias("in_project")))

    @cached_property
    def sources(self) -> DataFrame:
        return symbol_ingest.object_sources(self.titles)

    @cached_property
    def units(self) -> DataFrame:
        """Identity scoping takes the path as resolved, in the project or not."""
        return self.titles.select("object", F.col("rel").alias("source"))

    @cached_property
    def observing(self) -> DataFrame:
        """Computed from the rows each time, for the queries about these steps."""
        return symbol_ingest.observe(self.nodes, self.dumps.ci_nodes(), self.units)

    @cached_property
    def cloning(self) -> DataFrame:
        return symbol_ingest.attribute_clones(self.nodes, self.observing)

    @cached_property
    def observed(self) -> DataFrame:
        return store(self.observing)

    @cached_property
    def clones(self) -> DataFrame:
        return symbol_ingest.attribute_clones(self.nodes, self.observed)

    @cached_property
    def identities(self) -> DataFrame:
        return symbol_ingest.local_identities(self.observed, self.clones)

    @cached_property
    def calls(self) -> DataFrame:
        return symbol_ingest.resolve_ends(self.dumps.cgraph_calls(), self.identities)

    @cached_property
    def records(self) -> DataFrame:
        return symbol_ingest.inline_records(self.dumps.records(), self.identities)

    @cached_property
    def folds(self) -> DataFrame:
        return symbol_ingest.icf_members(self.dumps.folds(), self.nodes, self.identities)

    @cached_property
    def symbols(self) -> DataFrame:
        return symbol_ingest.merge_symbols(self.observed, self.clones)


@lru_cache(maxsize=8)
def compiled_of(seed: Seed) -> Compiled:
    return Compiled(seed)


# -- readers -------------------------------------------------------------------


@query("scan_cgraph")
def _scan_cgraph(facts: Facts, seed: Seed) -> DataFrame:
    nodes = symbol_table_dump.nodes(dumps_of(seed).cgraph_lines())
    return longs(nodes.withColumn("visibility", F.array_join("visibility", " ")))


@query("scan_cgraph_calls")
def _scan_cgraph_calls(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbol_table_dump.calls(dumps_of(seed).cgraph_lines()))


@query("scan_ci")
def _scan_ci(facts: Facts, seed: Seed) -> DataFrame:
    return longs(callgraph_info.nodes(dumps_of(seed).ci_lines()))


@query("scan_ci_titles")
def _scan_ci_titles(facts: Facts, seed: Seed) -> DataFrame:
    return callgraph_info.titles(dumps_of(seed).ci_lines())


@query("scan_datasource_ci")
def _scan_datasource(facts: Facts, seed: Seed) -> DataFrame:
    """The call-graph dumps written as files and read through the data source of their own."""
    spark = facts.spark
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dumps-{uuid.uuid4().hex}"
    written = dumps_of(seed).ci_lines().repartition("file").sortWithinPartitions("file", "block", "pos")
    written.select("file", "line").write.partitionBy("file").text(root)
    dump_source.register(spark)
    lines = spark.read.format(dump_source.NAME).option("pattern", "part-*").load(root)
    named = F.url_decode(F.regexp_extract("file", r"/file=([^/]+)/[^/]*$", 1))
    return longs(callgraph_info.nodes(lines.withColumn("file", named)))


@query("scan_icf")
def _scan_icf(facts: Facts, seed: Seed) -> DataFrame:
    return folding_dump.members(dumps_of(seed).icf_lines())


@query("scan_inline_dump")
def _scan_inline(facts: Facts, seed: Seed) -> DataFrame:
    return inline_dump.inlined_callees(dumps_of(seed).inline_lines())


@query("scan_optrecord")
def _scan_optrecord(facts: Facts, seed: Seed) -> DataFrame:
    rows = optimization_record.records(dumps_of(seed).record_documents())
    return longs(rows.withColumnRenamed("column", "col"))


@query("scan_nm")
def _scan_nm(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbol_listing.symbols(dumps_of(seed).nm_lines()).drop("block", "pos"))


@query("scan_object_defs")
def _scan_object_defs(facts: Facts, seed: Seed) -> DataFrame:
    return symbol_listing.object_defs(symbol_listing.symbols(dumps_of(seed).nm_lines()))


@query("scan_objdump")
def _scan_objdump(facts: Facts, seed: Seed) -> DataFrame:
    return disassembly.direct_calls(dumps_of(seed).objdump_lines())


@query("scan_map")
def _scan_map(facts: Facts, seed: Seed) -> DataFrame:
    return linker_map.origins(dumps_of(seed).map_lines())


@query("scan_map_pulls")
def _scan_map_pulls(facts: Facts, seed: Seed) -> DataFrame:
    return linker_map.archive_pulls(dumps_of(seed).map_lines())


@lru_cache(maxsize=8)
def debug_entries_of(seed: Seed) -> DataFrame:
    return store(debug_info.with_parents(debug_info.entries(dumps_of(seed).dwarf_lines())))


@lru_cache(maxsize=8)
def debug_types_of(seed: Seed) -> DataFrame:
    return store(debug_info.render_types(debug_entries_of(seed)))


@query("scan_dwarf")
def _scan_dwarf(facts: Facts, seed: Seed) -> DataFrame:
    """Functions as the entries describe them, without their signatures."""
    found = debug_info.subprograms(debug_entries_of(seed), debug_types_of(seed))
    return longs(found.select("file", "name", "decl_file", "decl_line", "definition", "declaration", "abstract_inline"))


@query("dwarf_signature")
def _dwarf_signature(facts: Facts, seed: Seed) -> DataFrame:
    found = debug_info.subprograms(debug_entries_of(seed), debug_types_of(seed))
    return found.select("file", "name", "signature")


@query("scan_dwarf_inlined")
def _scan_dwarf_inlined(facts: Facts, seed: Seed) -> DataFrame:
    found = debug_info.inline_instances(debug_entries_of(seed))
    return longs(found.select("file", "callee", "caller", "parent_callee", "depth", "line"))


@query("scan_dwarf_types")
def _scan_dwarf_types(facts: Facts, seed: Seed) -> DataFrame:
    found = debug_info.type_records(debug_entries_of(seed), debug_types_of(seed))
    return longs(found.select("file", "name", "kind", "decl_file", "decl_line", "underlying"))


@lru_cache(maxsize=8)
def debug_details_of(seed: Seed) -> tuple[DataFrame, DataFrame]:
    """Entries and rendered types of the records, enums and calling functions, by what call targets are made of."""
    lines = dumps_of(seed).dwarf_details()
    entries = store(debug_info.with_parents(debug_info.entries(lines, debug_info.CALL_ATTRIBUTES)))
    return entries, store(debug_info.render_types(entries))


@lru_cache(maxsize=8)
def debug_layouts_of(seed: Seed) -> tuple[DataFrame, DataFrame]:
    """Entries and rendered types of the same, by what lays out types: each entry is stored once, without what only calls have."""
    lines = dumps_of(seed).dwarf_details()
    entries = debug_info.with_parents(debug_info.entries(lines, debug_info.TYPE_ATTRIBUTES))
    return entries, store(debug_info.render_types(entries))


@lru_cache(maxsize=8)
def _detail_types(seed: Seed) -> DataFrame:
    """Records and enums, stored: they are few beside their members and constants."""
    return store(debug_info.type_records(*debug_layouts_of(seed)))


@query("scan_dwarf_records")
def _scan_dwarf_records(facts: Facts, seed: Seed) -> DataFrame:
    return longs(_detail_types(seed).select("file", "name", "kind", "decl_file", "decl_line", "byte_size"))


@query("scan_dwarf_fields")
def _scan_dwarf_fields(facts: Facts, seed: Seed) -> DataFrame:
    owners = _detail_types(seed).select("file", "type_offset", F.col("name").alias("record"))
    fields = debug_info.record_fields(*debug_layouts_of(seed))
    return longs(fields.join(owners, ["file", "type_offset"]).select("file", "record", "name", "type", "byte_offset"))


@query("scan_dwarf_constants")
def _scan_dwarf_constants(facts: Facts, seed: Seed) -> DataFrame:
    owners = _detail_types(seed).select("file", "type_offset", F.col("name").alias("enum"))
    constants = debug_info.enum_constants(debug_layouts_of(seed)[0])
    return longs(constants.join(owners, ["file", "type_offset"]).select("file", "enum", "name", "value"))


@query("dwarf_calltarget")
def _dwarf_calltarget(facts: Facts, seed: Seed) -> DataFrame:
    """Indirect calls through a parameter with the type of what they call."""
    dies, rendered = debug_details_of(seed)
    sites, stripped = debug_info.call_sites(dies), debug_info.stripped_types(dies)
    pointers = debug_info.function_pointers(dies, rendered, stripped)
    typed = debug_info.argument_targets(sites, dies, stripped, pointers)
    found = debug_info.with_targets(sites, typed, typed.limit(0))
    return longs(found.select("file", "caller", "line", "indirect", "callee_type", "field_hint"))


@query("types_dedup_constants")
def _types_constants(facts: Facts, seed: Seed) -> DataFrame:
    """The constants of each enum as the unit that speaks for it prints them."""
    in_project = paths.resolve(F.col("decl_file"), BUILD_DIR, PROJECT_ROOT)
    records = _detail_types(seed).filter(F.col("kind") == "enum").withColumn("at", in_project)
    records = records.withColumnRenamed("file", "object").withColumns({"decl_file": F.col("at.rel"), "in_project": F.col("at.in_project")}).drop("at")
    constants = debug_info.enum_constants(debug_layouts_of(seed)[0]).withColumnRenamed("file", "object")
    return longs(debug_ingest.dedup_constants(constants, debug_ingest.type_sightings(records)))


@query("scan_ninja_deps")
def _scan_dependencies(facts: Facts, seed: Seed) -> DataFrame:
    return longs(dependency_log.dependencies(dumps_of(seed).dependency_logs()))


def _described(seed: Seed) -> DataFrame:
    schema = build_description.TARGETS_SCHEMA
    parsed = F.from_json("document", schema)
    return dumps_of(seed).target_documents().select(parsed.alias("t")).select("t.*")


@query("scan_meson")
def _scan_meson(facts: Facts, seed: Seed) -> DataFrame:
    return longs(build_description.target_files(_described(seed)))


@query("scan_meson_targets")
def _scan_meson_targets(facts: Facts, seed: Seed) -> DataFrame:
    return build_description.targets(_described(seed)).select("name", "kind", "link_command").distinct()


@query("scan_builddir")
def _scan_builddir(facts: Facts, seed: Seed) -> DataFrame:
    return build_tree.artifacts(dumps_of(seed).build_files(), BUILD_DIR).select(
        "object", "ci", "cgraph", "opt_record", "icf"
    )


@query("sink_publish")
def _publish(facts: Facts, seed: Seed) -> DataFrame:
    """Publish every table, open the result and read the edges with their ids."""
    root = f"{ensure_checkpoint_dir(facts.spark)}/codefacts-{uuid.uuid4().hex}"
    snapshot.publish(facts, root)
    opened = snapshot.open_snapshot(facts.spark, root)
    base = f"{root}/{opened.version}"
    return facts.spark.read.parquet(f"{base}/call_edges").select("caller_id", "callee_id", "source", "target_id")


# -- compiler plane ----------------------------------------------------------------


@query("object_to_source")
def _object_to_source(facts: Facts, seed: Seed) -> DataFrame:
    return compiled_of(seed).sources


@query("symbol_observe")
def _observe(facts: Facts, seed: Seed) -> DataFrame:
    return longs(compiled_of(seed).observing.drop("plain_name"))


@query("clone_attribution")
def _clones(facts: Facts, seed: Seed) -> DataFrame:
    return longs(compiled_of(seed).cloning)


@query("symbol_merge")
def _merge(facts: Facts, seed: Seed) -> DataFrame:
    return longs(compiled_of(seed).symbols)


@query("symbol_merge_names")
def _merge_names(facts: Facts, seed: Seed) -> DataFrame:
    c = compiled_of(seed)
    return symbol_ingest.merge_names(c.observed, c.clones)


@query("symbol_merge_definitions")
def _merge_definitions(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbol_ingest.merge_definitions(compiled_of(seed).observed))


@query("edges_cgraph")
def _edges_cgraph(facts: Facts, seed: Seed) -> DataFrame:
    return symbol_ingest.edges_cgraph(compiled_of(seed).calls)


@query("inline_decisions")
def _decisions(facts: Facts, seed: Seed) -> DataFrame:
    return longs(symbol_ingest.inline_decisions(compiled_of(seed).calls))


@query("inline_records")
def _records(facts: Facts, seed: Seed) -> DataFrame:
    return longs(compiled_of(seed).records.withColumnRenamed("column", "col"))


@query("icf_groups")
def _icf_groups(facts: Facts, seed: Seed) -> DataFrame:
    return compiled_of(seed).folds


@query("referenced_usrs")
def _referenced(facts: Facts, seed: Seed) -> DataFrame:
    c = compiled_of(seed)
    return symbol_ingest.referenced_usrs(c.calls, c.records, c.folds)


@query("prune_unreferenced")
def _prune(facts: Facts, seed: Seed) -> DataFrame:
    """Pruned by every reference: calls, records and folds."""
    c = compiled_of(seed)
    referenced = symbol_ingest.referenced_usrs(c.calls, c.records, c.folds)
    return longs(symbol_ingest.prune_unreferenced(c.symbols, referenced))


@query("assign_ids")
def _assign_ids(facts: Facts, seed: Seed) -> DataFrame:
    return ids.assign_ids(facts.symbols.select("usr"), ["usr"])


@query("target_ids")
def _target_ids(facts: Facts, seed: Seed) -> DataFrame:
    return ids.assign_ids(facts.targets.select("name"), ["name"])


@query("resolve_path")
def _resolve_path(facts: Facts, seed: Seed) -> DataFrame:
    """Every stored path, written the way a dump below the build directory would."""
    spelled = facts.sources.select(
        F.concat(F.lit("sub/./../../"), F.col("path")).alias("path")
    ).unionByName(facts.external_sources.select(F.concat(F.col("abs_path"), F.lit("/../x.h")).alias("path")))
    spot = paths.resolve(F.col("path"), BUILD_DIR, PROJECT_ROOT)
    return spelled.select("path", spot["rel"].alias("rel"), spot["in_project"].cast("bigint").alias("in_project"))


# -- link plane -------------------------------------------------------------------


class Linked:
    def __init__(self, seed: Seed):
        d, facts = dumps_of(seed), facts_of(seed)
        self.names = link_ingest.name_lookup(facts.symbols, facts.symbol_names, facts.symbol_definitions)
        self.resolved = link_ingest.resolve_nm_symbols(
            d.listing().drop("pk"),
            d.map_origins().drop("pk"),
            d.object_defs(),
            d.link_object_sources(),
            facts.symbols,
            self.names,
        )
        self.addresses = link_ingest.address_index(self.resolved)
        self.resolutions = link_ingest.link_resolutions(self.resolved, d.object_defs())


@lru_cache(maxsize=8)
def linked_of(seed: Seed) -> Linked:
    return Linked(seed)


@query("name_lookup")
def _name_lookup(facts: Facts, seed: Seed) -> DataFrame:
    return linked_of(seed).names


@query("resolve_nm_symbol")
def _resolve_nm(facts: Facts, seed: Seed) -> DataFrame:
    return linked_of(seed).resolved.drop("pos")


@query("addr_index")
def _addr_index(facts: Facts, seed: Seed) -> DataFrame:
    return linked_of(seed).addresses


@query("link_resolutions")
def _link_resolutions(facts: Facts, seed: Seed) -> DataFrame:
    return linked_of(seed).resolutions


@query("link_losers_view")
def _losers_view(facts: Facts, seed: Seed) -> DataFrame:
    """Losing objects per target, counted from the factored form."""
    return link_ingest.loser_counts(linked_of(seed).resolutions, dumps_of(seed).object_defs())


@query("edges_objdump")
def _edges_objdump(facts: Facts, seed: Seed) -> DataFrame:
    linked = linked_of(seed)
    calls = dumps_of(seed).branch_rows().drop("caller_pk", "callee_pk")
    return link_ingest.edges_objdump(calls, linked.addresses, linked.names)


# -- debug plane -------------------------------------------------------------------


@query("dwarf_symbol_lookup")
def _debug_lookup(facts: Facts, seed: Seed) -> DataFrame:
    """Names as objects mention them, resolved against the pruned symbols."""
    c = compiled_of(seed)
    mentions = c.nodes.filter(F.col("clone_of") == "").select("object", "name").join(
        c.sources, "object", "left"
    )
    return debug_ingest.lookup_symbols(mentions, c.symbols, "name", "usr").select("object", "name", "usr")


def _subprograms(seed: Seed) -> DataFrame:
    """What the units' debug information says about each function they mention."""
    c = compiled_of(seed)
    rows = dumps_of(seed).unit_parts().select(
        F.concat(F.lit("obj/u_"), F.col("unit").cast("string"), F.lit(".c.o")).alias("object"),
        "name",
        F.col("pk").alias("ordinal"),
        F.col("signature"),
        (F.col("size") > 10).alias("definition"),
        (F.col("size") <= 10).alias("declaration"),
        F.col("size").between(11, 25).alias("abstract_inline"),
        F.concat(F.lit("include/h_"), F.col("unit").cast("string"), F.lit(".h")).alias("decl_file"),
        (F.col("pk") % 50 + 1).cast("int").alias("decl_line"),
    )
    rows = rows.join(c.sources, "object", "left")
    found = debug_ingest.lookup_symbols(rows, c.symbols, "name", "usr")
    return found.filter(F.col("usr").isNotNull())


@query("dwarf_enrich")
def _enrich(facts: Facts, seed: Seed) -> DataFrame:
    c = compiled_of(seed)
    definitions = symbol_ingest.merge_definitions(c.observed)
    return longs(debug_ingest.enrich_definitions(definitions, _subprograms(seed)))


@query("dwarf_enrich_signatures")
def _enrich_signatures(facts: Facts, seed: Seed) -> DataFrame:
    return debug_ingest.enrich_symbols(compiled_of(seed).symbols, _subprograms(seed)).select(
        "usr", "signature"
    )


@query("inline_instances")
def _instances(facts: Facts, seed: Seed) -> DataFrame:
    c = compiled_of(seed)
    names = seed.part_symbols().select("pk", "name")
    bodies = dumps_of(seed).record_rows().filter("inlined")
    for key, out in (("caller_pk", "caller"), ("callee_pk", "callee")):
        bodies = bodies.join(names.select(F.col("pk").alias(key), F.col("name").alias(out)), key)
    rows = bodies.select(
        F.concat(F.lit("obj/u_"), F.col("unit").cast("string"), F.lit(".c.o")).alias("object"),
        "caller",
        "callee",
        F.when(F.col("line") > 25, F.col("caller")).otherwise("").alias("parent_callee"),
        F.when(F.col("line") > 25, 2).otherwise(1).alias("depth"),
        "file", "line", "column",
    ).join(c.sources, "object", "left")
    out = debug_ingest.inline_instances(rows, c.symbols)
    return longs(out.withColumnRenamed("column", "col"))


@query("indirect_sites")
def _sites(facts: Facts, seed: Seed) -> DataFrame:
    c = compiled_of(seed)
    names = seed.part_symbols().select("pk", "name")
    rows = (
        seed.table("events")
        .select(
            (F.col("user_id") % seed.n_parts()).alias("pk"),
            F.concat(F.lit("obj/u_"), (F.col("event_id") % 17).cast("string"), F.lit(".c.o")).alias("object"),
            F.col("event_id").alias("ordinal"),
            (F.col("event_type") != "view").alias("indirect"),
            F.floor("value").cast("int").alias("line"),
            F.lit(1).alias("column"),
            F.lit("int (int, int)").alias("callee_type"),
            F.col("event_type").alias("field_hint"),
            F.lit("src/site.c").alias("file"),
        )
        .join(names, "pk")
        .withColumnRenamed("name", "caller")
        .join(c.sources, "object", "left")
    )
    out = debug_ingest.indirect_sites(rows, c.symbols)
    return longs(out.withColumnRenamed("column", "col"))


def _type_records(seed: Seed) -> DataFrame:
    """Each brand's record as every unit that mentions the brand prints it."""
    seen = dumps_of(seed).unit_parts().select("unit", "brand").distinct()
    number = F.regexp_extract("brand", r"(\d+)$", 1).cast("int")
    return seen.select(
        F.concat(F.lit("obj/u_"), F.col("unit").cast("string"), F.lit(".c.o")).alias("object"),
        number.cast("long").alias("type_offset"),
        number.alias("ordinal"),
        F.when(number % 5 == 0, "").otherwise(F.lower(F.replace("brand", F.lit("#"), F.lit("_")))).alias("name"),
        F.when(number % 4 == 0, "union").when(number % 3 == 0, "typedef").otherwise("struct").alias("kind"),
        F.lit("include/types.h").alias("decl_file"),
        (number != 7).alias("in_project"),
        number.alias("decl_line"),
        F.lit(9).alias("decl_column"),
        (F.col("unit") * 8).cast("int").alias("byte_size"),
        F.concat(F.lit("unit "), F.col("unit").cast("string")).alias("underlying"),
    )


@query("types_dedup")
def _types_dedup(facts: Facts, seed: Seed) -> DataFrame:
    return longs(debug_ingest.dedup_types(debug_ingest.type_sightings(_type_records(seed))))


@query("types_dedup_fields")
def _types_fields(facts: Facts, seed: Seed) -> DataFrame:
    sightings = debug_ingest.type_sightings(_type_records(seed))
    fields = dumps_of(seed).unit_parts().select("unit", "brand", "body").distinct().select(
        F.concat(F.lit("obj/u_"), F.col("unit").cast("string"), F.lit(".c.o")).alias("object"),
        F.regexp_extract("brand", r"(\d+)$", 1).cast("long").alias("type_offset"),
        F.replace("body", F.lit(" "), F.lit("_")).alias("name"),
    )
    return debug_ingest.children_of(fields, sightings)


# -- source plane and gates ----------------------------------------------------------


def _touched(facts: Facts) -> DataFrame:
    """Dependency paths of the three places a file can live in, and of none."""
    project = facts.sources.select(F.concat(F.lit("../proj/"), F.col("path")).alias("path"))
    external = facts.external_sources.select(F.col("abs_path").alias("path"))
    generated = facts.generated_sources.select(F.col("builddir_rel").alias("path"))
    stray = facts.external_sources.select(F.concat(F.lit("/srv"), F.col("abs_path")).alias("path"))
    return project.unionByName(external).unionByName(generated).unionByName(stray)


@query("source_packing")
def _packing(facts: Facts, seed: Seed) -> DataFrame:
    declared = facts.sources.filter(F.col("path").endswith(".c")).select(
        F.concat(F.lit(PROJECT_ROOT + "/"), F.col("path")).alias("path"), F.col("is_generated").alias("generated")
    )
    packed = source_ingest.pack_sources(
        declared, _touched(facts), "/work/out", PROJECT_ROOT, INCLUDE_PATTERNS
    )
    return longs(packed)


@query("external_glob")
def _glob(facts: Facts, seed: Seed) -> DataFrame:
    """External headers by include pattern."""
    rows = facts.external_sources
    hits = [
        paths.glob_condition(F.col("abs_path"), p).cast("bigint").alias(f"p{i}")
        for i, p in enumerate(("/usr/**", "/usr/include/bench_?.h", "/usr/include/*", "/usr/*"))
    ]
    return rows.select("abs_path", *hits)


@query("strict_mtime")
def _strict(facts: Facts, seed: Seed) -> DataFrame:
    """Orders as source edits, line items as the builds that consumed them."""
    consumers = seed.table("lineitem").select(
        F.col("l_orderkey").cast("string").alias("path"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("object"),
    )
    built = (
        seed.table("lineitem")
        .groupBy(
            F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias(
                "object"
            )
        )
        .agg(F.max("l_shipdate").alias("mtime"))
    )
    edited = seed.table("orders").select(
        F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime")
    )
    late = source_ingest.newer_than_consumers(consumers, edited, built)
    return late.select("path", "object")


@query("preflight")
def _preflight(facts: Facts, seed: Seed) -> DataFrame:
    """Units as objects; a dump kind is missing where no such line item exists."""
    by_unit = seed.table("lineitem").groupBy((F.col("l_orderkey") % 997).alias("unit")).agg(
        F.max(F.when(F.col("l_returnflag") == "A", "ci")).alias("ci"),
        F.max(F.when(F.col("l_linenumber") == 7, "cgraph")).alias("cgraph"),
        F.max(F.when(F.col("l_quantity") > 49, "opt")).alias("opt_record"),
    )
    artifacts = by_unit.select(
        F.concat(F.lit("obj/u_"), F.col("unit").cast("string"), F.lit(".c.o")).alias("object"),
        "ci", "cgraph", "opt_record",
    )
    debug = artifacts.agg(F.min("object").alias("object")).withColumn("has_debug", F.lit(False))
    return build_ingest.preflight(artifacts, "9.4.0", debug)


@query("target_filter")
def _target_filter(facts: Facts, seed: Seed) -> DataFrame:
    return build_ingest.filter_targets(facts.targets, ["NATION_1,NATION_2", "NATION_7"])
