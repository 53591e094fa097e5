"""Collection: from a build tree to a published snapshot.

Every stage is a set of lazy DataFrames over line or entry rows; the rows all
later stages share are cut off their lineage once. Inspection tools run inside
tasks, one file at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import paths
from codefacts.operators import (
    build_ingest,
    debug_ingest,
    link_ingest,
    source_ingest,
    symbol_ingest,
)
from codefacts.plans import snapshot
from codefacts.session import cut_lineage, store
from codefacts.sources import (
    build_description,
    build_tree,
    callgraph_info,
    debug_info,
    dependency_log,
    disassembly,
    folding_dump,
    inline_dump,
    linker_map,
    object_tables,
    optimization_record,
    symbol_listing,
    symbol_table_dump,
    tools,
)
from codefacts.sources.lines import read_lines


class PreflightError(Exception):
    """The build tree lacks something collection needs."""


class SourceError(Exception):
    """Sources and build do not fit together."""


@dataclass
class Build:
    """A build tree and how to read it.

    ``tool_dumps`` maps an inspection (``nm``, ``objects_nm``, ``disassembly``,
    ``debug``, ``lines``, ``relocations``, ``symbol_table``) to line rows made
    beforehand; what is missing is produced by running the tools in tasks.
    """

    spark: SparkSession
    build_dir: str
    project_root: str
    tool_dumps: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.build_dir = self.build_dir.rstrip("/")
        self.project_root = self.project_root.rstrip("/")
        self.files = cut_lineage(build_tree.list_files(self.spark, self.build_dir))
        self.artifacts = cut_lineage(build_tree.artifacts(self.files, self.build_dir))
        self.description = build_description.read(
            self.spark, self.build_dir, "intro-targets", build_description.TARGETS_SCHEMA
        )

    def relative(self, path):
        return paths.project_relative(path, self.build_dir, self.project_root)

    def sidecar_lines(self, kind: str, pattern: str) -> DataFrame:
        """Lines of one dump kind with ``file`` replaced by the object they describe."""
        owners = self.artifacts.select("object", F.col(kind).alias("file")).filter(F.col("file").isNotNull())
        rows = read_lines(self.spark, self.build_dir, pattern)
        return rows.join(owners, "file").drop("file").withColumnRenamed("object", "file")

    def inspected(self, name: str, files: DataFrame, command: tuple[str, ...], keep: str | None = None) -> DataFrame:
        if name in self.tool_dumps:
            return self.tool_dumps[name]
        return tools.run(files, command, keep)

    def object_files(self) -> DataFrame:
        root = F.lit(self.build_dir + "/")
        return self.artifacts.select(F.col("object").alias("file"), F.concat(root, "object").alias("path"))


def check(build: Build) -> DataFrame:
    compilers = build_description.read(
        build.spark, build.build_dir, "intro-compilers", build_description.COMPILERS_SCHEMA
    )
    version = build_description.compiler(compilers).select(F.coalesce("version", F.lit(""))).scalar()
    first = build.object_files().orderBy("file").limit(1)
    lines = build.inspected("debug", first, tools.DEBUG_INFO, r"DW_TAG_compile_unit")
    sample = lines.filter(F.contains("line", F.lit("DW_TAG_compile_unit"))).limit(1)
    has_debug = first.select(
        F.col("file").alias("object"), (sample.agg(F.count(F.lit(1))).scalar() > 0).alias("has_debug")
    )
    return build_ingest.preflight(build.artifacts, version, has_debug)


def compiler_plane(build: Build) -> dict[str, DataFrame]:
    cgraph = cut_lineage(symbol_table_dump.observations(build.sidecar_lines("cgraph", "*.cgraph")))
    ci = build.sidecar_lines("ci", "*.ci")
    icf = build.sidecar_lines("icf", "*.icf")

    titles = callgraph_info.titles(ci)
    spot = paths.resolve(F.col("title"), build.build_dir, build.project_root)
    # stored, so that joins know it has one row per object
    titled = store(
        titles.select(F.col("file").alias("object"), spot["rel"].alias("rel"), spot["in_project"].alias("in_project"))
    )
    units = titled.select("object", F.col("rel").alias("source"))
    sites = callgraph_info.nodes(ci).select(
        F.col("file").alias("object"), "name", build.relative(F.col("decl_file")).alias("decl_file"), "decl_line"
    )
    nodes = cut_lineage(symbol_table_dump.nodes_of(cgraph).withColumnRenamed("file", "object"))
    observed = cut_lineage(symbol_ingest.observe(nodes, sites, units))
    clones = symbol_ingest.attribute_clones(nodes, observed)
    identities = cut_lineage(symbol_ingest.local_identities(observed, clones))
    calls = symbol_ingest.resolve_ends(
        symbol_table_dump.calls_of(cgraph).withColumnRenamed("file", "object"), identities
    )
    calls = cut_lineage(calls)
    owners = build.artifacts.select("object", F.col("opt_record").alias("file"))
    documents = optimization_record.read_documents(build.spark, build.build_dir)
    logged = optimization_record.records(documents).join(owners, "file").select(
        "object", "caller_id", "callee_id", "pass", "inlined", "reason",
        build.relative(F.col("site_file")).alias("file"), "line", "column",
    )
    records = cut_lineage(symbol_ingest.inline_records(logged, identities))
    folds = symbol_ingest.icf_members(
        folding_dump.members(icf).withColumnRenamed("file", "object"), nodes, identities
    )
    folds = cut_lineage(folds)
    referenced = symbol_ingest.referenced_usrs(calls, records, folds)
    symbols = cut_lineage(
        symbol_ingest.prune_unreferenced(symbol_ingest.merge_symbols(observed, clones), referenced)
    )
    kept = symbols.select("usr")
    return {
        "symbols": symbols.drop("has_def"),
        "symbol_names": symbol_ingest.merge_names(observed, clones).join(kept, "usr", "left_semi"),
        "symbol_definitions": symbol_ingest.merge_definitions(observed),
        "call_edges": symbol_ingest.edges_cgraph(calls),
        "inline_decisions": symbol_ingest.inline_decisions(calls),
        "inline_records": records,
        "icf_groups": folds.select("winner_usr", "object_file").distinct(),
        "icf_group_members": folds,
        "object_sources": cut_lineage(symbol_ingest.object_sources(titled)),
    }


def debug_plane(build: Build, facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    objects = build.object_files()
    lines = build.inspected("debug", objects, tools.DEBUG_INFO, r"DW_TAG_|DW_AT_")
    dies = store(debug_info.with_parents(debug_info.entries(lines)))
    rendered = cut_lineage(debug_info.render_types(dies))
    spot = paths.resolve(F.col("path"), build.build_dir, build.project_root)
    sources = debug_info.units(dies).select(F.col("file").alias("object"), spot["rel"].alias("source"))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("file", "object").join(sources, "object", "left")

    symbols = facts["symbols"]
    functions = placed(debug_info.subprograms(dies, rendered)).filter(F.col("name") != "")
    functions = functions.withColumn("decl_file", build.relative(F.col("decl_file")))
    functions = debug_ingest.lookup_symbols(functions, symbols, "name", "usr")
    functions = cut_lineage(functions.filter(F.col("usr").isNotNull()))

    table = object_tables.line_rows(build.inspected("lines", objects, tools.DEBUG_LINE))
    sites = cut_lineage(debug_info.call_sites(dies, table))
    stripped = cut_lineage(debug_info.stripped_types(dies))
    pointers = cut_lineage(debug_info.function_pointers(dies, rendered, stripped))
    by_argument = debug_info.argument_targets(sites, dies, stripped, pointers)
    by_relocation = debug_info.relocation_targets(
        sites, dies, stripped, pointers,
        object_tables.function_symbols(build.inspected("symbol_table", objects, tools.SYMBOL_TABLE)),
        object_tables.relocations(build.inspected("relocations", objects, tools.RELOCATIONS)),
    )
    aimed = placed(debug_info.with_targets(sites, by_argument, by_relocation))
    indirect = debug_ingest.indirect_sites(
        aimed.withColumn("file", build.relative(F.col("site_file"))), symbols
    )
    bodies = placed(debug_info.inline_instances(dies)).withColumn("file", build.relative(F.col("site_file")))

    declared = paths.resolve(F.col("decl_file"), build.build_dir, build.project_root)
    sightings = (
        debug_info.type_records(dies, rendered)
        .withColumnRenamed("file", "object")
        .withColumn("in_project", declared["in_project"])
        .withColumn("decl_file", declared["rel"])
    )
    sightings = cut_lineage(debug_ingest.type_sightings(sightings))
    fields = debug_ingest.children_of(
        debug_info.record_fields(dies, rendered).withColumnRenamed("file", "object"), sightings
    )
    from pyspark.sql.window import Window

    # A record's members are bounded by its declaration.
    members = Window.partitionBy("type_usr").orderBy("place")
    return {
        "symbols": debug_ingest.enrich_symbols(symbols, functions),
        "symbol_definitions": debug_ingest.enrich_definitions(facts["symbol_definitions"], functions),
        "indirect_call_sites": indirect,
        "inline_instances": debug_ingest.inline_instances(bodies, symbols),
        "types": debug_ingest.dedup_types(sightings),
        "type_fields": fields.select(
            "type_usr", "name", "type", (F.row_number().over(members) - 1).alias("ordinal"), "byte_offset"
        ),
        "enum_constants": debug_ingest.dedup_constants(
            debug_info.enum_constants(dies).withColumnRenamed("file", "object"), sightings
        ),
    }


def build_plane(build: Build, wanted: list[str]) -> dict[str, DataFrame]:
    targets = build_ingest.filter_targets(build_description.targets(build.description), wanted)
    files = build_description.target_files(build.description).join(
        targets.select(F.col("name").alias("target")), "target", "left_semi"
    )
    return {
        "targets": cut_lineage(targets),
        "target_sources": files.filter(~F.col("generated")).select(
            "target", build.relative(F.col("path")).alias("file")
        ),
        "declared": files.select("path", "generated"),
    }


def link_plane(build: Build, facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    linked = facts["targets"].filter(
        F.col("kind").isin("executable", "shared_library") & (F.size("filenames") > 0)
    ).select(F.col("name").alias("file"), F.col("filenames")[0].alias("path"))
    listing = cut_lineage(symbol_listing.symbols(build.inspected("nm", linked, tools.DEFINED_SYMBOLS)))
    objects = symbol_listing.symbols(build.inspected("objects_nm", build.object_files(), tools.DEFINED_SYMBOLS))
    object_defs = cut_lineage(symbol_listing.object_defs(objects))
    maps = build_tree.linker_maps(build.files, build.build_dir)
    map_lines = read_lines(build.spark, build.build_dir, "*.map").join(
        maps.withColumnRenamed("path", "file"), "file"
    )
    origins = linker_map.origins(map_lines.drop("file").withColumnRenamed("target", "file")).withColumnRenamed(
        "file", "target"
    )
    names = cut_lineage(
        link_ingest.name_lookup(facts["symbols"], facts["symbol_names"], facts["symbol_definitions"])
    )
    rows = listing.select(
        F.col("file").alias("target"), "name", "nm_kind", "address", F.struct("block", "pos").alias("pos")
    )
    resolved = cut_lineage(
        link_ingest.resolve_nm_symbols(
            rows, origins, object_defs, facts["object_sources"], facts["symbols"], names
        )
    )
    # A large binary is disassembled by several tasks, each over its own addresses.
    functions = listing.filter("is_function AND address <> ''").select("file", "address")
    parts = tools.address_parts(linked, functions)
    calls = disassembly.direct_calls(
        build.inspected("disassembly", parts, tools.DISASSEMBLY, r"^[0-9a-fA-F]+\s+<|\s(call|jmp)\s")
    ).withColumnRenamed("file", "target")
    edges = link_ingest.edges_objdump(calls, link_ingest.address_index(resolved), names)
    return {
        "link_resolutions": link_ingest.link_resolutions(resolved, object_defs),
        "object_defs": object_defs,
        "call_edges": facts["call_edges"].unionByName(edges),
    }


def source_plane(
    build: Build, declared: DataFrame, strict: bool, include_external: tuple[str, ...]
) -> dict[str, DataFrame]:
    spark = build.spark
    outputs = build.artifacts.select(F.col("object").alias("output"))
    log = dependency_log.read_dependencies(spark, build.build_dir).join(outputs, "output", "left_semi")
    dependencies = cut_lineage(log.select(F.col("output").alias("object"), F.col("input").alias("path")))
    packed = cut_lineage(
        source_ingest.pack_sources(
            declared, dependencies, build.build_dir, build.project_root, include_external
        )
    )
    missing = source_ingest.misplaced_sources(packed).limit(20).collect()
    if missing:
        raise SourceError("outside the project and the build: " + ", ".join(r["key"] for r in missing))
    unmatched = source_ingest.unmatched_patterns(
        dependencies.filter(~paths.resolve(F.col("path"), build.build_dir, build.project_root)["in_project"]),
        build.build_dir, include_external,
    )
    if unmatched:
        raise SourceError("include patterns that match no header: " + ", ".join(unmatched))

    def contents(bucket: str, root: str) -> DataFrame:
        keys = packed.filter(F.col("bucket") == bucket)
        tree = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(
                paths.relative_to(paths.plain_path(F.col("path")), root).alias("key"),
                F.col("modificationTime").alias("mtime"), "content",
            )
        )
        return keys.join(tree, "key", "left")

    project = contents("project", build.project_root)
    absent = project.filter(F.col("content").isNull() & F.col("required")).select("key").limit(20).collect()
    if absent:
        raise SourceError("required sources are missing: " + ", ".join(r["key"] for r in absent))
    if strict:
        consumers = dependencies.select(build.relative(F.col("path")).alias("path"), "object")
        late = source_ingest.newer_than_consumers(
            consumers, project.select(F.col("key").alias("path"), "mtime"), build.artifacts.select("object", "mtime")
        ).limit(1).collect()
        if late:
            raise SourceError(f"{late[0]['path']} is newer than {late[0]['object']}: rebuild first")
    rows = project.filter(F.col("content").isNotNull())
    generated = contents("generated", build.build_dir).filter(F.col("content").isNotNull())
    # Every external header lies under the fixed part of one of the patterns.
    external = None
    for pattern in include_external:
        root = pattern.strip().split("*")[0].rsplit("/", 1)[0] or "/"
        tree = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select(paths.plain_path(F.col("path")).alias("key"), "content")
        )
        hits = packed.filter(F.col("bucket") == "external").select("key").join(tree, "key")
        external = hits if external is None else external.unionByName(hits)
    digest = F.sha2(F.col("content"), 256).alias("blob_hash")
    all_contents = rows.select("content").unionByName(generated.select("content"))
    out = {
        "sources": rows.select(F.col("key").alias("path"), digest, "is_generated"),
        "generated_sources": generated.select(F.col("key").alias("builddir_rel"), digest),
    }
    if external is not None:
        external = external.dropDuplicates(["key"])
        out["external_sources"] = external.select(F.col("key").alias("abs_path"), digest)
        all_contents = all_contents.unionByName(external.select("content"))
    else:
        out["external_sources"] = spark.createDataFrame([], "abs_path string, blob_hash string")
    out["blobs"] = source_ingest.dedup_blobs(all_contents)
    return out


def gather(
    build: Build, targets: list[str] | None = None, strict: bool = False, include_external: tuple[str, ...] = ()
) -> Facts:
    """All fact tables of one build, not yet published."""
    tables = build_plane(build, targets or [])
    tables.update(compiler_plane(build))
    tables.update(debug_plane(build, tables))
    for name in ("symbols", "symbol_definitions"):
        tables[name] = cut_lineage(tables[name])
    # Site ids follow the order objects list their sites in.
    from codefacts.operators.ids import assign_ids

    sites = assign_ids(tables["indirect_call_sites"], ["object", "ordinal"], "site_id")
    tables["indirect_call_sites"] = sites.drop("object", "ordinal")
    tables.update(link_plane(build, tables))
    tables.update(source_plane(build, tables.pop("declared"), strict, include_external))
    tables.pop("object_sources")
    tables["targets"] = tables["targets"].drop("filenames")
    tables["symbol_tokens"], tables["type_tokens"] = snapshot.token_tables(tables["symbols"], tables["types"])
    return Facts.of(build.spark, tables)


def build_snapshot(
    build: Build,
    out: str,
    targets: list[str] | None = None,
    strict: bool = False,
    replace: bool = False,
    include_external: tuple[str, ...] = (),
) -> str:
    """Check, gather and publish; returns the version written."""
    findings = check(build).collect()
    if findings:
        raise PreflightError(
            "; ".join(
                f"[{f['kind']}] {f['n_missing']} of {f['n_objects']} ({f['sample']})" for f in findings
            )
        )
    facts = gather(build, targets, strict, include_external)
    info = build_description.read(build.spark, build.build_dir, "meson-info", build_description.INFO_SCHEMA).first()
    properties = {"project_root_hint": build.project_root}
    if info and info["meson_version"]:
        properties["meson_version"] = info["meson_version"]["full"]
    return snapshot.publish(facts, out, replace, properties)


def inline_summaries(build: Build) -> DataFrame:
    """What the inliner summary dumps say; no published fact depends on it."""
    return inline_dump.inlined_callees(build.sidecar_lines("inline", "*.inline"))
