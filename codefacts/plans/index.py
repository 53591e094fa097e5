"""The query surface: one method per question about a snapshot.

Rows stay DataFrames in a stable order. They are whole unless a page is asked
for by ``limit``; ``truncated`` says whether the page left something out.
Unknown symbols, types and targets raise :class:`LookupError`, bad limits
:class:`ValueError`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts import schemas
from codefacts.functions import paths
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
from codefacts.plans import sql_query
from codefacts.plans.snapshot import Catalog
from codefacts.session import cut_lineage, exists


#: Files that are named one by one when live contents are read; of more, the whole folder is read.
MOST_NAMED_FILES = 20_000


@dataclass
class Answer:
    """Main rows, further row sets by name, and whether a page cut the rows."""

    rows: DataFrame
    parts: dict[str, DataFrame] = field(default_factory=dict)
    truncated: bool = False
    note: str = ""

    def to_json(self) -> DataFrame:
        """The rows as JSON documents."""
        return self.rows.select(F.to_json(F.struct("*")).alias("json"))


class Index:
    def __init__(self, spark: SparkSession, path: str, project_root: str = ""):
        self._catalog = Catalog(spark, path)
        self._project_root = project_root.rstrip("/")

    # A query works on the snapshot it saw when it started.
    @property
    def _facts(self):
        return self._catalog.snapshot.facts

    # -- helpers ----------------------------------------------------------

    def _require(self, df: DataFrame, what: str) -> None:
        if df.isEmpty():
            raise LookupError(what)

    def _symbol(self, facts, usr: str) -> None:
        self._require(facts.symbols.filter(F.col("usr") == usr), f"no symbol {usr!r}")

    def _target(self, facts, target: str | None) -> None:
        if target is not None:
            self._require(facts.targets.filter(F.col("name") == target), f"unknown target {target!r}")

    def _paged(self, rows: DataFrame, keys: list, limit: int | None, **extra) -> Answer:
        """All rows in order, or a page of them; the page's rows and one more are stored once."""
        ordered = rows.orderBy(*keys)
        if common.page_size(limit) is None:
            return Answer(ordered, **extra)
        taken = cut_lineage(ordered.limit(limit + 1))
        return Answer(taken.orderBy(*keys).limit(limit), truncated=taken.count() > limit, **extra)

    def _located(self, facts, rows: DataFrame, snippets: bool, keys: list) -> DataFrame:
        """Rows with locations; the joins do not keep order, so a page is sorted again."""
        return common.with_location(rows, facts, snippets, project_root=self._project_root).orderBy(*keys)

    # -- schema, SQL, reload -------------------------------------------------

    def describe_schema(self) -> dict:
        return {
            "version": schemas.SCHEMA_VERSION,
            "tables": dict(schemas.TABLE_SCHEMAS),
            "enums": {
                column: {"values": list(values), "note": schemas.VOCABULARY_NOTES.get(column, "")}
                for column, values in schemas.VOCABULARIES.items()
            },
            "join_recipes": [
                {"name": name, "purpose": purpose, "sql": sql}
                for name, (purpose, sql) in schemas.RECIPES.items()
            ],
        }

    def sql_query(
        self, sql: str, params=None, limit: int | None = None, timeout: float = sql_query.TIMEOUT_SECONDS
    ) -> dict:
        return sql_query.sql_query(self._catalog.snapshot, sql, params, limit, timeout)

    def sql_frame(self, sql: str, params=None) -> DataFrame:
        return sql_query.sql_frame(self._catalog.snapshot, sql, params)

    def reload_index(self) -> dict:
        return self._catalog.reload()

    # -- sources -----------------------------------------------------------------

    def read_source(self, path: str, start_line: int = 0, end_line: int = 0) -> Answer:
        facts = self._facts
        found = source_text.locate(facts, path).first()
        if found is None:
            raise LookupError(f"no stored source at {path!r}")
        return Answer(source_text.read_stored(facts, path, found["blob_hash"], start_line, end_line))

    def list_source_files(
        self, target: str | None = None, path_prefix: str = "", kind: str | None = None,
        include_external: bool = False,
    ) -> Answer:
        facts = self._facts
        self._has_sources(facts, target)
        filters = dict(target=target, path_prefix=path_prefix, kind=kind, include_external=include_external)
        rows = source_text.list_source_files(facts, **filters).orderBy("table_ord", "path")
        return Answer(rows, {"targets": source_text.file_targets(facts, **filters)})

    def _has_sources(self, facts, target: str | None) -> None:
        if target is not None:
            self._require(
                facts.target_sources.filter(F.col("target") == target), f"target {target!r} lists no sources"
            )

    def _live(self, wanted: DataFrame, path_prefix: str = "") -> DataFrame:
        """``(path, content)`` of the project's files that are ``wanted`` (path).

        Names are listed first, below the directory of the prefix, and no
        content is read for it. The files that are wanted are then named by
        their metadata, so that no other file is opened.
        """
        if not self._project_root:
            raise ValueError("comparing with live files needs project_root")
        spark, root = self._facts.spark, self._project_root
        folder = path_prefix.rpartition("/")[0]
        base = f"{root}/{folder}" if folder else root
        if not exists(spark, base):
            return spark.createDataFrame([], "path string, content binary")
        base = re.sub(r"([\\*?\[\]{}])", r"\\\1", base)
        tree = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        relative = paths.relative_to(paths.plain_path(F.col("path")), root).alias("path")
        listed = tree.select(relative, F.col("_metadata.file_path").alias("uri"))
        named = listed.join(wanted.select("path").distinct(), "path", "left_semi").limit(MOST_NAMED_FILES + 1).collect()
        if len(named) <= MOST_NAMED_FILES:
            tree = tree.filter(F.col("_metadata.file_path").isin([r["uri"] for r in named]))
        return tree.select(relative, "content")

    def _live_file(self, path: str) -> DataFrame:
        """One file of the project, or no row where it does not exist."""
        if not self._project_root:
            raise ValueError("comparing with live files needs project_root")
        spark, full = self._facts.spark, f"{self._project_root}/{path}"
        if not exists(spark, full):
            return spark.createDataFrame([], "path string, content binary")
        escaped = re.sub(r"([\\*?\[\]{}])", r"\\\1", full)
        return spark.read.format("binaryFile").load(escaped).select(F.lit(path).alias("path"), "content")

    def verify_source(self, path: str, expected_hash: str | None = None) -> Answer:
        facts = self._facts
        self._require(facts.sources.filter(F.col("path") == path), f"no indexed source at {path!r}")
        if expected_hash:
            return Answer(source_text.verify_source(facts, path, expected_hash))
        return Answer(source_text.verify_live(facts, path, self._live_file(path)))

    def list_source_drift(self, target: str | None = None, path_prefix: str = "") -> Answer:
        facts = self._facts
        self._has_sources(facts, target)
        checked = source_text.files(facts, target, path_prefix).filter(F.col("table_ord") == 0)
        live = self._live(checked, path_prefix)
        rows = source_text.list_source_drift(facts, live, target, path_prefix).orderBy("path")
        return Answer(rows, {"checked": checked.agg(F.count(F.lit(1)).alias("checked"))})

    def search_source(
        self, pattern: str, regex: bool = False, target: str | None = None, path_prefix: str = "",
        kind: str | None = None, include_external: bool = False, context: int = 0, limit: int | None = None,
    ) -> Answer:
        """Totals count every match; only the rows shown are cut to a page.

        Contents are read once, those of the wanted files that can hold a
        match; all parts of the answer come from the stored matches.
        """
        facts = self._facts
        self._has_sources(facts, target)
        filters = dict(target=target, path_prefix=path_prefix, kind=kind, include_external=include_external)
        keys = ["table_ord", "path", "line", "column"]
        if context < 0:
            raise ValueError("context counts lines on each side, 0 or more")
        wanted = source_text.files(facts, **filters)
        found = cut_lineage(source_text.blob_matches(facts, pattern, regex, wanted))
        answer = self._paged(source_text.file_matches(found, wanted), keys, limit)
        # Without context the window is the matching line itself.
        answer.rows = source_text.with_context(facts, answer.rows, context).orderBy(*keys)
        by_file = source_text.file_counts(found, wanted)
        answer.parts = {
            "summary": source_text.search_summary(by_file, wanted),
            "matches_by_file": source_text.top_counts(by_file, "path"),
            "matches_by_directory": source_text.top_counts(source_text.search_by_directory(by_file), "directory"),
        }
        return answer

    # -- targets -----------------------------------------------------------------

    def list_targets(self) -> Answer:
        return Answer(targets.list_targets(self._facts).orderBy("name"))

    def describe_target(self, name: str) -> Answer:
        facts = self._facts
        self._target(facts, name)
        entries = self._located(
            facts, targets.target_entry_points(facts, name), True, [F.desc("own"), "file", "line"]
        )
        return Answer(
            targets.describe_target(facts, name),
            {
                "sources": targets.target_source_files(facts, name).orderBy("file"),
                "archives": targets.target_archives(facts, name).orderBy("archive"),
                "entry_points": entries,
            },
        )

    # -- symbols -------------------------------------------------------------------

    def find_symbol(
        self, query: str, exact: bool = False, kind: str | None = None, target: str | None = None,
        limit: int | None = None,
    ) -> Answer:
        facts = self._facts
        hits = symbols.find_symbol(facts, query, exact, kind, target)
        answer = self._paged(hits, ["name", "usr"], limit)
        answer.parts = {"targets": common.targets_of(facts, answer.rows)}
        if answer.rows.isEmpty():
            answer.note = symbols.empty_note(query, exact, target)
        return answer

    def describe_symbol(self, usr: str) -> Answer:
        facts = self._facts
        self._symbol(facts, usr)
        found = facts.symbol_definitions.filter(F.col("usr") == usr)
        definitions = self._located(facts, found, True, ["file", "line"])
        return Answer(
            symbols.describe_symbol(facts, usr),
            {
                "linkage_names": symbols.linkage_names(facts, usr).orderBy("linkage_name"),
                "definitions": definitions,
                "targets": symbols.symbol_targets(facts, usr).orderBy("target"),
                "link_resolutions": symbols.resolutions(facts, usr).orderBy("target"),
                "losing_objects": facts.link_losers.filter(F.col("usr") == usr).orderBy("target", "object"),
            },
        )

    # -- call graph ------------------------------------------------------------------

    def _neighbours(self, facts, rows: DataFrame, limit: int | None) -> Answer:
        answer = self._paged(rows, ["name", "usr"], limit)
        answer.parts = {"targets": common.targets_of(facts, answer.rows)}
        return answer

    def list_callers(self, callee_usr: str, target: str | None = None, limit: int | None = None) -> Answer:
        facts = self._facts
        self._symbol(facts, callee_usr)
        return self._neighbours(facts, callgraph.list_callers(facts, callee_usr, target), limit)

    def list_callees(self, caller_usr: str, target: str | None = None, limit: int | None = None) -> Answer:
        facts = self._facts
        self._symbol(facts, caller_usr)
        return self._neighbours(facts, callgraph.list_callees(facts, caller_usr, target), limit)

    def list_call_paths(
        self, from_usr: str, to_usr: str, max_depth: int | None = None, target: str | None = None,
        limit: int = common.PAGE["call_paths"],
    ) -> Answer:
        facts = self._facts
        self._symbol(facts, from_usr)
        self._symbol(facts, to_usr)
        self._target(facts, target)
        common.page_size(limit)
        found = call_paths.first_call_paths(facts, from_usr, to_usr, max_depth, target, limit + 1)
        return self._paged(found, ["names", "usrs"], limit)

    def list_linked_callers(self, callee_usr: str, target: str) -> Answer:
        facts = self._facts
        self._symbol(facts, callee_usr)
        self._target(facts, target)
        return Answer(callgraph.list_linked_callers(facts, callee_usr, target).orderBy("name", "usr"))

    def list_linked_callees(self, caller_usr: str, target: str) -> Answer:
        facts = self._facts
        self._symbol(facts, caller_usr)
        self._target(facts, target)
        return Answer(callgraph.list_linked_callees(facts, caller_usr, target).orderBy("name", "usr"))

    # -- inlining -------------------------------------------------------------------

    def describe_inlining(
        self, caller_usr: str, limit: int | None = None, include_snippets: bool = False
    ) -> Answer:
        facts = self._facts
        self._symbol(facts, caller_usr)
        n = common.page_size(limit)
        by_pass, by_depth = (
            [first, "callee", "file", "line", "column"] for first in ("pass", "depth")
        )
        records = self._paged(inlining.records(facts, caller_usr), by_pass, n)
        bodies = self._paged(inlining.instances(facts, caller_usr), by_depth, n)
        cgraph = self._paged(inlining.decisions(facts, caller_usr), ["callee", "callee_usr"], n)
        return Answer(
            inlining.summary(facts, caller_usr),
            {
                "records": self._located(facts, records.rows, include_snippets, by_pass),
                "instances": self._located(facts, bodies.rows, include_snippets, by_depth),
                "cgraph_decisions": cgraph.rows,
            },
            records.truncated or bodies.truncated or cgraph.truncated,
        )

    def list_inline_instances(
        self, callee_usr: str, limit: int | None = None, include_snippets: bool = False
    ) -> Answer:
        facts = self._facts
        self._symbol(facts, callee_usr)
        n = common.page_size(limit)
        by_pass, by_depth = (
            [first, "caller", "file", "line", "column"] for first in ("pass", "depth")
        )
        records = self._paged(inlining.records(facts, callee_usr, "callee_usr"), by_pass, n)
        bodies = self._paged(inlining.instances(facts, callee_usr, "callee_usr"), by_depth, n)
        return Answer(
            inlining.summary(facts, callee_usr, "callee_usr"),
            {
                "records": self._located(facts, records.rows, include_snippets, by_pass),
                "instances": self._located(facts, bodies.rows, include_snippets, by_depth),
            },
            records.truncated or bodies.truncated,
        )

    def explain_call(
        self, caller_usr: str, callee_usr: str, target: str | None = None, limit: int | None = None,
        include_snippets: bool = False,
    ) -> Answer:
        """The verdict reads all evidence; only the evidence shown is cut."""
        facts = self._facts
        self._symbol(facts, caller_usr)
        self._symbol(facts, callee_usr)
        overall, per_object = inlining.explain_call(facts, caller_usr, callee_usr, target)
        this = F.col("callee_usr") == callee_usr
        n = common.page_size(limit)
        by_pass, by_depth = ([first, "file", "line", "column"] for first in ("pass", "depth"))
        records = self._paged(inlining.records(facts, caller_usr).filter(this), by_pass, n)
        bodies = self._paged(inlining.instances(facts, caller_usr).filter(this), by_depth, n)
        return Answer(
            overall,
            {
                "per_object": per_object.orderBy("object"),
                "records": self._located(facts, records.rows, include_snippets, by_pass),
                "instances": self._located(facts, bodies.rows, include_snippets, by_depth),
            },
            records.truncated or bodies.truncated,
        )

    # -- types ------------------------------------------------------------------------

    def find_type(
        self, query: str, exact: bool = False, kind: str | None = None, limit: int | None = None
    ) -> Answer:
        facts = self._facts
        rows = types.find_type(facts, query, exact, kind)
        answer = self._paged(rows, ["ord", "name", "usr"], common.page_size(limit))
        if answer.rows.isEmpty():
            answer.note = types.empty_note(query, exact)
        return answer

    def describe_type(self, usr: str) -> Answer:
        facts = self._facts
        rows = types.describe_type(facts, usr)
        self._require(rows, f"no type {usr!r}; only types some unit used are recorded")
        return Answer(
            rows,
            {
                "fields": types.fields(facts, usr).orderBy("ordinal"),
                "constants": types.constants(facts, usr).orderBy("value", "name"),
            },
        )

    # -- indirect calls ---------------------------------------------------------------

    def list_indirect_call_sites(
        self, caller_usr: str | None = None, callee_type: str | None = None, target: str | None = None,
        limit: int | None = None, include_snippets: bool = False,
    ) -> Answer:
        facts = self._facts
        rows = indirect.list_indirect_call_sites(facts, caller_usr, callee_type, target)
        keys = ["file", "line", "column", "site_id"]
        answer = self._paged(rows, keys, common.page_size(limit))
        answer.rows = self._located(facts, answer.rows, include_snippets, keys)
        return answer

    def list_address_taken_functions(self, fn_ptr_type: str | None = None, target: str | None = None) -> Answer:
        facts = self._facts
        rows = indirect.list_address_taken_functions(facts, fn_ptr_type, target)
        return Answer(rows.orderBy("name", "usr"), {"targets": common.targets_of(facts, rows)})

    def resolve_indirect_call(self, site_id: int) -> Answer:
        facts = self._facts
        self._require(facts.indirect_call_sites.filter(F.col("site_id") == site_id), f"no call site {site_id}")
        rows = indirect.resolve_indirect_call(facts, site_id)
        return Answer(rows.orderBy("name", "usr"), {"targets": common.targets_of(facts, rows)})

    # -- linkage -----------------------------------------------------------------------

    def describe_link_resolution(self, usr: str, target: str) -> Answer:
        facts = self._facts
        rows = linkage.describe_link_resolution(facts, usr, target)
        self._require(rows, f"no link resolution of {usr!r} in {target!r}")
        return Answer(rows, {"losing_objects": linkage.losing_objects(facts, usr, target).orderBy("object")})

    def list_weak_symbols(self, target: str | None = None, strict: bool = False) -> Answer:
        facts = self._facts
        rows = linkage.list_weak_symbols(facts, target, strict)
        listed = rows.select("usr")
        weak = facts.symbol_definitions.filter("is_weak").select("usr", "file", "line")
        weak = weak.join(listed, "usr", "left_semi")
        weak = self._located(facts, weak, True, ["usr", "file", "line"])
        resolutions = facts.link_resolutions.join(listed, "usr", "left_semi")
        return Answer(rows.orderBy("name", "usr"), {"definitions": weak, "resolutions": resolutions})

    def list_undefined_symbols(self, target: str) -> Answer:
        facts = self._facts
        self._target(facts, target)
        return Answer(linkage.list_undefined_symbols(facts, target).orderBy("name", "usr"))

    def list_icf_groups(self, target: str | None = None) -> Answer:
        facts = self._facts
        self._target(facts, target)
        rows = linkage.list_icf_groups(facts, target).orderBy("winner", "winner_usr", "object_file")
        return Answer(rows, {"losers": linkage.icf_losers(facts, target)})

    def list_unreachable_symbols(self, target: str, limit: int | None = None) -> Answer:
        facts = self._facts
        self._target(facts, target)
        rows = linkage.list_unreachable_symbols(facts, target)
        return self._paged(rows, ["name", "usr"], common.page_size(limit))

    def list_entry_points(
        self, target: str, limit: int | None = None, include_snippets: bool = False
    ) -> Answer:
        facts = self._facts
        self._target(facts, target)
        rows = linkage.list_entry_points(facts, target)
        keys = [F.desc("is_main"), "name", "usr"]
        answer = self._paged(rows, keys, common.page_size(limit))
        answer.rows = self._located(facts, answer.rows, include_snippets, keys)
        answer.note = "Constructors and init-array entries are not classified."
        return answer
