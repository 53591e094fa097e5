"""Table schemas, closed vocabularies and documented join recipes."""

from __future__ import annotations

SCHEMA_VERSION = "10"

# Column lists of the published tables, as DDL. Tables are keyed by `usr` and
# target name; `id` columns are dense surrogates attached at publication.
TABLE_SCHEMAS = {
    "meta": "key string, value string",
    "targets": "id bigint, name string, kind string, link_command string",
    "target_sources": "target_id bigint, target string, file string",
    "blobs": "hash string, size bigint, content binary",
    "blob_lines": "hash string, line_starts array<int>, text_end int",
    "blob_trigrams": "trigram int, block string, members bigint",
    "blob_blocks": "block string, slot int, hash string",
    "sources": "path string, blob_hash string, is_generated boolean",
    "external_sources": "abs_path string, blob_hash string",
    "generated_sources": "builddir_rel string, blob_hash string",
    "symbols": (
        "id bigint, usr string, name string, kind string, linkage string, signature string, "
        "address_taken boolean"
    ),
    "symbol_names": "usr string, linkage_name string",
    "symbol_definitions": (
        "symbol_id bigint, usr string, file string, line int, decl_file string, decl_line int, "
        "is_weak boolean, linkage_name string"
    ),
    "types": (
        "id bigint, usr string, name string, kind string, decl_file string, decl_line int, "
        "byte_size int, underlying string"
    ),
    "type_fields": (
        "type_id bigint, type_usr string, name string, type string, ordinal int, byte_offset int"
    ),
    "enum_constants": "usr string, type_id bigint, type_usr string, name string, value bigint",
    "call_edges": (
        "caller_id bigint, callee_id bigint, caller_usr string, callee_usr string, source string, "
        "target_id bigint, target string"
    ),
    "indirect_call_sites": (
        "site_id bigint, caller_id bigint, caller_usr string, file string, line int, column int, "
        "callee_type string, field_hint string"
    ),
    "inline_decisions": (
        "caller_id bigint, callee_id bigint, caller_usr string, callee_usr string, inlined boolean"
    ),
    "inline_records": (
        "caller_id bigint, callee_id bigint, caller_usr string, callee_usr string, pass string, "
        "inlined boolean, reason string, file string, line int, column int, object string"
    ),
    "inline_instances": (
        "callee_id bigint, caller_id bigint, parent_callee_id bigint, callee_usr string, caller_usr string, "
        "parent_callee_usr string, depth int, file string, line int, column int, object string"
    ),
    "icf_groups": "id bigint, winner_symbol_id bigint, winner_usr string, object_file string",
    "icf_group_members": (
        "group_id bigint, symbol_id bigint, winner_usr string, object_file string, loser_usr string"
    ),
    "link_resolutions": (
        "target_id bigint, target string, usr string, name string, winning_object string, "
        "linkage_kind string, archive string"
    ),
    "link_losers": "target string, usr string, object string",
    "object_defs": "name string, object string, nm_kind string",
    "symbol_tokens": "token string, usr string",
    "type_tokens": "token string, usr string",
    "symbol_reachability": (
        "target_id bigint, symbol_id bigint, target string, usr string, reachable int, section_kept int"
    ),
}

# Closed vocabularies.
VOCABULARIES = {
    "targets.kind": ("executable", "static_library", "shared_library"),
    "symbols.kind": ("function", "variable"),
    "symbols.linkage": ("external", "internal", "weak", "common"),
    "call_edges.source": ("compiler_cgraph", "objdump"),
    "inline_records.pass": ("einline", "inline"),
    "link_resolutions.linkage_kind": ("strong", "weak", "unique_global", "common"),
    "symbol_reachability.reachable": ("1",),
}

# What a reader should know before trusting a vocabulary column.
VOCABULARY_NOTES = {
    "symbols.kind": "only entities that reached the assembler have a row; types live in `types`",
    "symbols.linkage": "strongest linkage seen in any translation unit",
    "call_edges.source": "the two planes never mix: compiler_cgraph rows have no target",
    "inline_records.pass": "one call can be decided by both passes",
    "symbol_reachability.reachable": "unreachable symbols have no row; test with an anti-join",
}

# Queries that cross planes, by purpose. Parameters are named.
RECIPES = {
    "symbol_by_name": (
        "A name, compiler-made clone names included, to its symbol",
        """SELECT DISTINCT s.usr, s.name, s.kind, s.linkage, s.signature
           FROM symbols s LEFT JOIN symbol_names n ON n.usr = s.usr
           WHERE s.name = :name OR n.linkage_name = :name""",
    ),
    "definitions": (
        "Every definition of a symbol",
        """SELECT d.file, d.line, d.decl_file, d.decl_line, d.is_weak, d.linkage_name
           FROM symbol_definitions d WHERE d.usr = :usr""",
    ),
    "source_callers": (
        "Callers the compiler saw",
        """SELECT c.usr, c.name FROM call_edges e JOIN symbols c ON c.usr = e.caller_usr
           WHERE e.source = 'compiler_cgraph' AND e.callee_usr = :usr""",
    ),
    "runtime_callers": (
        "Callers left in each linked binary",
        """SELECT c.usr, c.name, e.target FROM call_edges e JOIN symbols c ON c.usr = e.caller_usr
           WHERE e.source = 'objdump' AND e.callee_usr = :usr""",
    ),
    "call_decisions": (
        "Every pass's decision about one call, and how many inlined bodies survived",
        """SELECT r.pass, r.inlined, r.reason, r.file, r.line, coalesce(i.n, 0) AS surviving_bodies
           FROM inline_records r LEFT JOIN (
             SELECT caller_usr, callee_usr, count(*) AS n FROM inline_instances
             GROUP BY caller_usr, callee_usr) i
             ON i.caller_usr = r.caller_usr AND i.callee_usr = r.callee_usr
           WHERE r.caller_usr = :caller_usr AND r.callee_usr = :callee_usr""",
    ),
    "inlined_into": (
        "Where the body of a function was copied to",
        """SELECT c.usr, c.name, i.depth, i.file, i.line, i.object
           FROM inline_instances i JOIN symbols c ON c.usr = i.caller_usr
           WHERE i.callee_usr = :usr""",
    ),
    "source_blob": (
        "Stored content of a path",
        """SELECT s.path, s.blob_hash, b.size FROM sources s JOIN blobs b ON b.hash = s.blob_hash
           WHERE s.path = :path""",
    ),
    "reachability": (
        "Targets that keep a symbol",
        """SELECT r.target, r.reachable, r.section_kept FROM symbol_reachability r
           WHERE r.usr = :usr""",
    ),
    "link_winner": (
        "Object that supplied a symbol in one target",
        """SELECT l.winning_object, l.linkage_kind, l.archive FROM link_resolutions l
           WHERE l.usr = :usr AND l.target = :target""",
    ),
    "external_declaration": (
        "Declaration sites in packed external headers",
        """SELECT x.abs_path, x.blob_hash, d.decl_line
           FROM symbol_definitions d JOIN external_sources x ON x.abs_path = d.decl_file
           WHERE d.usr = :usr""",
    ),
    "generated_file": (
        "Stored content of a build-tree file",
        """SELECT g.builddir_rel, g.blob_hash, b.size
           FROM generated_sources g JOIN blobs b ON b.hash = g.blob_hash
           WHERE g.builddir_rel = :builddir_rel""",
    ),
}
