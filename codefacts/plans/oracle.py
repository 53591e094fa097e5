"""Independent SQL formulations of the registered queries.

``SEED`` holds the mapping from the test tables to fact tables as common table
expressions; each query's text names the ones it needs and they are prepended.
"""

from __future__ import annotations

import re

from codefacts import schemas
from codefacts.plans import ingest_oracle

TARGET = "NATION_1"

_DOC_PATH = (
    "source || '/' || lang || '/doc_' || doc_id || "
    "CASE doc_id % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.h' ELSE '.txt' END"
)
# Index tokens: fold case and Latin diacritics, split on anything but letters and digits.
_TOKENS = "regexp_split_to_array(lower(strip_accents({0})), '[^\\p{{L}}\\p{{N}}]+')"

SEED: dict[str, str] = {
    "np": "SELECT count(*) AS n FROM part",
    "target_keys": """
        SELECT CAST(n_nationkey AS BIGINT) AS nk, n_name AS target,
               CASE n_regionkey % 3 WHEN 0 THEN 'executable' WHEN 1 THEN 'shared_library'
                    ELSE 'static_library' END AS kind FROM nation""",
    "linked_targets": "SELECT nk, target FROM target_keys WHERE kind <> 'static_library'",
    "targets": "SELECT target AS name, kind, 'cc -o ' || target AS link_command FROM target_keys",
    "part_base": """
        SELECT p_partkey AS pk, p_size AS size, p_name AS body, p_brand AS brand,
               replace(p_name, ' ', '_') || '_' || p_partkey AS name,
               CASE p_size % 4 WHEN 0 THEN 'internal' WHEN 3 THEN 'weak' ELSE 'external' END AS linkage,
               CASE p_type WHEN 'SMALL' THEN 'int (int, int)' WHEN 'ECONOMY' THEN 'void (void)'
                    ELSE 'int (' || lower(p_type) || ' *)' END AS signature,
               p_partkey % 7 = 0 AS address_taken,
               'src/' || lower(replace(p_brand, '#', '_')) || '.c' AS own_path
        FROM part""",
    "part_symbols": """
        SELECT *, 'function' AS kind,
               'c:' || CASE WHEN linkage = 'internal' THEN own_path ELSE '' END || '@F@' || name AS usr
        FROM part_base""",
    "symbols": """
        SELECT usr, name, kind, linkage, signature, address_taken FROM part_symbols
        UNION ALL
        SELECT 'c:@V@' || s_name, s_name, 'variable', 'external', '', false FROM supplier""",
    "symbol_names": """
        SELECT usr, name AS linkage_name FROM symbols
        UNION ALL
        SELECT usr, name || '.constprop.0' FROM part_symbols WHERE size > 40""",
    "doc_paths": f"SELECT doc_id, {_DOC_PATH} AS path FROM documents",
    "symbol_definitions": """
        SELECT DISTINCT p.usr, d.path AS file, CAST(floor(l_quantity) AS BIGINT) AS line,
               CASE WHEN l_returnflag = 'N' THEN '/usr/include/bench_' || (l_suppkey % 40) || '.h'
                    ELSE '' END AS decl_file,
               CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS BIGINT) ELSE 0 END AS decl_line,
               l_returnflag = 'R' AS is_weak, p.name AS linkage_name
        FROM lineitem JOIN part_symbols p ON p.pk = l_partkey AND p.size > 10
        JOIN doc_paths d ON d.doc_id = l_suppkey
        WHERE l_linenumber IN (6, 7)""",
    "edge_pairs": """
        SELECT a.usr AS caller_usr, b.usr AS callee_usr, l_linestatus AS status,
               l_orderkey % 25 AS nk
        FROM lineitem
        JOIN part_symbols a ON a.pk = l_partkey
        JOIN part_symbols b ON b.pk = (l_partkey * 31 + l_suppkey) % (SELECT n FROM np)
        WHERE l_linenumber = 1""",
    "call_edges": """
        SELECT DISTINCT caller_usr, callee_usr, 'compiler_cgraph' AS source,
               CAST(NULL AS VARCHAR) AS target FROM edge_pairs
        UNION ALL
        SELECT DISTINCT caller_usr, callee_usr, 'objdump', t.target
        FROM edge_pairs e JOIN linked_targets t ON t.nk = e.nk WHERE status = 'O'""",
    "object_candidates": """
        SELECT DISTINCT t.target, p.usr, p.name,
               CASE WHEN l_orderkey % 17 < 5 THEN 'lib/libshared.a.p/' ELSE 'app/app.p/' END
                 || 'u_' || (l_orderkey % 17) || '.c.o' AS object,
               CASE l_returnflag WHEN 'A' THEN 'T' WHEN 'N' THEN 'W' ELSE 'C' END AS nm_kind
        FROM lineitem JOIN part_symbols p ON p.pk = l_partkey AND p.linkage <> 'internal'
        JOIN linked_targets t ON t.nk = l_orderkey % 25
        WHERE l_linenumber IN (2, 3)""",
    "ranked_candidates": """
        SELECT *, row_number() OVER (PARTITION BY target, usr ORDER BY
                 CASE nm_kind WHEN 'T' THEN 1 WHEN 'W' THEN 2 ELSE 3 END, object) AS place
        FROM object_candidates""",
    "link_resolutions": """
        SELECT target, usr, object AS winning_object,
               CASE nm_kind WHEN 'T' THEN 'strong' WHEN 'W' THEN 'weak' ELSE 'common' END AS linkage_kind,
               CASE WHEN object LIKE '%.a.p/%' THEN split_part(object, '.a.p/', 1) || '.a' ELSE '' END
                 AS archive
        FROM ranked_candidates WHERE place = 1""",
    "link_losers": """
        SELECT DISTINCT c.target, c.usr, c.object
        FROM object_candidates c JOIN link_resolutions r ON r.target = c.target AND r.usr = c.usr
        WHERE c.object <> r.winning_object""",
    "symbol_reachability": """
        SELECT l.target, l.usr, 1 AS reachable, 1 AS section_kept
        FROM link_resolutions l JOIN symbols s ON s.usr = l.usr""",
    "inline_rows": """
        SELECT a.usr AS caller_usr, b.usr AS callee_usr, c.usr AS parent_usr,
               CASE l_linestatus WHEN 'O' THEN 'einline' ELSE 'inline' END AS pass,
               l_returnflag AS flag, CAST(floor(l_quantity) AS BIGINT) AS line,
               CAST(l_linenumber AS BIGINT) AS col, d.path AS file,
               'obj/u_' || (l_orderkey % 5) || '.c.o' AS object, l_orderkey % 3 + 1 AS depth
        FROM lineitem
        JOIN part_symbols a ON a.pk = l_partkey
        JOIN part_symbols b ON b.pk = (l_partkey * 31 + l_suppkey % 4) % (SELECT n FROM np)
        JOIN part_symbols c ON c.pk = (l_partkey * 17 + 3) % (SELECT n FROM np)
        JOIN doc_paths d ON d.doc_id = l_suppkey
        WHERE l_linenumber IN (4, 5)""",
    "inline_records": """
        SELECT caller_usr, callee_usr, pass, flag = 'A' AS inlined,
               CASE flag WHEN 'R' THEN 'call is unlikely and code size would grow'
                         WHEN 'N' THEN 'function body not available' ELSE '' END AS reason,
               file, line, col, object FROM inline_rows""",
    "inline_decisions": """
        SELECT caller_usr, callee_usr, bool_or(inlined) AS inlined
        FROM inline_records WHERE pass = 'inline' GROUP BY ALL""",
    "inline_instances": """
        SELECT callee_usr, caller_usr, CASE WHEN depth > 1 THEN parent_usr END AS parent_callee_usr,
               depth, file, line, col, object
        FROM inline_rows WHERE flag = 'A' AND pass = 'einline' AND line < 25""",
    "indirect_call_sites": """
        SELECT event_id AS site_id, p.usr AS caller_usr, 'src/user_' || user_id || '.c' AS file,
               CAST(floor(value) AS BIGINT) AS line,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS col,
               CASE event_type WHEN 'click' THEN 'int (int, int)' WHEN 'view' THEN 'void (void)'
                    WHEN 'purchase' THEN 'int (promo *)' WHEN 'signup' THEN 'int (large *)' ELSE '' END
                 AS callee_type,
               CASE event_type WHEN 'error' THEN '' ELSE 'ops.' || event_type END AS field_hint
        FROM events JOIN part_symbols p ON p.pk = user_id % (SELECT n FROM np)""",
    "icf_classes": """
        SELECT body, brand, min(usr) AS winner_usr,
               'obj/u_' || (min(pk) % 17) || '.c.o' AS object_file
        FROM part_symbols WHERE linkage <> 'internal' GROUP BY body, brand HAVING count(*) > 1""",
    "icf_groups": "SELECT winner_usr, object_file FROM icf_classes",
    "icf_group_members": """
        SELECT c.winner_usr, c.object_file, p.usr AS loser_usr
        FROM part_symbols p JOIN icf_classes c ON c.body = p.body AND c.brand = p.brand
        WHERE p.linkage <> 'internal' AND p.usr <> c.winner_usr""",
    "sources": f"""
        SELECT {_DOC_PATH} AS path, sha256(text) AS blob_hash, doc_id % 11 = 0 AS is_generated
        FROM documents""",
    "external_sources": """
        SELECT '/usr/include/bench_' || item_id || '.h' AS abs_path, sha256(text) AS blob_hash
        FROM benchmark""",
    "generated_sources": """
        SELECT 'gen/page_' || page_id || '.h' AS builddir_rel, sha256(html) AS blob_hash FROM pages""",
    "blobs": """
        SELECT DISTINCT sha256(content) AS hash, CAST(strlen(content) AS BIGINT) AS size, content
        FROM (SELECT text AS content FROM documents UNION ALL SELECT text FROM benchmark
              UNION ALL SELECT html FROM pages)""",
    "blob_lines": """
        SELECT hash, size, content, CASE WHEN right(content, 1) = chr(10) OR content = ''
               THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS rows
        FROM blobs""",
    "target_sources": """
        SELECT t.target, d.path AS file FROM doc_paths d JOIN target_keys t ON t.nk = d.doc_id % 25
        WHERE d.path LIKE '%.c'""",
    "live_files": f"""
        SELECT {_DOC_PATH} AS path,
               sha256(CASE WHEN doc_id % 13 = 0 THEN text || chr(10) || '// edited' || chr(10)
                           ELSE text END) AS live_hash
        FROM documents WHERE doc_id % 17 <> 0""",
    "type_fields": """
        SELECT 'c:include/types.h@S@' || lower(replace(p_brand, '#', '_')) AS type_usr,
               replace(p_name, ' ', '_') AS name,
               CASE WHEN p_name LIKE '%gear' THEN 'int (*)(int, int)' ELSE 'int' END AS type,
               row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1 AS ordinal,
               (row_number() OVER (PARTITION BY p_brand ORDER BY p_name) - 1) * 8 AS byte_offset
        FROM (SELECT DISTINCT p_brand, p_name FROM part)""",
    "enum_constants": """
        SELECT 'c:include/types.h@E@event_type@' || upper(event_type) AS usr,
               'c:include/types.h@E@event_type' AS type_usr, upper(event_type) AS name,
               row_number() OVER (ORDER BY event_type) AS value
        FROM (SELECT DISTINCT event_type FROM events)""",
    "types": """
        SELECT 'c:include/types.h@T@' || name AS usr, name, 'typedef' AS kind,
               'include/types.h' AS decl_file, length(name) AS decl_line, CAST(NULL AS BIGINT) AS byte_size,
               CASE name WHEN 'small' THEN 'enum event_type' ELSE 'int' END AS underlying
        FROM (SELECT DISTINCT lower(p_type) AS name FROM part)
        UNION ALL
        SELECT 'c:include/types.h@S@' || name, name, 'struct', 'include/types.h', length(name),
               n * 8, ''
        FROM (SELECT lower(replace(p_brand, '#', '_')) AS name, count(DISTINCT p_name) AS n
              FROM part GROUP BY 1)
        UNION ALL
        SELECT 'c:include/types.h@E@event_type', 'event_type', 'enum', 'include/types.h', 1, 4, ''
        WHERE EXISTS (SELECT 1 FROM events)""",
    "symbol_tokens": f"""
        SELECT DISTINCT token, usr FROM (
          SELECT usr, unnest({_TOKENS.format("name || ' ' || signature")}) AS token FROM symbols)
        WHERE token <> ''""",
    "type_tokens": f"""
        SELECT DISTINCT token, usr FROM (
          SELECT usr, unnest({_TOKENS.format("name || ' ' || underlying")}) AS token FROM types)
        WHERE token <> ''""",
    # Parameters chosen inside the data.
    "cgraph": "SELECT caller_usr, callee_usr FROM call_edges WHERE source = 'compiler_cgraph'",
    "linked_calls": "SELECT caller_usr, callee_usr, target FROM call_edges WHERE source = 'objdump'",
    "top_callee": """
        SELECT callee_usr AS usr FROM cgraph GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_caller": """
        SELECT caller_usr AS usr FROM cgraph GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_linked_callee": """
        SELECT callee_usr AS usr FROM linked_calls GROUP BY 1
        ORDER BY count(DISTINCT caller_usr) DESC, 1 LIMIT 1""",
    "top_linked_caller": """
        SELECT caller_usr AS usr FROM linked_calls GROUP BY 1
        ORDER BY count(DISTINCT callee_usr) DESC, 1 LIMIT 1""",
    "top_defined": """
        SELECT usr FROM symbol_definitions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_losing": "SELECT usr FROM link_losers GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1",
    "top_losing_target": """
        SELECT min(target) AS target FROM link_losers WHERE usr = (SELECT usr FROM top_losing)""",
    "top_inliner": """
        SELECT caller_usr AS usr FROM inline_records GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_host": """
        SELECT caller_usr AS usr FROM inline_instances GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_inlinee": """
        SELECT callee_usr AS usr FROM inline_instances GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "top_struct": """
        SELECT type_usr AS usr FROM type_fields GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""",
    "clone_name": """
        SELECT min(linkage_name) AS name FROM symbol_names WHERE linkage_name LIKE '%.constprop%'""",
    "files": """
        SELECT 0 AS table_ord, path, blob_hash, is_generated FROM sources
        UNION ALL SELECT 1, builddir_rel, blob_hash, true FROM generated_sources""",
    "files_external": """
        SELECT * FROM files UNION ALL SELECT 2, abs_path, blob_hash, false FROM external_sources""",
    "target_files": f"""
        SELECT 0 AS table_ord, path, blob_hash, is_generated FROM sources
        WHERE path IN (SELECT file FROM target_sources WHERE target = '{TARGET}')""",
    "line_rows": """
        SELECT hash, unnest(rows) AS row, unnest(range(1, len(rows) + 1)) AS line FROM blob_lines""",
    # The k-th occurrence starts after the first k pieces and k-1 patterns.
    "hits": """
        SELECT hash, line, strlen(array_to_string(pieces[1:k], 'ou')) + 1 AS col
        FROM (SELECT hash, line, string_split(row, 'ou') AS pieces,
                     unnest(range(1, len(string_split(row, 'ou')))) AS k
              FROM line_rows WHERE contains(row, 'ou'))""",
    "matched_files": """
        SELECT path, count(*) AS n FROM files JOIN hits ON hash = blob_hash GROUP BY path""",
    "verdicts": """
        SELECT caller_usr, callee_usr, object,
               CASE WHEN bool_or(body) THEN 'inlined_and_present'
                    WHEN bool_or(inlined) THEN 'inlined_then_folded' ELSE 'declined' END AS verdict,
               coalesce(
                 first({'p': pass, 'r': reason} ORDER BY file, line, col, reason)
                   FILTER (NOT inlined AND pass = 'inline'),
                 first({'p': pass, 'r': reason} ORDER BY file DESC, line DESC, col DESC, reason DESC)
                   FILTER (NOT inlined AND pass = 'einline')) AS why
        FROM (SELECT caller_usr, callee_usr, object, pass, inlined, reason, file, line, col, false AS body
              FROM inline_records
              UNION ALL
              SELECT caller_usr, callee_usr, object, NULL, NULL, NULL, file, line, col, true
              FROM inline_instances)
        GROUP BY caller_usr, callee_usr, object""",
    "per_object": """
        SELECT caller_usr, callee_usr, object, verdict,
               CASE verdict WHEN 'declined' THEN why.p ELSE '' END AS pass,
               CASE verdict WHEN 'declined' THEN why.r ELSE '' END AS reason
        FROM verdicts""",
    "overall": """
        SELECT caller_usr, callee_usr,
               CASE WHEN count(DISTINCT verdict) > 1 THEN 'mixed' ELSE min(verdict) END AS verdict,
               CASE WHEN count(DISTINCT verdict) = 1 AND min(verdict) = 'declined'
                    THEN first(reason ORDER BY object) ELSE '' END AS reason
        FROM per_object GROUP BY caller_usr, callee_usr""",
    "address_taken_fns": """
        SELECT usr, name, kind, signature FROM symbols WHERE address_taken AND kind = 'function'""",
    "weak_defs": "SELECT usr FROM symbol_definitions WHERE is_weak",
    "kept": f"SELECT usr FROM link_resolutions WHERE target = '{TARGET}'",
}

_REF = "usr, name, kind, signature"
_INSTANCE = """
    SELECT i.callee_usr, i.caller_usr, i.parent_callee_usr, i.depth, i.file, i.line, i.col, i.object,
           a.name AS caller, b.name AS callee, p.name AS parent_callee
    FROM inline_instances i JOIN symbols a ON a.usr = i.caller_usr
    JOIN symbols b ON b.usr = i.callee_usr LEFT JOIN symbols p ON p.usr = i.parent_callee_usr"""
_PATHS = """
    SELECT array_to_string(names, ' -> ') AS names, array_to_string(usrs, ' -> ') AS usrs, hops
    FROM paths WHERE tip = (SELECT usr FROM top_callee)"""
_TYPE_HIT = """
    SELECT 0 AS ord, usr, name, kind, decl_file, decl_line, underlying, coalesce(byte_size, 0) AS byte_size,
           '' AS enum_name, CAST(NULL AS BIGINT) AS value FROM types"""
_CONSTANT_HIT = """
    SELECT 1 AS ord, c.usr, c.name, 'enum_constant' AS kind, t.decl_file, t.decl_line, '' AS underlying,
           0 AS byte_size, t.name AS enum_name, c.value
    FROM enum_constants c LEFT JOIN types t ON t.usr = c.type_usr"""
_UNREACHABLE = f"""
    SELECT {_REF}, 1 AS section_kept FROM symbols WHERE usr NOT IN (SELECT usr FROM kept)
    AND EXISTS (SELECT 1 FROM targets WHERE name = '{TARGET}' AND kind <> 'static_library')"""
_ENTRY = """
    SELECT s.usr, s.name, s.kind, s.signature, CASE s.name WHEN 'main' THEN 'main' ELSE 'exported' END AS reason,
           CASE s.name WHEN 'main' THEN 1 ELSE 0 END AS is_main,
           coalesce(d.file, '') AS file, coalesce(d.line, 0) AS line
    FROM symbols s LEFT JOIN (
      SELECT usr, file, line, row_number() OVER (PARTITION BY usr ORDER BY file, line) AS place
      FROM symbol_definitions) d ON d.usr = s.usr AND d.place = 1
    WHERE s.usr IN (SELECT usr FROM kept) AND (s.name = 'main' OR s.linkage = 'external')"""
_LISTED = """
    SELECT f.table_ord, f.path, f.blob_hash, CAST(f.is_generated AS BIGINT) AS is_generated,
           coalesce(b.size, 0) AS size FROM {0} f LEFT JOIN blobs b ON b.hash = f.blob_hash"""
_DRIFT = """
    SELECT f.path, f.blob_hash AS indexed_hash, coalesce(l.live_hash, '') AS live_hash,
           CAST(l.live_hash IS NULL AS BIGINT) AS live_missing
    FROM {0} f LEFT JOIN live_files l ON l.path = f.path
    WHERE l.live_hash IS NULL OR l.live_hash <> f.blob_hash"""
_WEAK = f"SELECT {_REF} FROM symbols WHERE usr IN (SELECT usr FROM weak_defs) OR linkage = 'weak'"
_UNDEFINED = """
    SELECT o.target, s.usr, s.name, s.kind, s.signature, count(*) AS called_count
    FROM linked_calls o JOIN symbols s ON s.usr = o.callee_usr
    WHERE NOT EXISTS (SELECT 1 FROM symbol_definitions d WHERE d.usr = s.usr) {0}
    GROUP BY ALL"""
_ICF = """
    SELECT g.winner_usr, s.name AS winner, g.object_file, count(m.loser_usr) AS n_losers
    FROM icf_groups g JOIN symbols s ON s.usr = g.winner_usr
    LEFT JOIN icf_group_members m ON m.winner_usr = g.winner_usr AND m.object_file = g.object_file
    {0} GROUP BY ALL"""
_FTS = f"""
    SELECT usr, name, kind, linkage, signature FROM symbols s
    WHERE EXISTS (SELECT 1 FROM symbol_tokens t WHERE t.usr = s.usr AND starts_with(t.token, 'hot'))
      AND EXISTS (SELECT 1 FROM symbol_tokens t WHERE t.usr = s.usr AND starts_with(t.token, 'gea'))"""

ORACLE: dict[str, str] = {
    **{
        f"table_{name}": f"SELECT {columns} FROM {name}"
        for name, columns in {
            "targets": "*",
            "target_sources": "*",
            "sources": "path, blob_hash, CAST(is_generated AS BIGINT) AS is_generated",
            "external_sources": "*",
            "generated_sources": "*",
            "symbols": "* REPLACE (CAST(address_taken AS BIGINT) AS address_taken)",
            "symbol_names": "*",
            "symbol_definitions": "* REPLACE (CAST(is_weak AS BIGINT) AS is_weak)",
            "types": "*",
            "type_fields": "*",
            "enum_constants": "*",
            "call_edges": "*",
            "indirect_call_sites": "*",
            "inline_decisions": "* REPLACE (CAST(inlined AS BIGINT) AS inlined)",
            "inline_records": "* REPLACE (CAST(inlined AS BIGINT) AS inlined)",
            "inline_instances": "*",
            "icf_groups": "*",
            "icf_group_members": "*",
            "link_resolutions": "*",
            "symbol_tokens": "*",
            "type_tokens": "*",
        }.items()
    },
    "symbol_reachability": "SELECT * FROM symbol_reachability",
    "sources_blob_dedup": "SELECT hash, size, sha256(content) AS content_hash FROM blobs",
    "list_callers": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM cgraph e JOIN symbols s ON s.usr = e.caller_usr
        WHERE e.callee_usr = (SELECT usr FROM top_callee) ORDER BY s.name, s.usr LIMIT 500""",
    "list_callers_target": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM cgraph e JOIN symbols s ON s.usr = e.caller_usr
        WHERE e.callee_usr = (SELECT usr FROM top_callee) AND s.usr IN (SELECT usr FROM kept)
        ORDER BY s.name, s.usr LIMIT 500""",
    "list_callers_targets_of_hits": """
        SELECT l.usr, l.target FROM link_resolutions l WHERE l.usr IN (
          SELECT s.usr FROM symbols s WHERE s.usr IN (
            SELECT caller_usr FROM cgraph WHERE callee_usr = (SELECT usr FROM top_callee))
          ORDER BY s.name, s.usr LIMIT 500)""",
    "list_callees": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM cgraph e JOIN symbols s ON s.usr = e.callee_usr
        WHERE e.caller_usr = (SELECT usr FROM top_caller) ORDER BY s.name, s.usr LIMIT 500""",
    "list_callees_target": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM cgraph e JOIN symbols s ON s.usr = e.callee_usr
        WHERE e.caller_usr = (SELECT usr FROM top_caller) AND s.usr IN (SELECT usr FROM kept)
        ORDER BY s.name, s.usr LIMIT 500""",
    "list_linked_callers": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM linked_calls e JOIN symbols s ON s.usr = e.caller_usr
        WHERE e.target = '{TARGET}' AND e.callee_usr = (SELECT usr FROM top_linked_callee)""",
    "list_linked_callees": f"""
        SELECT DISTINCT s.{_REF.replace(', ', ', s.')} FROM linked_calls e JOIN symbols s ON s.usr = e.callee_usr
        WHERE e.target = '{TARGET}' AND e.caller_usr = (SELECT usr FROM top_linked_caller)""",
    "neighbors_in": "SELECT callee_usr AS usr, count(*) AS n FROM cgraph GROUP BY 1",
    "neighbors_out": "SELECT caller_usr AS usr, count(*) AS n FROM cgraph GROUP BY 1",
    "plane_diff": """
        SELECT caller_usr, callee_usr FROM cgraph EXCEPT SELECT caller_usr, callee_usr FROM linked_calls""",
    "list_call_paths": f"SELECT * FROM ({_PATHS} AND hops <= 6 ORDER BY paths.names, paths.usrs LIMIT 50)",
    "simple_paths": f"{_PATHS} AND hops <= 6",
    "find_symbol_fts": f"{_FTS} ORDER BY name, usr LIMIT 100",
    "find_symbol_fts_all": _FTS,
    "find_symbol_target": f"""{_FTS} AND kind = 'function' AND usr IN (SELECT usr FROM kept)
        ORDER BY name, usr LIMIT 100""",
    "find_symbol_exact": """
        SELECT usr, name, kind, linkage, signature FROM symbols s WHERE name = (SELECT name FROM clone_name)
        OR EXISTS (SELECT 1 FROM symbol_names n WHERE n.usr = s.usr
                   AND n.linkage_name = (SELECT name FROM clone_name))""",
    "describe_symbol": """
        SELECT usr, name, kind, linkage, signature, CAST(address_taken AS BIGINT) AS address_taken
        FROM symbols WHERE usr = (SELECT usr FROM top_defined)""",
    "describe_symbol_definitions": """
        SELECT d.file, d.line, d.decl_file, d.decl_line, CAST(d.is_weak AS BIGINT) AS is_weak,
               d.linkage_name, coalesce(s.blob_hash, '') AS blob_hash,
               CASE WHEN greatest(d.line - 5, 1) <= least(d.line + 5, len(b.rows)) AND d.line > 0
                    THEN greatest(d.line - 5, 1) ELSE 0 END AS start_line,
               CASE WHEN greatest(d.line - 5, 1) <= least(d.line + 5, len(b.rows)) AND d.line > 0
                    THEN least(d.line + 5, len(b.rows)) ELSE 0 END AS end_line,
               coalesce(array_to_string(b.rows[greatest(d.line - 5, 1):d.line + 5], chr(10)), '') AS snippet
        FROM symbol_definitions d LEFT JOIN sources s ON s.path = d.file
        LEFT JOIN blob_lines b ON b.hash = s.blob_hash
        WHERE d.usr = (SELECT usr FROM top_defined)""",
    "location_snippets": """
        SELECT d.file, d.line, s.blob_hash,
               CASE WHEN greatest(d.line - 5, 1) <= least(d.line + 5, len(b.rows)) AND d.line > 0
                    THEN greatest(d.line - 5, 1) ELSE 0 END AS start_line,
               CASE WHEN greatest(d.line - 5, 1) <= least(d.line + 5, len(b.rows)) AND d.line > 0
                    THEN least(d.line + 5, len(b.rows)) ELSE 0 END AS end_line,
               sha256(coalesce(array_to_string(b.rows[greatest(d.line - 5, 1):d.line + 5], chr(10)), ''))
                 AS text_hash
        FROM (SELECT DISTINCT file, line FROM symbol_definitions) d
        LEFT JOIN sources s ON s.path = d.file LEFT JOIN blob_lines b ON b.hash = s.blob_hash""",
    "describe_symbol_targets": """
        SELECT DISTINCT target FROM link_resolutions WHERE usr = (SELECT usr FROM top_losing)""",
    "describe_symbol_resolutions": """
        SELECT r.target, r.usr, r.winning_object, r.linkage_kind, r.archive,
               (SELECT count(*) FROM link_losers l WHERE l.target = r.target AND l.usr = r.usr) AS n_losing
        FROM link_resolutions r WHERE r.usr = (SELECT usr FROM top_losing)""",
    "targets_per_symbol": "SELECT usr, count(*) AS n_targets FROM link_resolutions GROUP BY 1",
    "list_targets": """
        SELECT t.name, t.kind,
               (SELECT count(*) FROM target_sources s WHERE s.target = t.name) AS source_count,
               (SELECT count(*) FROM link_resolutions l WHERE l.target = t.name) AS linked_symbols
        FROM targets t""",
    "describe_target": f"""
        SELECT name, kind, link_command,
               (SELECT count(*) FROM link_resolutions l WHERE l.target = '{TARGET}') AS linked_symbols,
               (SELECT count(*) FROM symbol_reachability r WHERE r.target = '{TARGET}') AS reachable
        FROM targets WHERE name = '{TARGET}'""",
    "describe_target_sources": f"""
        SELECT t.file, coalesce(s.blob_hash, '') AS blob_hash FROM target_sources t
        LEFT JOIN sources s ON s.path = t.file WHERE t.target = '{TARGET}'""",
    "describe_target_archives": f"""
        SELECT DISTINCT archive FROM link_resolutions WHERE target = '{TARGET}' AND archive <> ''""",
    "pick_winner": "SELECT target, usr, object, nm_kind FROM ranked_candidates WHERE place = 1",
    "collect_losers": "SELECT * FROM link_losers",
    "describe_link_resolution": """
        SELECT *, 1 AS reachable FROM link_resolutions WHERE usr = (SELECT usr FROM top_losing)
        AND target = (SELECT target FROM top_losing_target)""",
    "describe_link_losers": """
        SELECT object FROM link_losers WHERE usr = (SELECT usr FROM top_losing)
        AND target = (SELECT target FROM top_losing_target)""",
    "list_weak_symbols": _WEAK,
    "list_weak_symbols_target": f"{_WEAK} AND usr IN (SELECT usr FROM kept)",
    "list_weak_symbols_target_strict": f"""
        SELECT {_REF} FROM symbols WHERE (usr IN (SELECT usr FROM weak_defs) OR linkage = 'weak')
        AND usr IN (SELECT usr FROM kept)""",
    "list_weak_definitions": """
        SELECT d.usr, d.file, d.line, s.blob_hash FROM symbol_definitions d
        LEFT JOIN sources s ON s.path = d.file WHERE d.is_weak""",
    "list_undefined_symbols": _UNDEFINED.format(f"AND o.target = '{TARGET}'"),
    "list_undefined_symbols_all_targets": _UNDEFINED.format(""),
    "list_icf_groups": _ICF.format(""),
    "list_icf_groups_target": _ICF.format("WHERE g.winner_usr IN (SELECT usr FROM kept)"),
    "list_icf_losers": """
        SELECT m.winner_usr, m.object_file, m.loser_usr, s.name AS loser
        FROM icf_group_members m JOIN symbols s ON s.usr = m.loser_usr""",
    "list_unreachable_symbols": f"{_UNREACHABLE} ORDER BY name, usr LIMIT 500",
    "list_unreachable_symbols_all": _UNREACHABLE,
    "list_unreachable_symbols_static": f"""
        SELECT {_REF}, 1 AS section_kept FROM symbols
        WHERE (SELECT kind FROM targets WHERE name = (
                 SELECT min(name) FROM targets WHERE kind = 'static_library')) <> 'static_library'""",
    "list_entry_points": f"{_ENTRY} ORDER BY is_main DESC, s.name, s.usr LIMIT 500",
    "list_entry_points_all": _ENTRY,
    "describe_inlining_summary": """
        SELECT 'records' AS plane, pass AS key, CAST(inlined AS BIGINT) AS inlined, count(*) AS n
        FROM inline_records WHERE caller_usr = (SELECT usr FROM top_inliner) GROUP BY ALL
        UNION ALL
        SELECT 'instances', CAST(depth AS VARCHAR), 1, count(*)
        FROM inline_instances WHERE caller_usr = (SELECT usr FROM top_inliner) GROUP BY ALL
        UNION ALL
        SELECT 'cgraph_edges', '', CAST(inlined AS BIGINT), count(*)
        FROM inline_decisions WHERE caller_usr = (SELECT usr FROM top_inliner) GROUP BY ALL""",
    "describe_inlining_records": """
        SELECT r.* REPLACE (CAST(r.inlined AS BIGINT) AS inlined), a.name AS caller, b.name AS callee
        FROM inline_records r JOIN symbols a ON a.usr = r.caller_usr JOIN symbols b ON b.usr = r.callee_usr
        WHERE r.caller_usr = (SELECT usr FROM top_inliner)""",
    "describe_inlining_instances": f"{_INSTANCE} WHERE i.caller_usr = (SELECT usr FROM top_host)",
    "describe_inlining_decisions": """
        SELECT d.callee_usr, s.name AS callee, CAST(d.inlined AS BIGINT) AS inlined
        FROM inline_decisions d JOIN symbols s ON s.usr = d.callee_usr
        WHERE d.caller_usr = (SELECT usr FROM top_inliner)""",
    "list_inline_instances": f"{_INSTANCE} WHERE i.callee_usr = (SELECT usr FROM top_inlinee)",
    "inline_summary_all": """
        SELECT caller_usr, pass, CAST(inlined AS BIGINT) AS inlined, count(*) AS n
        FROM inline_records GROUP BY ALL""",
    "explain_call_per_object": "SELECT * FROM per_object",
    "explain_call_overall": """
        SELECT c.caller_usr, c.callee_usr, coalesce(o.verdict, 'no_decision_logged') AS verdict,
               coalesce(o.reason, '') AS reason, CAST(d.inlined AS BIGINT) AS cgraph_inlined,
               CASE WHEN (c.caller_usr, c.callee_usr) IN (SELECT (caller_usr, callee_usr) FROM linked_calls)
                    THEN 1 ELSE 0 END AS linked_edge
        FROM (SELECT caller_usr, callee_usr FROM cgraph
              UNION SELECT caller_usr, callee_usr FROM inline_records
              UNION SELECT caller_usr, callee_usr FROM inline_instances) c
        LEFT JOIN overall o USING (caller_usr, callee_usr)
        LEFT JOIN inline_decisions d USING (caller_usr, callee_usr)""",
    "list_indirect_call_sites": """
        SELECT i.*, s.name AS caller FROM indirect_call_sites i JOIN symbols s ON s.usr = i.caller_usr""",
    "list_indirect_call_sites_target": """
        SELECT i.*, s.name AS caller FROM indirect_call_sites i JOIN symbols s ON s.usr = i.caller_usr
        WHERE i.callee_type = 'int (int, int)' AND i.caller_usr IN (SELECT usr FROM kept)
        ORDER BY file, line, col, site_id LIMIT 500""",
    "list_address_taken_functions": "SELECT * FROM address_taken_fns",
    "list_address_taken_functions_typed": """
        SELECT * FROM address_taken_fns WHERE signature = 'int (int, int)' AND usr IN (SELECT usr FROM kept)""",
    "resolve_indirect_call": """
        SELECT usr, name, signature, 'type_match' AS evidence, 'candidate' AS confidence FROM address_taken_fns
        WHERE signature = (SELECT callee_type FROM indirect_call_sites WHERE callee_type <> ''
                           ORDER BY site_id LIMIT 1)""",
    "resolve_indirect_call_untyped": """
        SELECT usr, name, signature, 'address_taken' AS evidence, 'candidate' AS confidence
        FROM address_taken_fns WHERE EXISTS (SELECT 1 FROM indirect_call_sites WHERE callee_type = '')""",
    "resolve_indirect_call_counts": """
        SELECT site_id, callee_type, CASE callee_type WHEN '' THEN 'address_taken' ELSE 'type_match' END AS evidence,
               CASE callee_type WHEN '' THEN (SELECT count(*) FROM address_taken_fns)
                    ELSE (SELECT count(*) FROM address_taken_fns a WHERE a.signature = i.callee_type) END
                 AS n_candidates
        FROM indirect_call_sites i""",
    "find_type": f"""
        SELECT * FROM ({_TYPE_HIT} t
          WHERE EXISTS (SELECT 1 FROM type_tokens k WHERE k.usr = t.usr AND starts_with(k.token, 'brand'))
            AND EXISTS (SELECT 1 FROM type_tokens k WHERE k.usr = t.usr AND starts_with(k.token, '1'))
          UNION ALL {_CONSTANT_HIT} WHERE contains(lower(c.name), 'brand 1'))
        ORDER BY ord, name, usr LIMIT 100""",
    "find_type_constants": f"{_CONSTANT_HIT} WHERE contains(lower(c.name), 'ur')",
    "find_type_exact": f"""
        {_TYPE_HIT} WHERE name = 'event_type' UNION ALL {_CONSTANT_HIT} WHERE c.name = 'event_type'""",
    "describe_type": "SELECT * FROM types WHERE usr = (SELECT usr FROM top_struct)",
    "describe_type_fields": """
        SELECT name, type, ordinal, byte_offset FROM type_fields
        WHERE type_usr = (SELECT usr FROM top_struct)""",
    "describe_type_constants": """
        SELECT usr, name, value FROM enum_constants
        WHERE type_usr = (SELECT min(usr) FROM types WHERE kind = 'enum')""",
    "list_source_files": _LISTED.format("files_external"),
    "list_source_files_headers": _LISTED.format("files") + r" WHERE regexp_matches(f.path, '\.(h|hh|hpp|hxx|inc)$')",
    "list_source_files_target": _LISTED.format("target_files"),
    "list_source_files_membership": """
        SELECT t.file AS path, t.target FROM target_sources t JOIN sources s ON s.path = t.file""",
    "read_source": """
        SELECT s.path, s.blob_hash, CAST(len(b.rows) AS BIGINT) AS line_count,
               array_to_string(b.rows[2:5], chr(10)) AS content
        FROM sources s JOIN blob_lines b ON b.hash = s.blob_hash
        WHERE s.path = (SELECT max(path) FROM sources)""",
    "read_source_slice": """
        SELECT s.path, CAST(len(b.rows) AS BIGINT) AS line_count,
               sha256(array_to_string(b.rows[2:5], chr(10))) AS text_hash
        FROM sources s JOIN blob_lines b ON b.hash = s.blob_hash""",
    "verify_source": """
        SELECT path, blob_hash AS indexed_hash, 1 AS matches, 'expected_hash' AS comparison_source
        FROM sources WHERE path = (SELECT max(path) FROM sources)""",
    "verify_source_live": """
        SELECT s.path, s.blob_hash AS indexed_hash,
               CASE WHEN l.live_hash = s.blob_hash THEN 1 ELSE 0 END AS matches,
               CASE WHEN l.live_hash IS NULL THEN 1 ELSE 0 END AS live_missing,
               'live_file' AS comparison_source
        FROM sources s LEFT JOIN live_files l ON l.path = s.path
        WHERE s.path = (SELECT max(path) FROM sources)""",
    "list_source_drift": _DRIFT.format("sources"),
    "list_source_drift_target": _DRIFT.format("target_files"),
    "search_source_matches": """
        SELECT f.table_ord, f.path, h.line, h.col FROM files_external f JOIN hits h ON h.hash = f.blob_hash""",
    "search_source_page": """
        SELECT p.path, p.line, p.col,
               sha256(array_to_string(b.rows[greatest(p.line - 1, 1):p.line + 1], chr(10))) AS snippet_hash
        FROM (SELECT f.table_ord, f.path, f.blob_hash, h.line, h.col
              FROM files f JOIN hits h ON h.hash = f.blob_hash
              ORDER BY table_ord, path, line, col LIMIT 200) p
        JOIN blob_lines b ON b.hash = p.blob_hash""",
    "search_source_regex": """
        SELECT path, line, match_text, count(*) AS n FROM (
          SELECT f.path, l.line, unnest(regexp_extract_all(l.row, '[aeé]ux')) AS match_text
          FROM files f JOIN line_rows l ON l.hash = f.blob_hash) GROUP BY ALL""",
    "search_source_by_file": "SELECT path, n FROM matched_files ORDER BY n DESC, path LIMIT 200",
    "search_source_by_dir": r"""
        SELECT CASE WHEN path LIKE '_%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory,
               CAST(sum(n) AS BIGINT) AS n
        FROM matched_files GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200""",
    "search_source_summary": """
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total, count(*) AS files_with_matches,
               (SELECT count(*) FROM files) AS files_scanned FROM matched_files""",
}

_RECIPE_PARAMETERS = {
    "symbol_by_name": {"name": "(SELECT name FROM clone_name)"},
    "definitions": {"usr": "(SELECT usr FROM top_defined)"},
    "external_declaration": {"usr": "(SELECT usr FROM top_defined)"},
    "source_callers": {"usr": "(SELECT usr FROM top_callee)"},
    "runtime_callers": {
        "usr": "(SELECT callee_usr FROM linked_calls GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    },
    "call_decisions": {
        "caller_usr": "(SELECT caller_usr FROM inline_records GROUP BY caller_usr, callee_usr "
        "ORDER BY count(*) DESC, caller_usr, callee_usr LIMIT 1)",
        "callee_usr": "(SELECT callee_usr FROM inline_records GROUP BY caller_usr, callee_usr "
        "ORDER BY count(*) DESC, caller_usr, callee_usr LIMIT 1)",
    },
    "inlined_into": {"usr": "(SELECT usr FROM top_inlinee)"},
    "source_blob": {"path": "(SELECT max(path) FROM sources)"},
    "reachability": {
        "usr": "(SELECT usr FROM link_resolutions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    },
    "link_winner": {
        "usr": "(SELECT usr FROM link_resolutions ORDER BY usr, target LIMIT 1)",
        "target": "(SELECT target FROM link_resolutions ORDER BY usr, target LIMIT 1)",
    },
    "generated_file": {"builddir_rel": "(SELECT max(builddir_rel) FROM generated_sources)"},
}
_BOOLEAN_COLUMNS = {"definitions": ["is_weak"], "call_decisions": ["inlined"]}


def _recipe(name: str) -> str:
    _, sql = schemas.RECIPES[name]
    for parameter, value in _RECIPE_PARAMETERS[name].items():
        sql = re.sub(rf":{parameter}\b", value, sql)
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _BOOLEAN_COLUMNS.get(name, []))
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


ORACLE.update({f"recipe_{name}": _recipe(name) for name in schemas.RECIPES})
ORACLE.update(ingest_oracle.ORACLE)
SEED.update(ingest_oracle.SEED)

_RECURSIVE = {
    "paths": """
        SELECT [usr] AS usrs, [name] AS names, usr AS tip, CAST(0 AS BIGINT) AS hops FROM symbols
        WHERE usr = (SELECT usr FROM top_caller)
        UNION ALL
        SELECT list_append(p.usrs, e.callee_usr), list_append(p.names, s.name), e.callee_usr, p.hops + 1
        FROM paths p JOIN cgraph e ON e.caller_usr = p.tip JOIN symbols s ON s.usr = e.callee_usr
        WHERE p.hops < 6 AND NOT list_contains(p.usrs, e.callee_usr)
          AND p.tip <> (SELECT usr FROM top_callee)""",
}


def _needs(sql: str, ctes: dict[str, str]) -> list[str]:
    """Names of the table expressions a text uses, each after the ones it uses itself."""
    done: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in ctes:
            if name in done or name in trail or not re.search(rf"\b{name}\b", text):
                continue
            visit(ctes[name], (*trail, name))
            done.append(name)

    visit(sql, ())
    return done


def render(sql: str) -> str:
    ctes = {**SEED, **_RECURSIVE}
    used = _needs(sql, ctes)
    if not used:
        return sql
    body = ",\n".join(f"{name} AS ({ctes[name]})" for name in used)
    text = sql.strip()
    if text.startswith("WITH "):
        return f"WITH RECURSIVE {body},\n{text[len('WITH '):]}"
    return f"WITH RECURSIVE {body}\n{text}"


# The uncut form of a paged query is its SQL without the page.
UNCUT = (
    "list_callers", "list_callers_target", "list_callees", "list_callees_target", "find_symbol_target", "find_type",
    "list_indirect_call_sites_target", "search_source_by_file", "search_source_by_dir",
)
ORACLE |= {f"{name}_all": re.sub(r"\s+ORDER BY [^()]* LIMIT \d+\s*$", "", ORACLE[name]) for name in UNCUT}

# Over a snapshot the answers are those of the facts that were published.
ORACLE |= {
    f"published_{name}": ORACLE[same]
    for name, same in {
        "list_callers": "list_callers_all", "list_callers_target": "list_callers_target_all", "list_linked_callers": "list_linked_callers",
        "list_inline_instances": "list_inline_instances", "find_symbol_exact": "find_symbol_exact", "describe_type": "describe_type_fields",
        "location_snippets": "location_snippets", "list_call_paths": "list_call_paths",
    }.items()
}
ORACLE["scan_datasource_ci"] = ORACLE["scan_ci"]
ORACLE |= {
    "published_in_target": f"""
        SELECT usr, name, kind, coalesce(signature, '') AS signature FROM symbols
        WHERE usr IN (SELECT usr FROM link_resolutions WHERE target = '{TARGET}')""",
    "published_explain_call": f"""
        WITH pair AS (SELECT caller_usr, callee_usr FROM inline_records GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 1)
        SELECT coalesce(o.verdict, 'no_decision_logged') AS verdict, coalesce(o.reason, '') AS reason,
               (SELECT CAST(bool_or(d.inlined) AS BIGINT) FROM inline_decisions d, pair p
                WHERE d.caller_usr = p.caller_usr AND d.callee_usr = p.callee_usr) AS cgraph_inlined,
               (SELECT CAST(count(*) > 0 AS BIGINT) FROM linked_calls l, pair p
                WHERE l.target = '{TARGET}' AND l.caller_usr = p.caller_usr AND l.callee_usr = p.callee_usr) AS linked_edge
        FROM pair LEFT JOIN overall o ON o.caller_usr = pair.caller_usr AND o.callee_usr = pair.callee_usr""",
    "published_search_source": """
        SELECT f.path, h.line, h.col,
               sha256(array_to_string(b.rows[greatest(h.line - 1, 1):h.line + 1], chr(10))) AS snippet_hash
        FROM files f
        JOIN (SELECT hash, line, strlen(array_to_string(pieces[1:k], 'ment la')) + 1 AS col
              FROM (SELECT hash, line, string_split(row, 'ment la') AS pieces,
                           unnest(range(1, len(string_split(row, 'ment la')))) AS k
                    FROM line_rows WHERE contains(row, 'ment la'))) h ON h.hash = f.blob_hash
        JOIN blob_lines b ON b.hash = h.hash""",
    # The k-th match starts after the first k pieces and k-1 matches.
    "published_search_source_regex": """
        SELECT f.path, h.line, h.met[h.k] AS match_text,
               CAST(strlen(array_to_string(h.pieces[1:h.k], '')) + strlen(array_to_string(h.met[1:h.k - 1], '')) + 1 AS BIGINT) AS col
        FROM files f
        JOIN (SELECT hash, line, string_split_regex(row, '[aeé]ux') AS pieces, regexp_extract_all(row, '[aeé]ux') AS met,
                     unnest(range(1, len(regexp_extract_all(row, '[aeé]ux')) + 1)) AS k
              FROM line_rows) h ON h.hash = f.blob_hash""",
    "published_sql_query": """
        SELECT s.kind, e.source, count(*) AS n, count(DISTINCT e.target) AS n_targets
        FROM call_edges e JOIN symbols s ON s.usr = e.callee_usr
        WHERE EXISTS (SELECT 1 FROM symbol_names n WHERE n.usr = s.usr)
        GROUP BY s.kind, e.source""",
}


def oracle_sql() -> dict[str, str]:
    return {name: render(sql) for name, sql in ORACLE.items()}
