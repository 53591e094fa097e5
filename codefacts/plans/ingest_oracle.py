"""SQL counterparts of the collection-side queries."""

from __future__ import annotations

SEED: dict[str, str] = {
    "unit_parts": """
        SELECT u.unit, 'obj/u_' || u.unit || '.c.o' AS object, p.*
        FROM (SELECT DISTINCT l_orderkey % 17 AS unit, l_partkey AS ppk FROM lineitem) u
        JOIN part_symbols p ON p.pk = u.ppk""",
    "cgraph_nodes": """
        SELECT object, unit, CAST(pk AS VARCHAR) AS local_id, name, name AS linkage_name,
               size > 10 AS analyzed, (pk + unit) % 5 = 0 AS body_removed, linkage AS link,
               address_taken AS taken, '' AS clone_of
        FROM unit_parts
        UNION ALL
        SELECT object, unit, CAST(pk + (SELECT n FROM np) AS VARCHAR), name || '.constprop.0',
               name || '.constprop.0', true, false, 'internal', unit = 3, CAST(pk AS VARCHAR)
        FROM unit_parts WHERE size > 40""",
    "call_rows": """
        SELECT DISTINCT l_orderkey % 17 AS unit, l_partkey AS caller_pk,
               (l_partkey * 31 + l_suppkey) % (SELECT n FROM np) AS callee_pk, l_linestatus = 'F' AS inl
        FROM lineitem WHERE l_linenumber = 1""",
    "unit_list": "SELECT DISTINCT l_orderkey % 17 AS unit FROM lineitem",
    "unit_paths": """
        SELECT 'obj/u_' || unit || '.c.o' AS object, unit,
               CASE WHEN unit < 15 THEN 'src/unit_' ELSE '/ext/unit_' END || unit || '.c' AS tu
        FROM unit_list""",
    "observed": """
        SELECT n.object, n.unit, local_id, n.name, linkage_name, link, taken,
               'c:' || CASE WHEN link = 'internal' THEN u.tu ELSE '' END || '@F@' || n.name AS usr,
               analyzed AND NOT body_removed AS has_body,
               CASE WHEN p.size > 25 THEN 'src/unit_' || n.unit || '.c' ELSE u.tu END AS def_file,
               CASE WHEN p.size > 25 THEN p.pk % 100 + 1 ELSE 0 END AS def_line, p.pk, p.size, p.signature AS sig
        FROM cgraph_nodes n JOIN unit_paths u ON u.object = n.object
        JOIN unit_parts p ON p.object = n.object AND CAST(p.pk AS VARCHAR) = n.local_id
        WHERE clone_of = ''""",
    "clones": """
        SELECT n.object, n.local_id, o.usr, n.name, n.linkage_name, n.taken
        FROM cgraph_nodes n JOIN observed o ON o.object = n.object AND o.local_id = n.clone_of
        WHERE n.clone_of <> ''""",
    "identities": """
        SELECT object, local_id, usr FROM observed UNION ALL SELECT object, local_id, usr FROM clones""",
    "resolved_calls": """
        SELECT a.usr AS caller_usr, b.usr AS callee_usr, c.inl
        FROM call_rows c
        JOIN identities a ON a.object = 'obj/u_' || c.unit || '.c.o' AND a.local_id = CAST(caller_pk AS VARCHAR)
        JOIN identities b ON b.object = 'obj/u_' || c.unit || '.c.o' AND b.local_id = CAST(callee_pk AS VARCHAR)""",
    "record_rows": """
        SELECT DISTINCT l_orderkey % 17 AS unit, 'obj/u_' || (l_orderkey % 17) || '.c.o' AS object,
               l_partkey AS caller_pk, (l_partkey * 31 + l_suppkey % 4) % (SELECT n FROM np) AS callee_pk,
               CASE l_linestatus WHEN 'O' THEN 'einline' ELSE 'inline' END AS pass,
               l_returnflag = 'A' AS inl,
               CASE l_returnflag WHEN 'R' THEN 'call is unlikely and code size would grow'
                    WHEN 'N' THEN 'function body not available' ELSE '' END AS reason,
               'src/supp_' || l_suppkey || '.c' AS file, CAST(floor(l_quantity) AS BIGINT) AS line,
               CAST(l_linenumber AS BIGINT) AS col
        FROM lineitem WHERE l_linenumber IN (4, 5)""",
    "resolved_records": """
        SELECT a.usr AS caller_usr, b.usr AS callee_usr, r.pass, r.inl, r.reason, r.file, r.line, r.col, r.object
        FROM record_rows r
        JOIN identities a ON a.object = r.object AND a.local_id = CAST(caller_pk AS VARCHAR)
        JOIN identities b ON b.object = r.object AND b.local_id = CAST(callee_pk AS VARCHAR)""",
    "fold_rows": """
        SELECT p.object, w.winner_pk, p.pk AS loser_pk, q.name AS winner, p.name AS loser
        FROM unit_parts p JOIN (SELECT object, body, brand, min(pk) AS winner_pk FROM unit_parts
                                GROUP BY ALL HAVING count(*) > 1) w
          ON w.object = p.object AND w.body = p.body AND w.brand = p.brand AND p.pk <> w.winner_pk
        JOIN part_symbols q ON q.pk = w.winner_pk""",
    "resolved_folds": """
        SELECT DISTINCT a.usr AS winner_usr, f.object AS object_file, b.usr AS loser_usr
        FROM fold_rows f
        JOIN identities a ON a.object = f.object AND a.local_id = CAST(winner_pk AS VARCHAR)
        JOIN identities b ON b.object = f.object AND b.local_id = CAST(loser_pk AS VARCHAR)
        WHERE a.usr <> b.usr""",
    "merged": """
        SELECT o.usr, min(o.name) AS name, min(o.link) AS linkage,
               bool_or(o.taken) OR coalesce(bool_or(c.taken), false) AS taken, bool_or(o.has_body) AS has_def
        FROM observed o LEFT JOIN clones c ON c.usr = o.usr GROUP BY o.usr""",
    "merged_defs": """
        SELECT usr, def_file AS file, def_line AS line, linkage_name,
               first(link = 'weak' ORDER BY object) AS is_weak
        FROM observed WHERE has_body GROUP BY ALL""",
    "link_rows": """
        SELECT DISTINCT t.target, t.nk, p.pk, p.name,
               CASE WHEN l_orderkey % 17 < 5 THEN 'lib/libshared.a.p/' ELSE 'app/app.p/' END
                 || 'u_' || (l_orderkey % 17) || '.c.o' AS object, l_orderkey % 17 AS unit,
               CASE WHEN p.linkage = 'internal' THEN 't' WHEN l_returnflag = 'A' THEN 'T'
                    WHEN l_returnflag = 'N' THEN 'W' ELSE 'C' END AS nm_kind
        FROM lineitem JOIN part_symbols p ON p.pk = l_partkey
        JOIN linked_targets t ON t.nk = l_orderkey % 25 WHERE l_linenumber IN (2, 3)""",
    "listing": """
        SELECT target, pk, name, max(nm_kind) AS nm_kind, lpad(lower(hex(pk * 16 + 4096)), 16, '0') AS address
        FROM link_rows GROUP BY target, pk, name""",
    "object_defs": "SELECT DISTINCT name, object, nm_kind, unit FROM link_rows",
    "map_origins": """
        SELECT target, name, max(object) AS object FROM link_rows WHERE (nk + pk) % 7 <> 0 GROUP BY target, name""",
    "looked_up": """
        SELECT name, usr FROM (
          SELECT name, usr, row_number() OVER (PARTITION BY name ORDER BY
                   CASE WHEN usr IN (SELECT usr FROM symbol_definitions) THEN 0 ELSE 1 END, usr) AS place
          FROM (SELECT usr, name FROM symbols UNION SELECT usr, linkage_name FROM symbol_names))
        WHERE place = 1""",
    "sole_defs": """
        SELECT name, min(object) AS object FROM object_defs GROUP BY name HAVING count(*) = 1""",
    "nm_resolved": """
        SELECT * FROM (
          SELECT l.target, l.name, l.nm_kind, l.address, m.object AS map_object,
                 coalesce(a.usr, b.usr, n.usr) AS usr
          FROM listing l LEFT JOIN map_origins m ON m.target = l.target AND m.name = l.name
          LEFT JOIN sole_defs s ON s.name = l.name
          LEFT JOIN symbols a ON l.nm_kind = 't' AND a.usr =
            'c:src/brand_' || regexp_extract(m.object, 'u_([0-9]+)\\.c', 1) || '.c@F@' || l.name
          LEFT JOIN symbols b ON l.nm_kind = 't' AND b.usr =
            'c:src/brand_' || regexp_extract(s.object, 'u_([0-9]+)\\.c', 1) || '.c@F@' || l.name
          LEFT JOIN looked_up n ON n.name = l.name) WHERE usr IS NOT NULL""",
    "addresses": """
        SELECT target, ltrim(address, '0') AS address, usr FROM nm_resolved WHERE nm_kind IN ('T', 't', 'W')""",
    "picked": """
        SELECT name, object FROM (
          SELECT name, object, row_number() OVER (PARTITION BY name ORDER BY
            CASE nm_kind WHEN 'T' THEN 0 WHEN 'W' THEN 1 WHEN 'C' THEN 2 ELSE 3 END, object) AS place
          FROM object_defs) WHERE place = 1""",
    "resolved_links": """
        SELECT r.target, r.usr, r.name, coalesce(r.map_object, p.object) AS winning_object,
               CASE nm_kind WHEN 'T' THEN 'strong' WHEN 'W' THEN 'weak' ELSE 'common' END AS linkage_kind
        FROM nm_resolved r LEFT JOIN picked p ON p.name = r.name WHERE nm_kind <> 't'""",
    "branch_rows": """
        SELECT DISTINCT t.target, a.pk AS caller_pk, b.pk AS callee_pk, a.name AS caller, b.name AS callee
        FROM lineitem JOIN linked_targets t ON t.nk = l_orderkey % 25
        JOIN part_symbols a ON a.pk = l_partkey
        JOIN part_symbols b ON b.pk = (l_partkey * 31 + l_suppkey) % (SELECT n FROM np)
        WHERE l_linenumber = 1 AND l_linestatus = 'O'""",
    "debug_lookup": """
        SELECT o.object, o.unit, o.pk, o.name, coalesce(
                 (SELECT min(usr) FROM merged m WHERE m.usr = 'c:@F@' || o.name),
                 (SELECT min(usr) FROM merged m WHERE o.unit < 15 AND
                    m.usr = 'c:src/unit_' || o.unit || '.c@F@' || o.name)) AS usr
        FROM observed o""",
    "subprograms": """
        SELECT d.object, d.pk AS ordinal, d.usr, o.sig, o.size, 'include/h_' || d.unit || '.h' AS decl_file,
               d.pk % 50 + 1 AS decl_line
        FROM debug_lookup d JOIN observed o ON o.object = d.object AND o.pk = d.pk WHERE d.usr IS NOT NULL""",
    "bodies_written": """
        SELECT usr, first(decl_file ORDER BY object, ordinal) AS wf, first(decl_line ORDER BY object, ordinal) AS wl
        FROM subprograms WHERE size BETWEEN 11 AND 25 GROUP BY usr""",
    "bodies_declared": """
        SELECT usr, first(decl_file ORDER BY object, ordinal) AS df, first(decl_line ORDER BY object, ordinal) AS dl
        FROM subprograms WHERE size <= 10 GROUP BY usr""",
    "type_records": """
        SELECT *, 'c:include/types.h@' || CASE kind WHEN 'typedef' THEN 'T' WHEN 'union' THEN 'U' ELSE 'S' END
               || '@' || CASE WHEN kind <> 'typedef' AND tname = '' THEN '__anon_' || num || '_9' ELSE tname END
                 AS usr
        FROM (SELECT object, unit, num, CASE WHEN num % 5 = 0 THEN '' ELSE 'brand_' || num END AS tname,
                     CASE WHEN num % 4 = 0 THEN 'union' WHEN num % 3 = 0 THEN 'typedef' ELSE 'struct' END AS kind
              FROM (SELECT DISTINCT object, unit, CAST(regexp_extract(brand, '([0-9]+)$', 1) AS BIGINT) AS num
                    FROM unit_parts))
        WHERE num <> 7 AND NOT (kind = 'typedef' AND tname = '')""",
    "touched": """
        SELECT 'project' AS bucket, path AS key FROM sources
        UNION ALL SELECT 'external', abs_path FROM external_sources
        UNION ALL SELECT 'generated', builddir_rel FROM generated_sources
        UNION ALL SELECT 'outside', '/srv' || abs_path FROM external_sources""",
    "unit_dumps": """
        SELECT 'obj/u_' || (l_orderkey % 997) || '.c.o' AS object,
               bool_or(l_returnflag = 'A') AS ci, bool_or(l_linenumber = 7) AS cgraph,
               bool_or(l_quantity > 49) AS opt FROM lineitem GROUP BY 1""",
}

_LINKAGE = "CASE WHEN link = 'weak' THEN 'weak' WHEN link = 'external' THEN 'external' ELSE 'internal' END"
_FINDING = """
    SELECT '{0}' AS kind, count(*) FILTER (NOT {1}) AS n_missing, count(*) AS n_objects,
           min(object) FILTER (NOT {1}) AS sample FROM unit_dumps HAVING count(*) FILTER (NOT {1}) > 0"""

ORACLE: dict[str, str] = {
    "scan_cgraph": """
        SELECT object AS file, local_id, name, linkage_name, 'function' AS kind,
               CAST(analyzed AS BIGINT) AS analyzed, CAST(body_removed AS BIGINT) AS body_removed,
               CASE link WHEN 'external' THEN 'externally_visible public' WHEN 'weak' THEN 'public weak' ELSE '' END
                 AS visibility,
               CAST(taken AS BIGINT) AS address_taken, clone_of
        FROM cgraph_nodes""",
    "scan_cgraph_calls": """
        SELECT 'obj/u_' || c.unit || '.c.o' AS file, CAST(caller_pk AS VARCHAR) AS caller_id,
               CAST(callee_pk AS VARCHAR) AS callee_id, CAST(inl AS BIGINT) AS inlined
        FROM call_rows c JOIN unit_parts u ON u.unit = c.unit AND u.pk = c.caller_pk""",
    "scan_ci": """
        SELECT object AS file, name, 'src/unit_' || unit || '.c' AS decl_file, pk % 100 + 1 AS decl_line,
               5 AS decl_column, pk AS stack_bytes, 'static' AS stack_kind, 0 AS dynamic_objects,
               0 AS is_external, 0 AS is_indirect
        FROM unit_parts WHERE size > 25""",
    "scan_ci_titles": """
        SELECT object AS file, CASE WHEN unit < 15 THEN '../' || tu ELSE tu END AS title FROM unit_paths""",
    "scan_icf": "SELECT DISTINCT object AS file, winner, loser FROM fold_rows",
    "scan_inline_dump": """
        SELECT 'obj/u_' || c.unit || '.c.o' AS file, CAST(caller_pk AS VARCHAR) AS local_id,
               CAST(callee_pk AS VARCHAR) AS callee_id
        FROM call_rows c JOIN unit_parts u ON u.unit = c.unit AND u.pk = c.caller_pk WHERE inl""",
    "scan_optrecord": """
        SELECT DISTINCT r.object AS file, r.pass, a.name AS caller, CAST(caller_pk AS VARCHAR) AS caller_id,
               b.name AS callee, CAST(callee_pk AS VARCHAR) AS callee_id, CAST(inl AS BIGINT) AS inlined, reason,
               r.file AS site_file, line, col
        FROM record_rows r JOIN part_symbols a ON a.pk = caller_pk JOIN part_symbols b ON b.pk = callee_pk""",
    "scan_nm": """
        SELECT target AS file, name, nm_kind, address, pk % 500 + 1 AS size,
               CASE nm_kind WHEN 'T' THEN 'strong' WHEN 'W' THEN 'weak' WHEN 'C' THEN 'common' ELSE '' END
                 AS linkage_kind,
               CASE nm_kind WHEN 't' THEN 1 ELSE 0 END AS is_local,
               CASE nm_kind WHEN 'C' THEN 0 ELSE 1 END AS is_function FROM listing""",
    "scan_object_defs": "SELECT name, target AS object, nm_kind FROM listing",
    "scan_objdump": """
        SELECT target AS file, caller, lpad(lower(hex(caller_pk * 16 + 4096)), 16, '0') AS caller_address,
               callee || CASE WHEN callee_pk % 3 = 0 THEN '@plt' ELSE '' END AS callee,
               CASE WHEN callee_pk % 3 = 0 THEN '530' ELSE lower(hex(callee_pk * 16 + 4096)) END AS callee_address
        FROM branch_rows""",
    "scan_map": "SELECT target AS file, name, object FROM map_origins",
    "scan_map_pulls": """
        SELECT DISTINCT target AS file, 'lib/libshared.a.p/u_1.c.o' AS object, 'app/app.p/u_9.c.o' AS referrer,
               'hook' AS symbol FROM map_origins""",
    "scan_dwarf": """
        SELECT object AS file, name, '/work/proj/include/h_' || unit || '.h' AS decl_file, pk % 50 + 1 AS decl_line,
               CASE WHEN size > 10 THEN 1 ELSE 0 END AS definition, CASE WHEN size <= 10 THEN 1 ELSE 0 END AS declaration,
               CASE WHEN size BETWEEN 11 AND 25 THEN 1 ELSE 0 END AS abstract_inline FROM unit_parts""",
    "dwarf_signature": "SELECT object AS file, name, signature FROM unit_parts",
    "scan_dwarf_inlined": """
        SELECT a.object AS file, b.name AS callee, a.name AS caller, '' AS parent_callee, 1 AS depth,
               callee_pk % 90 + 1 AS line
        FROM call_rows c JOIN unit_parts a ON a.unit = c.unit AND a.pk = caller_pk
        JOIN unit_parts b ON b.unit = c.unit AND b.pk = callee_pk WHERE inl""",
    "scan_dwarf_types": """
        SELECT DISTINCT object AS file, lower(p_type) AS name, 'typedef' AS kind,
               '/work/proj/include/types.h' AS decl_file, length(p_type) AS decl_line, 'int' AS underlying
        FROM unit_parts JOIN part ON p_partkey = pk WHERE p_type NOT IN ('SMALL', 'ECONOMY')""",
    "scan_dwarf_records": """
        SELECT object AS file, 'brand_' || num AS name, CASE WHEN num % 4 = 0 THEN 'union' ELSE 'struct' END AS kind,
               '/work/proj/include/types.h' AS decl_file, num AS decl_line, count(*) * 4 AS byte_size
        FROM (SELECT object, CAST(regexp_extract(brand, '([0-9]+)$', 1) AS BIGINT) AS num FROM unit_parts) GROUP BY object, num
        UNION ALL
        SELECT DISTINCT object, 'mode_' || (unit % 5), 'enum', '/work/proj/include/types.h', unit % 5 + 1, 4 FROM unit_parts""",
    "scan_dwarf_fields": """
        SELECT object AS file, 'brand_' || regexp_extract(brand, '([0-9]+)$', 1) AS record, 'm_' || pk AS name,
               CASE WHEN pk % 3 = 0 THEN 'int (*)(int)' ELSE 'int' END AS type, pk % 50 * 4 AS byte_offset FROM unit_parts""",
    "scan_dwarf_constants": """
        SELECT object AS file, 'mode_' || (unit % 5) AS enum, 'V_' || pk AS name, pk * 3 - 100 AS value FROM unit_parts""",
    "dwarf_calltarget": """
        SELECT object AS file, name AS caller, pk % 90 + 1 AS line, 1 AS indirect,
               CASE WHEN pk % 5 = 0 THEN '' ELSE 'int (int)' END AS callee_type,
               CASE WHEN pk % 5 = 0 THEN '' ELSE 'hook' END AS field_hint FROM unit_parts""",
    "types_dedup_constants": """
        SELECT t.usr || '@V_' || u.pk AS usr, t.usr AS type_usr, 'V_' || u.pk AS name, u.pk * 3 - 100 AS value
        FROM (SELECT 'c:include/types.h@E@mode_' || (unit % 5) AS usr, min(object) AS object FROM unit_parts GROUP BY ALL) t
        JOIN unit_parts u ON u.object = t.object""",
    "scan_ninja_deps": """
        SELECT DISTINCT file, output, ordinal, input FROM (
          SELECT 'log/' || l_orderkey || '/' || l_partkey || '/' || l_suppkey AS file, 'o' || l_orderkey || '.o' AS output,
                 CASE WHEN l_suppkey % 2 = 0 THEN ['s' || l_suppkey || '.h', 'p' || l_partkey || '.c']
                      ELSE ['p' || l_partkey || '.c'] END AS inputs FROM lineitem),
        LATERAL (SELECT unnest(inputs) AS input, unnest(range(len(inputs))) AS ordinal)""",
    "scan_meson": """
        SELECT t.target, d.path, CASE WHEN d.path LIKE '%.h' THEN 1 ELSE 0 END AS generated
        FROM doc_paths d JOIN target_keys t ON t.nk = d.doc_id % 25 WHERE d.path NOT LIKE '%.txt'""",
    "scan_meson_targets": """
        SELECT DISTINCT t.target AS name, t.kind, 'cc -o ' || t.target AS link_command
        FROM doc_paths d JOIN target_keys t ON t.nk = d.doc_id % 25""",
    "scan_builddir": """
        SELECT substr(stem, length('/work/proj/build/') + 1) || '.o' AS object,
               CASE WHEN size > 10 THEN stem || '.ci' END AS ci,
               CASE WHEN size > 20 THEN stem || '.c.000i.cgraph' END AS cgraph,
               CASE WHEN size > 30 THEN stem || '.c.opt-record.json.gz' END AS opt_record, CAST(NULL AS VARCHAR) AS icf
        FROM (SELECT size, '/work/proj/build/obj/' || brand || '/p_' || pk || '.c' AS stem FROM part_symbols)""",
    "sink_publish": """
        SELECT a.id AS caller_id, b.id AS callee_id, e.source, t.id AS target_id
        FROM call_edges e
        JOIN (SELECT usr, row_number() OVER (ORDER BY usr) AS id FROM symbols) a ON a.usr = e.caller_usr
        JOIN (SELECT usr, row_number() OVER (ORDER BY usr) AS id FROM symbols) b ON b.usr = e.callee_usr
        LEFT JOIN (SELECT name, row_number() OVER (ORDER BY name) AS id FROM targets) t ON t.name = e.target""",
    "object_to_source": "SELECT object, tu AS source FROM unit_paths WHERE unit < 15",
    "symbol_observe": f"""
        SELECT object, local_id, usr, name, 'function' AS kind, {_LINKAGE} AS linkage,
               CAST(taken AS BIGINT) AS address_taken, linkage_name, CAST(has_body AS BIGINT) AS has_body,
               def_file AS file, def_line AS line, CAST(link = 'weak' AS BIGINT) AS is_weak FROM observed""",
    "clone_attribution": """
        SELECT object, local_id, usr, name, linkage_name, CAST(taken AS BIGINT) AS address_taken FROM clones""",
    "symbol_merge": """
        SELECT usr, name, 'function' AS kind, linkage, CAST(taken AS BIGINT) AS address_taken,
               CAST(has_def AS BIGINT) AS has_def FROM merged""",
    "symbol_merge_names": """
        SELECT usr, name AS linkage_name FROM observed UNION SELECT usr, name FROM clones""",
    "symbol_merge_definitions": """
        SELECT usr, file, line, '' AS decl_file, 0 AS decl_line, CAST(is_weak AS BIGINT) AS is_weak, linkage_name
        FROM merged_defs""",
    "edges_cgraph": """
        SELECT DISTINCT caller_usr, callee_usr, 'compiler_cgraph' AS source, CAST(NULL AS VARCHAR) AS target
        FROM resolved_calls""",
    "inline_decisions": """
        SELECT caller_usr, callee_usr, CAST(bool_or(inl) AS BIGINT) AS inlined FROM resolved_calls GROUP BY ALL""",
    "inline_records": """
        SELECT caller_usr, callee_usr, pass, CAST(inl AS BIGINT) AS inlined, reason, file, line, col, object
        FROM resolved_records""",
    "icf_groups": "SELECT * FROM resolved_folds",
    "referenced_usrs": """
        SELECT caller_usr AS usr FROM resolved_calls UNION SELECT callee_usr FROM resolved_calls
        UNION SELECT caller_usr FROM resolved_records UNION SELECT callee_usr FROM resolved_records
        UNION SELECT winner_usr FROM resolved_folds UNION SELECT loser_usr FROM resolved_folds""",
    "prune_unreferenced": """
        SELECT usr, name, 'function' AS kind, linkage, CAST(taken AS BIGINT) AS address_taken,
               CAST(has_def AS BIGINT) AS has_def FROM merged
        WHERE has_def OR taken OR linkage <> 'internal' OR usr IN (
          SELECT caller_usr FROM resolved_calls UNION SELECT callee_usr FROM resolved_calls
          UNION SELECT caller_usr FROM resolved_records UNION SELECT callee_usr FROM resolved_records
          UNION SELECT winner_usr FROM resolved_folds UNION SELECT loser_usr FROM resolved_folds)""",
    "assign_ids": "SELECT row_number() OVER (ORDER BY usr) AS id, usr FROM symbols",
    "target_ids": "SELECT row_number() OVER (ORDER BY name) AS id, name FROM targets",
    "resolve_path": """
        SELECT 'sub/./../../' || path AS path, path AS rel, 1 AS in_project FROM sources
        UNION ALL SELECT abs_path || '/../x.h', '/usr/include/x.h', 0 FROM external_sources""",
    "name_lookup": "SELECT * FROM looked_up",
    "resolve_nm_symbol": "SELECT target, name, nm_kind, address, map_object, usr FROM nm_resolved",
    "addr_index": "SELECT * FROM addresses",
    "link_resolutions": """
        SELECT *, CASE WHEN winning_object LIKE '%.a.p/%' THEN split_part(winning_object, '.a.p/', 1) || '.a'
                       ELSE '' END AS archive FROM resolved_links""",
    "link_losers_view": """
        SELECT l.target, l.usr, count(*) AS n_losing
        FROM resolved_links l JOIN (SELECT DISTINCT name, object FROM object_defs) d ON d.name = l.name
        WHERE d.object <> l.winning_object GROUP BY ALL""",
    "edges_objdump": """
        SELECT DISTINCT caller_usr, callee_usr, 'objdump' AS source, target FROM (
          SELECT b.target, coalesce(x.usr, n.usr) AS caller_usr, coalesce(y.usr, m.usr) AS callee_usr
          FROM branch_rows b
          LEFT JOIN addresses x ON x.target = b.target AND x.address = lower(hex(b.caller_pk * 16 + 4096))
          LEFT JOIN looked_up n ON n.name = b.caller
          LEFT JOIN addresses y ON y.target = b.target AND y.address = lower(hex(b.callee_pk * 16 + 4096))
            AND b.callee_pk % 3 <> 0
          LEFT JOIN looked_up m ON m.name = b.callee)
        WHERE caller_usr IS NOT NULL AND callee_usr IS NOT NULL""",
    "dwarf_symbol_lookup": "SELECT object, name, usr FROM debug_lookup",
    "dwarf_enrich": """
        SELECT d.usr, CASE WHEN d.line = 0 AND wf IS NOT NULL THEN wf ELSE d.file END AS file,
               CASE WHEN d.line = 0 AND wf IS NOT NULL THEN wl ELSE d.line END AS line,
               coalesce(df, '') AS decl_file, coalesce(dl, 0) AS decl_line,
               CAST(is_weak AS BIGINT) AS is_weak, linkage_name
        FROM merged_defs d LEFT JOIN bodies_written w ON w.usr = d.usr
        LEFT JOIN bodies_declared c ON c.usr = d.usr""",
    "dwarf_enrich_signatures": """
        SELECT m.usr, coalesce(s.sig, '') AS signature FROM merged m LEFT JOIN (
          SELECT usr, last(sig ORDER BY object, ordinal) AS sig FROM subprograms WHERE size > 10 GROUP BY usr) s
        ON s.usr = m.usr""",
    "inline_instances": """
        SELECT b.usr AS callee_usr, a.usr AS caller_usr, CASE WHEN r.line > 25 THEN a.usr END AS parent_callee_usr,
               CASE WHEN r.line > 25 THEN 2 ELSE 1 END AS depth, r.file, r.line, r.col, r.object
        FROM record_rows r JOIN part_symbols p ON p.pk = r.caller_pk JOIN part_symbols q ON q.pk = r.callee_pk
        JOIN LATERAL (SELECT min(usr) AS o FROM merged WHERE usr = 'c:@F@' || p.name) ao ON true
        JOIN LATERAL (SELECT min(usr) AS i FROM merged WHERE r.unit < 15
                      AND usr = 'c:src/unit_' || r.unit || '.c@F@' || p.name) ai ON true
        JOIN LATERAL (SELECT coalesce(ao.o, ai.i) AS usr) a ON true
        JOIN LATERAL (SELECT min(usr) AS o FROM merged WHERE usr = 'c:@F@' || q.name) bo ON true
        JOIN LATERAL (SELECT min(usr) AS i FROM merged WHERE r.unit < 15
                      AND usr = 'c:src/unit_' || r.unit || '.c@F@' || q.name) bi ON true
        JOIN LATERAL (SELECT coalesce(bo.o, bi.i) AS usr) b ON true
        WHERE r.inl AND a.usr IS NOT NULL AND b.usr IS NOT NULL""",
    "indirect_sites": """
        SELECT coalesce(o.usr, i.usr) AS caller_usr, 'src/site.c' AS file, CAST(floor(value) AS BIGINT) AS line,
               1 AS col, 'int (int, int)' AS callee_type, event_type AS field_hint,
               'obj/u_' || (event_id % 17) || '.c.o' AS object, event_id AS ordinal
        FROM events JOIN part_symbols p ON p.pk = user_id % (SELECT n FROM np)
        LEFT JOIN merged o ON o.usr = 'c:@F@' || p.name
        LEFT JOIN merged i ON event_id % 17 < 15 AND i.usr = 'c:src/unit_' || (event_id % 17) || '.c@F@' || p.name
        WHERE event_type <> 'view' AND coalesce(o.usr, i.usr) IS NOT NULL""",
    "types_dedup": """
        SELECT usr, first(tname ORDER BY object) AS name, first(kind ORDER BY object) AS kind,
               'include/types.h' AS decl_file, min(num) AS decl_line,
               CASE WHEN first(unit ORDER BY object) > 0 THEN first(unit ORDER BY object) * 8 END AS byte_size,
               'unit ' || first(unit ORDER BY object) AS underlying
        FROM type_records GROUP BY usr""",
    "types_dedup_fields": """
        SELECT DISTINCT replace(u.body, ' ', '_') AS name, t.usr AS type_usr
        FROM (SELECT usr, min(object) AS object, min(num) AS num FROM type_records GROUP BY usr) t
        JOIN unit_parts u ON u.object = t.object AND u.brand = 'Brand#' || t.num""",
    "source_packing": """
        SELECT bucket, key, CAST(bool_or(coalesce(s.is_generated AND s.path LIKE '%.c', false)) AS BIGINT)
                 AS is_generated,
               CAST(bool_or(coalesce(s.path LIKE '%.c', false)) AS BIGINT) AS required
        FROM touched t LEFT JOIN sources s ON t.bucket = 'project' AND s.path = t.key GROUP BY ALL""",
    "external_glob": """
        SELECT abs_path, 1 AS p0, CASE WHEN length(abs_path) = length('/usr/include/bench_0.h') THEN 1 ELSE 0 END
                 AS p1, 1 AS p2, 0 AS p3 FROM external_sources""",
    "strict_mtime": """
        WITH built AS (SELECT l_orderkey, l_orderkey || '/' || l_partkey AS object, max(l_shipdate) AS mtime
                       FROM lineitem GROUP BY ALL),
        oldest AS (SELECT l_orderkey, first(object ORDER BY mtime, object) AS object, min(mtime) AS mtime
                   FROM built GROUP BY 1)
        SELECT CAST(o_orderkey AS VARCHAR) AS path, object FROM orders
        JOIN oldest ON l_orderkey = o_orderkey WHERE o_orderdate > mtime""",
    "preflight": f"""
        SELECT 'gcc_too_old' AS kind, 0 AS n_missing, count(*) AS n_objects, '9.4.0' AS sample FROM unit_dumps
        UNION ALL {_FINDING.format('missing_ci', 'ci')}
        UNION ALL {_FINDING.format('missing_cgraph', 'cgraph')}
        UNION ALL {_FINDING.format('missing_opt_record', 'opt')}
        UNION ALL SELECT 'no_debug_info', 1, count(*), min(object) FROM unit_dumps""",
    "target_filter": """
        SELECT * FROM targets WHERE name IN ('NATION_1', 'NATION_2', 'NATION_7')""",
}
