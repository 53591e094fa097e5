"""Operators on a small hand-made index, and against brute force."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.operators import (
    build_ingest,
    call_paths,
    callgraph,
    ids,
    indirect,
    inlining,
    link_ingest,
    linkage,
    source_ingest,
    source_text,
    symbol_ingest,
    symbols,
    targets,
    types,
)

NODE = (
    "object string, local_id string, name string, linkage_name string, kind string, analyzed boolean, "
    "body_removed boolean, visibility array<string>, address_taken boolean, clone_of string"
)


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# -- symbol resolution ------------------------------------------------------------


@pytest.fixture(scope="module")
def observed(spark):
    public, weak = ["externally_visible", "public"], ["public", "weak"]
    nodes = frame(
        spark, NODE,
        ("a.o", "1", "main", "main", "function", True, False, public, False, ""),
        ("a.o", "2", "hook", "hook", "function", True, False, weak, False, ""),
        ("a.o", "3", "helper", "helper", "function", True, False, [], False, ""),
        ("a.o", "4", "helper.constprop.0", "helper.constprop.0", "function", True, False, [], True, "3"),
        ("a.o", "10", "helper.constprop.0.isra.0", "helper.constprop.0.isra.0", "function", True, False, [], False, "4"),
        ("a.o", "5", "puts", "puts", "function", False, False, ["public"], False, ""),
        ("a.o", "6", "unused", "unused", "function", True, True, [], False, ""),
        ("a.o", "7", "table", "table", "variable", True, False, public, False, ""),
        ("a.o", "8", "orphan.part.0", "orphan.part.0", "function", True, False, [], False, "99"),
        ("a.o", "9", "", "", "function", True, False, [], False, ""),
        ("b.o", "1", "main", "main", "function", True, False, public, False, ""),
        ("b.o", "2", "hook", "hook", "function", True, False, public, False, ""),
        ("b.o", "3", "helper", "helper", "", True, False, [], False, ""),
    )
    sites = frame(
        spark, "object string, name string, decl_file string, decl_line int",
        ("a.o", "main", "src/a.c", 10), ("b.o", "main", "src/b.c", 20), ("b.o", "hook", "src/b.c", 5),
    )
    units = frame(spark, "object string, source string", ("a.o", "src/a.c"), ("b.o", "src/b.c"))
    seen = symbol_ingest.observe(nodes, sites, units).cache()
    clones = symbol_ingest.attribute_clones(nodes, seen).cache()
    return nodes, seen, clones


def test_observation_and_merge(observed):
    _, seen, clones = observed
    merged = {r["usr"]: r for r in symbol_ingest.merge_symbols(seen, clones).collect()}
    assert set(merged) == {
        "c:@F@main", "c:@F@hook", "c:src/a.c@F@helper", "c:src/b.c@F@helper", "c:@F@puts", "c:src/a.c@F@unused",
        "c:@V@table",
    }
    assert merged["c:@F@hook"]["linkage"] == "external"  # strong seen beside weak
    assert merged["c:src/a.c@F@helper"]["address_taken"]  # from its clone
    assert not merged["c:@F@puts"]["has_def"] and not merged["c:src/a.c@F@unused"]["has_def"]
    names = rows(symbol_ingest.merge_names(seen, clones).filter("usr = 'c:src/a.c@F@helper'"), "linkage_name")
    assert names == [("helper",), ("helper.constprop.0",), ("helper.constprop.0.isra.0",)]
    definitions = rows(symbol_ingest.merge_definitions(seen).filter("usr in ('c:@F@main', 'c:@F@hook')"), "usr", "file", "line", "is_weak")
    assert definitions == [
        ("c:@F@hook", "src/a.c", 0, True), ("c:@F@hook", "src/b.c", 5, False),
        ("c:@F@main", "src/a.c", 10, False), ("c:@F@main", "src/b.c", 20, False),
    ]


def test_edges_resolve_per_object(spark, observed):
    nodes, seen, clones = observed
    identities = symbol_ingest.local_identities(seen, clones)
    calls = frame(
        spark, "object string, caller_id string, callee_id string, inlined boolean",
        ("a.o", "1", "4", True), ("a.o", "1", "3", False), ("b.o", "1", "3", False), ("b.o", "1", "8", True),
        ("a.o", "1", "8", True), ("b.o", "1", "2", False),
    )
    resolved = symbol_ingest.resolve_ends(calls, identities)
    assert rows(symbol_ingest.edges_cgraph(resolved), "caller_usr", "callee_usr") == [
        ("c:@F@main", "c:@F@hook"), ("c:@F@main", "c:src/a.c@F@helper"), ("c:@F@main", "c:src/b.c@F@helper"),
    ]
    assert ("c:@F@main", "c:src/a.c@F@helper", True) in rows(symbol_ingest.inline_decisions(resolved))


@pytest.mark.parametrize(
    "has_def, taken, linkage, pointed, kept",
    [
        (True, False, "internal", False, True), (False, True, "internal", False, True),
        (False, False, "external", False, True), (False, False, "weak", False, True),
        (False, False, "internal", True, True), (False, False, "internal", False, False),
    ],
)
def test_prune_rule(spark, has_def, taken, linkage, pointed, kept):
    table = frame(
        spark, "usr string, linkage string, address_taken boolean, has_def boolean", ("u", linkage, taken, has_def)
    )
    referenced = frame(spark, "usr string", *([("u",)] if pointed else [("other",)]))
    assert (symbol_ingest.prune_unreferenced(table, referenced).count() == 1) is kept


def test_folds_resolve_by_least_local_id(spark, observed):
    nodes, seen, clones = observed
    identities = symbol_ingest.local_identities(seen, clones)
    folds = frame(
        spark, "object string, winner string, loser string",
        ("a.o", "helper", "hook"), ("a.o", "helper", "helper"), ("a.o", "ghost", "hook"), ("a.o", "hook", "nobody"),
    )
    assert rows(symbol_ingest.icf_members(folds, nodes, identities)) == [
        ("c:src/a.c@F@helper", "a.o", "c:@F@hook")
    ]


def test_assign_ids_is_dense_and_ordered(spark):
    names = [f"n{i:05d}" for i in random.Random(3).sample(range(99999), 2000)]
    df = spark.createDataFrame([(n,) for n in names], "usr string").repartition(7)
    got = ids.assign_ids(df, ["usr"]).collect()
    assert {r["usr"]: r["id"] for r in got} == {n: i + 1 for i, n in enumerate(sorted(names))}


# -- link plane --------------------------------------------------------------------


def test_winner_rank_and_ties(spark):
    cands = frame(
        spark, "name string, object string, nm_kind string",
        ("f", "z.o", "T"), ("f", "a.o", "W"), ("g", "b.o", "W"), ("g", "a.o", "V"), ("h", "a.o", "t"),
        ("h", "b.o", "C"), ("i", "a.o", "U"), ("i", "b.o", "t"),
    )
    assert rows(link_ingest.pick_winners(cands, ["name"]), "name", "object") == [
        ("f", "z.o"), ("g", "a.o"), ("h", "b.o"), ("i", "b.o"),
    ]


def test_name_lookup_prefers_definitions(spark):
    table = frame(spark, "usr string, name string", ("c:a@F@f", "f"), ("c:b@F@f", "f"), ("c:@F@g", "g"))
    extra = frame(spark, "usr string, linkage_name string", ("c:@F@g", "g.part.0"), ("c:@F@g", ""))
    defs = frame(spark, "usr string", ("c:b@F@f",))
    assert rows(link_ingest.name_lookup(table, extra, defs)) == [
        ("f", "c:b@F@f"), ("g", "c:@F@g"), ("g.part.0", "c:@F@g"),
    ]


def test_weak_and_strong_resolve_per_target(spark):
    listing = frame(
        spark, "target string, name string, nm_kind string, address string, pos long",
        ("app1", "hook", "T", "0000000000001200", 1), ("app2", "hook", "W", "0000000000001300", 1),
        ("app1", "s", "t", "1400", 2), ("app1", "s", "t", "1500", 3), ("app1", "nobody", "T", "1", 4),
        ("app1", "data", "d", "2000", 5),
    )
    origins = frame(
        spark, "target string, name string, object string",
        ("app1", "hook", "app/app1.p/strong.c.o"), ("app1", "s", "app/app1.p/one.c.o"),
        ("app1", "data", "app/app1.p/one.c.o"),
    )
    defs = frame(
        spark, "name string, object string, nm_kind string",
        ("hook", "app/app1.p/strong.c.o", "T"), ("hook", "lib/libs.a.p/weak.c.o", "W"),
        ("s", "app/app1.p/one.c.o", "t"), ("s", "app/app1.p/two.c.o", "t"), ("data", "app/app1.p/one.c.o", "d"),
    )
    sources = frame(spark, "object string, source string", ("app/app1.p/one.c.o", "one.c"), ("app/app1.p/two.c.o", "two.c"))
    table = frame(spark, "usr string", ("c:@F@hook",), ("c:one.c@F@s",), ("c:two.c@F@s",), ("c:one.c@V@data",))
    names = frame(spark, "name string, usr string", ("hook", "c:@F@hook"), ("s", "c:two.c@F@s"))
    resolved = link_ingest.resolve_nm_symbols(listing, origins, defs, sources, table, names).cache()
    assert ("app1", "s", "c:one.c@F@s") in rows(resolved, "target", "name", "usr")
    assert ("app1", "data", "c:one.c@V@data") in rows(resolved, "target", "name", "usr")
    links = link_ingest.link_resolutions(resolved, defs)
    assert rows(links, "target", "usr", "winning_object", "linkage_kind", "archive") == [
        ("app1", "c:@F@hook", "app/app1.p/strong.c.o", "strong", ""),
        ("app2", "c:@F@hook", "app/app1.p/strong.c.o", "weak", ""),
    ]
    assert rows(link_ingest.loser_counts(links, defs)) == [("app1", "c:@F@hook", 1), ("app2", "c:@F@hook", 1)]
    assert rows(link_ingest.losers_view(links, defs), "target", "object") == [
        ("app1", "lib/libs.a.p/weak.c.o"), ("app2", "lib/libs.a.p/weak.c.o"),
    ]
    addresses = link_ingest.address_index(resolved)
    assert ("app1", "1200", "c:@F@hook") in rows(addresses, "target", "address", "usr")
    calls = frame(
        spark, "target string, caller string, caller_address string, callee string, callee_address string",
        ("app1", "hook", "0000000000001200", "s", "1500"), ("app1", "hook", "9", "s@plt", "1030"),
        ("app1", "hook", "1200", "unknown@V1", "77"),
    )
    assert rows(link_ingest.edges_objdump(calls, addresses, names), "caller_usr", "callee_usr") == [
        ("c:@F@hook", "c:one.c@F@s"), ("c:@F@hook", "c:two.c@F@s"),
    ]


# -- source plane --------------------------------------------------------------------


def test_packing_buckets(spark):
    declared = frame(
        spark, "path string, generated boolean", ("/p/src/a.c", False), ("/b/gen.c", True), ("/p/made.c", True)
    )
    seen = frame(
        spark, "object string, path string",
        ("a.o", "../p/include/x.h"), ("b.o", "../p/include/x.h"), ("a.o", "/usr/include/stdio.h"), ("a.o", "config.h"),
        ("a.o", "/opt/v.h"),
    )
    packed = source_ingest.pack_sources(declared, seen, "/b", "/p", ("/usr/include/**",))
    assert rows(packed, "bucket", "key", "is_generated", "required") == sorted([
        ("project", "src/a.c", False, True), ("generated", "gen.c", True, True), ("project", "made.c", True, True),
        ("project", "include/x.h", False, False), ("external", "/usr/include/stdio.h", False, False),
        ("generated", "config.h", False, False), ("outside", "/opt/v.h", False, False),
    ], key=str)
    assert source_ingest.misplaced_sources(packed).count() == 0
    assert source_ingest.unmatched_patterns(seen, "/b", ("/usr/include/**", "/none/**")) == ["/none/**"]
    moved = source_ingest.pack_sources(frame(spark, "path string, generated boolean", ("/gone/a.c", False)), seen, "/b", "/p")
    assert rows(source_ingest.misplaced_sources(moved)) == [("/gone/a.c",)]


def test_blob_dedup(spark):
    df = frame(spark, "content binary", (b"a",), (b"a",), (b"\xff\xfe",), ("é".encode(),))
    got = source_ingest.dedup_blobs(df)
    assert rows(got, "size") == [(1,), (2,), (2,)]


@pytest.mark.parametrize(
    "version, kinds",
    [("16.2.1", []), ("9.1", ["gcc_too_old"]), ("", ["gcc_too_old"]), ("clang", ["gcc_too_old"]), ("10.0", [])],
)
def test_preflight_versions(spark, version, kinds):
    good = frame(spark, "object string, ci string, cgraph string, opt_record string", ("a.o", "x", "x", "x"))
    debug = frame(spark, "object string, has_debug boolean", ("a.o", True))
    assert [k for (k,) in rows(build_ingest.preflight(good, version, debug), "kind")] == kinds


def test_preflight_missing_dumps(spark):
    schema = "object string, ci string, cgraph string, opt_record string"
    bad = frame(spark, schema, ("a.o", None, "x", "x"), ("b.o", None, None, "x"))
    debug = frame(spark, "object string, has_debug boolean", ("a.o", False))
    assert rows(build_ingest.preflight(bad, "16", debug), "kind", "n_missing", "sample") == [
        ("missing_cgraph", 1, "b.o"), ("missing_ci", 2, "a.o"), ("no_debug_info", 1, "a.o"),
    ]
    none = frame(spark, schema).filter("false")
    assert rows(build_ingest.preflight(none, "16", debug.filter("false")), "kind") == [("no_targets",)]


def test_target_filter(spark):
    table = frame(spark, "name string, kind string", ("a", "executable"), ("b", "executable"))
    assert rows(build_ingest.filter_targets(table, ["a, b", "a"]), "name") == [("a",), ("b",)]
    assert build_ingest.filter_targets(table, []).count() == 2
    with pytest.raises(ValueError, match="c.*known: a, b"):
        build_ingest.filter_targets(table, ["a,c"])


# -- verdicts -------------------------------------------------------------------------

RECORD = "caller_usr string, callee_usr string, pass string, inlined boolean, reason string, file string, line int, column int, object string"


def _record(pass_, inlined, reason="", obj="a.o", line=1):
    return ("p", "q", pass_, inlined, reason, "f.c", line, 1, obj)


@pytest.mark.parametrize(
    "records, bodies, per_object, overall",
    [
        ([_record("einline", True)], ["a.o"], [("a.o", "inlined_and_present", "", "")], ("inlined_and_present", "")),
        ([_record("inline", True), _record("einline", False, "no")], [], [("a.o", "inlined_then_folded", "", "")], ("inlined_then_folded", "")),
        ([_record("einline", False, "early"), _record("inline", False, "first", line=1), _record("inline", False, "second", line=2)], [],
         [("a.o", "declined", "inline", "first")], ("declined", "first")),
        ([_record("einline", False, "one", line=1), _record("einline", False, "two", line=2)], [],
         [("a.o", "declined", "einline", "two")], ("declined", "two")),
        ([_record("inline", False, "no", "b.o")], ["a.o"],
         [("a.o", "inlined_and_present", "", ""), ("b.o", "declined", "inline", "no")], ("mixed", "")),
        ([_record("inline", False, "x", "a.o"), _record("inline", False, "y", "b.o")], [],
         [("a.o", "declined", "inline", "x"), ("b.o", "declined", "inline", "y")], ("declined", "x")),
    ],
)
def test_verdicts(spark, records, bodies, per_object, overall):
    recs = frame(spark, RECORD, *records)
    inst = spark.createDataFrame(
        [("p", "q", o) for o in bodies], "caller_usr string, callee_usr string, object string"
    )
    got = inlining.per_object_verdicts(recs, inst)
    assert rows(got, "object", "verdict", "pass", "reason") == per_object
    assert rows(inlining.overall_verdicts(got), "verdict", "reason") == [overall]


# -- paths ------------------------------------------------------------------------------


def _graph(spark, edges, names=None):
    nodes = sorted({n for e in edges for n in e})
    table = spark.createDataFrame([(n, (names or {}).get(n, n)) for n in nodes], "usr string, name string")
    calls = spark.createDataFrame(
        [(a, b, "compiler_cgraph", None) for a, b in edges],
        "caller_usr string, callee_usr string, source string, target string",
    )
    return Facts.of(spark, {"symbols": table, "call_edges": calls})


def _brute_paths(edges, start, end, depth):
    out = []

    def walk(path):
        if path[-1] == end:
            out.append(tuple(path))
            return
        if len(path) <= depth:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    walk([*path, b])

    walk([start])
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefg"
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(17)})
    facts = _graph(spark, edges)
    got = sorted(tuple(r["usrs"]) for r in call_paths.list_call_paths(facts, "a", "g", 4).collect()) if any(
        "a" in e for e in edges
    ) else []
    assert got == _brute_paths(edges, "a", "g", 4)


@pytest.mark.parametrize("limit, width, most_edges", [(3, 2, 0), (50, 4, 0), (4, 100, 9), (3, 1, 1000), (50, 1, 1000)])
def test_first_paths_are_exact_at_any_width(spark, limit, width, most_edges):
    rng = random.Random(limit)
    nodes = "abcdefg"
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)} | {("a", "b"), ("f", "g")})
    names = {n: "x" if n in "bd" else n for n in nodes}  # two symbols share a name
    facts = _graph(spark, edges, names)
    found = call_paths.first_call_paths(facts, "a", "g", 5, limit=limit, width=width, most_edges=most_edges)
    want = sorted(([names[u] for u in p], list(p)) for p in _brute_paths(edges, "a", "g", 5))[:limit]
    assert [(list(r["names"]), list(r["usrs"])) for r in call_paths.ordered(found).collect()] == want


@pytest.mark.parametrize("seed", range(8))
def test_paths_read_off_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefghij"
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)})
    names = {n: rng.choice("xyz") if n not in "ag" else n for n in nodes}
    facts = _graph(spark, edges, names)
    for depth, limit in ((1, 5), (4, 3), (6, 1000)):
        found = call_paths.first_call_paths(facts, "a", "g", depth, limit=limit)
        want = sorted(([names[u] for u in p], list(p)) for p in _brute_paths(edges, "a", "g", depth))[:limit]
        assert [(list(r["names"]), list(r["usrs"])) for r in call_paths.ordered(found).collect()] == want


def test_calls_around_an_end_are_collected_only_if_they_are_few(spark, monkeypatch):
    names = {"a": "main", "b": "b", "g": "out", **{f"n{i}": "x" for i in range(8)}}
    edges = [("a", "b"), *(("b", f"n{i}") for i in range(8)), *((f"n{i}", "g") for i in range(8))]
    facts = _graph(spark, edges, names)
    kind = type(facts.call_edges)
    taken, collect = [], kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: taken.append(collect(df)) or taken[-1])
    assert call_paths._neighbourhood(facts, "a", "caller_usr", 2, None, 5) is None
    assert sum(map(len, taken)) <= 5
    assert len(call_paths._neighbourhood(facts, "a", "caller_usr", 2, None, 9)) == 9


def test_calls_are_resolved_once_for_all_hops(spark):
    edges = [(f"s{i}", f"s{i + 1}") for i in range(6)]
    facts = _graph(spark, edges)
    read, calls = spark.sparkContext.accumulator(0), facts.call_edges

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    watched = Facts(spark, {"symbols": lambda: facts.symbols, "call_edges": lambda: calls.mapInArrow(counted, calls.schema)})
    assert call_paths.list_call_paths(watched, "s0", "s6").count() == 1
    assert read.value == len(edges)


def test_paths_order_and_depth(spark):
    facts = _graph(spark, [("s", "m2"), ("s", "m1"), ("m1", "e"), ("m2", "e"), ("e", "s"), ("m1", "m2")], {"m1": "zz", "m2": "aa"})
    found = call_paths.ordered(call_paths.list_call_paths(facts, "s", "e")).collect()
    assert [list(r["names"]) for r in found] == [["s", "aa", "e"], ["s", "zz", "aa", "e"], ["s", "zz", "e"]]
    assert [tuple(r) for r in call_paths.list_call_paths(facts, "s", "s").collect()] == [(["s"], ["s"], 0)]
    assert call_paths.depth_bound(None) == 6 and call_paths.depth_bound(16) == 16
    for depth in (0, 17):
        with pytest.raises(ValueError, match="between 1 and 16"):
            call_paths.depth_bound(depth)
    assert call_paths.list_call_paths(facts, "s", "e", 1).count() == 0


# -- queries on the mini index -------------------------------------------------------------


@pytest.fixture(scope="module")
def mini(spark):
    return mini_facts(spark)


def mini_facts(spark):
    """Two programs and a static library; see each test for what a row is for."""
    sym = "usr string, name string, kind string, linkage string, signature string, address_taken boolean"
    table = frame(
        spark, sym,
        ("c:@F@main", "main", "function", "external", "int (void)", False),
        ("c:@F@hook", "hook", "function", "external", "void (void)", False),
        ("c:src/a.c@F@add_ints", "add_ints", "function", "internal", "int (int, int)", True),
        ("c:src/a.c@F@sub_ints", "sub_ints", "function", "internal", "int (int, int)", True),
        ("c:@F@printf", "printf", "function", "external", "", False),
        ("c:@F@dead", "dead", "function", "external", "char (char)", True),
        ("c:@F@frail", "frail", "function", "weak", "", False),
    )
    text_a = "int main(void)\n{\n  return add_ints(1, 2) + add_ints(3, 4);\n}\n"
    blobs = frame(spark, "content binary", (text_a.encode(),), (b"#define ADD add_ints\n",), (b"gen add_ints",))
    blobs = source_ingest.dedup_blobs(blobs).cache()
    digest = {bytes(r["content"]): r["hash"] for r in blobs.collect()}
    data = {
        "targets": frame(
            spark, "name string, kind string, link_command string",
            ("app1", "executable", "cc"), ("app2", "executable", "cc"), ("libs", "static_library", ""),
        ),
        "target_sources": frame(spark, "target string, file string", ("app1", "src/a.c"), ("app2", "src/b.c")),
        "symbols": table,
        "symbol_names": frame(
            spark, "usr string, linkage_name string", ("c:@F@main", "main"), ("c:src/a.c@F@add_ints", "add_ints.constprop.0")
        ),
        "symbol_definitions": frame(
            spark,
            "usr string, file string, line int, decl_file string, decl_line int, is_weak boolean, linkage_name string",
            ("c:@F@main", "src/a.c", 1, "", 0, False, "main"), ("c:@F@main", "src/b.c", 7, "", 0, False, "main"),
            ("c:@F@hook", "src/weak.c", 3, "", 0, True, "hook"), ("c:@F@hook", "src/strong.c", 4, "", 0, False, "hook"),
            ("c:@F@dead", "src/a.c", 4, "/usr/include/dead.h", 9, False, "dead"),
            ("c:src/a.c@F@add_ints", "src/a.c", 2, "", 0, False, "add_ints"),
        ),
        "call_edges": frame(
            spark, "caller_usr string, callee_usr string, source string, target string",
            ("c:@F@main", "c:src/a.c@F@add_ints", "compiler_cgraph", None),
            ("c:@F@main", "c:@F@hook", "compiler_cgraph", None), ("c:@F@main", "c:@F@hook", "objdump", "app1"),
            ("c:@F@main", "c:@F@printf", "objdump", "app1"), ("c:@F@hook", "c:@F@printf", "objdump", "app1"),
        ),
        "link_resolutions": frame(
            spark, "target string, usr string, winning_object string, linkage_kind string, archive string",
            ("app1", "c:@F@main", "app1/main.o", "strong", ""), ("app2", "c:@F@main", "app2/main.o", "strong", ""),
            ("app1", "c:@F@hook", "app1/strong.o", "strong", ""),
            ("app2", "c:@F@hook", "lib/libs.a.p/weak.o", "weak", "lib/libs.a"),
        ),
        "link_losers": frame(
            spark, "target string, usr string, object string",
            ("app1", "c:@F@hook", "lib/libs.a.p/weak.o"), ("app2", "c:@F@hook", "app1/strong.o"),
        ),
        "inline_records": frame(
            spark, RECORD,
            ("c:@F@main", "c:src/a.c@F@add_ints", "einline", False, "cold", "src/a.c", 3, 10, "a.o"),
            ("c:@F@main", "c:src/a.c@F@add_ints", "inline", True, "", "src/a.c", 3, 10, "a.o"),
        ),
        "inline_decisions": frame(
            spark, "caller_usr string, callee_usr string, inlined boolean", ("c:@F@main", "c:src/a.c@F@add_ints", True)
        ),
        "inline_instances": frame(
            spark,
            "callee_usr string, caller_usr string, parent_callee_usr string, depth int, file string, line int, column int, object string",
            ("c:src/a.c@F@add_ints", "c:@F@main", None, 1, "src/a.c", 3, 10, "a.o"),
        ),
        "indirect_call_sites": frame(
            spark,
            "site_id long, caller_usr string, file string, line int, column int, callee_type string, field_hint string",
            (1, "c:@F@main", "src/a.c", 3, 1, "int (int, int)", "ops.add"), (2, "c:@F@hook", "src/a.c", 4, 1, "", ""),
        ),
        "icf_groups": frame(spark, "winner_usr string, object_file string", ("c:@F@hook", "a.o")),
        "icf_group_members": frame(
            spark, "winner_usr string, object_file string, loser_usr string", ("c:@F@hook", "a.o", "c:@F@dead")
        ),
        "types": frame(
            spark,
            "usr string, name string, kind string, decl_file string, decl_line int, byte_size int, underlying string",
            ("c:h.h@E@flow", "flow", "enum", "h.h", 1, 4, ""), ("c:h.h@T@flow_t", "flow_t", "typedef", "h.h", 2, None, "enum flow"),
            ("c:h.h@S@ops", "ops", "struct", "h.h", 5, 32, ""),
        ),
        "type_fields": frame(
            spark, "type_usr string, name string, type string, ordinal int, byte_offset int",
            *[("c:h.h@S@ops", n, "int (*)(int, int)", i, 8 * i) for i, n in enumerate(["add", "sub", "mul", "div"])],
        ),
        "enum_constants": frame(
            spark, "usr string, type_usr string, name string, value long",
            *[(f"c:h.h@E@flow@{n}", "c:h.h@E@flow", n, v) for n, v in (("FLW_A", 0), ("FLW_B", 7), ("FLWxC", 9))],
        ),
        "sources": frame(
            spark, "path string, blob_hash string, is_generated boolean",
            ("src/a.c", digest[text_a.encode()], False), ("src/copy.c", digest[text_a.encode()], False),
        ),
        "external_sources": frame(
            spark, "abs_path string, blob_hash string", ("/usr/include/dead.h", digest[b"#define ADD add_ints\n"])
        ),
        "generated_sources": frame(
            spark, "builddir_rel string, blob_hash string", ("gen.H", digest[b"gen add_ints"]), ("src/a.c", digest[b"gen add_ints"])
        ),
        "blobs": blobs,
    }
    from codefacts.plans.snapshot import token_tables

    data["symbol_tokens"], data["type_tokens"] = token_tables(data["symbols"], data["types"])
    return Facts.of(spark, data)


def test_find_symbol(mini):
    assert rows(symbols.find_symbol(mini, "ADD in"), "name") == [("add_ints",)]
    assert rows(symbols.find_symbol(mini, "int"), "name") == [("add_ints",), ("main",), ("sub_ints",)]
    assert symbols.find_symbol(mini, "__").count() == 0
    assert rows(symbols.find_symbol(mini, "add_ints.constprop.0", exact=True), "name") == [("add_ints",)]
    assert symbols.find_symbol(mini, "Main", exact=True).count() == 0
    assert symbols.find_symbol(mini, "add", target="app1").count() == 0  # file-local: no link row


def test_weak_symbols_and_target_precedence(mini):
    assert rows(linkage.list_weak_symbols(mini), "name") == [("frail",), ("hook",)]
    # The target only filters the linkage arm; hook has a weak definition.
    assert rows(linkage.list_weak_symbols(mini, "app1"), "name") == [("hook",)]
    assert rows(linkage.list_weak_symbols(mini, "none"), "name") == [("hook",)]
    assert linkage.list_weak_symbols(mini, "none", strict=True).count() == 0


def test_undefined_unreachable_entry_points(mini):
    assert rows(linkage.list_undefined_symbols(mini, "app1"), "name", "called_count") == [("printf", 2)]
    unreachable = [n for (n,) in rows(linkage.list_unreachable_symbols(mini, "app1"), "name")]
    assert unreachable == ["add_ints", "dead", "frail", "printf", "sub_ints"]
    assert linkage.list_unreachable_symbols(mini, "libs").count() == 0
    points = linkage.list_entry_points(mini, "app1").orderBy(F.desc("is_main"), "name").collect()
    assert [(r["name"], r["reason"], r["file"], r["line"]) for r in points] == [
        ("main", "main", "src/a.c", 1), ("hook", "exported", "src/strong.c", 4),
    ]


def test_target_entry_points_prefer_own_files(mini):
    found = targets.target_entry_points(mini, "app2").orderBy(F.desc("own"), "file").collect()
    assert [(r["file"], r["own"]) for r in found] == [("src/b.c", 1), ("src/a.c", 0)]


def test_plane_diff(mini):
    assert rows(callgraph.plane_diff(mini)) == [("c:@F@main", "c:src/a.c@F@add_ints")]


def test_indirect(mini):
    assert rows(indirect.resolve_indirect_call(mini, 1), "name", "evidence") == [
        ("add_ints", "type_match"), ("sub_ints", "type_match"),
    ]
    assert rows(indirect.resolve_indirect_call(mini, 2), "name", "evidence") == [
        ("add_ints", "address_taken"), ("dead", "address_taken"), ("sub_ints", "address_taken"),
    ]
    assert rows(indirect.candidate_counts(mini), "site_id", "n_candidates") == [(1, 2), (2, 3)]


def test_find_type(mini):
    found = types.find_type(mini, "flow").orderBy("ord", "name", "usr").collect()
    assert [(r["ord"], r["name"]) for r in found] == [(0, "flow"), (0, "flow_t")]
    # An underscore is no wildcard, and case does not matter for ASCII.
    assert rows(types.find_type(mini, "flw_", kind="enum_constant"), "name", "value") == [("FLW_A", 0), ("FLW_B", 7)]
    assert types.find_type(mini, "flow", kind="struct").count() == 0
    assert rows(types.find_type(mini, "FLW_B", exact=True), "name", "enum_name") == [("FLW_B", "flow")]


def test_search_and_read(mini):
    matches = source_text.search_matches(mini, "add_ints", include_external=True)
    got = matches.orderBy("table_ord", "path", "line", "column").collect()
    assert [(r["table_ord"], r["path"], r["line"], r["column"]) for r in got] == [
        (0, "src/a.c", 3, 10), (0, "src/a.c", 3, 27), (0, "src/copy.c", 3, 10), (0, "src/copy.c", 3, 27),
        (1, "gen.H", 1, 5), (1, "src/a.c", 1, 5), (2, "/usr/include/dead.h", 1, 13),
    ]
    # One path in two tables shares a counter.
    assert dict(rows(source_text.search_by_file(mini, "add_ints"))) == {"src/a.c": 3, "src/copy.c": 2, "gen.H": 1}
    assert rows(source_text.search_matches(mini, "add_ints", target="app1"), "path", "line") == [("src/a.c", 3)] * 2
    assert rows(source_text.search_matches(mini, "add_ints", kind="header"), "path") == [("gen.H",)]
    assert source_text.read_source(mini, "src/a.c", 2, 2).first()["content"] == "{"
    assert source_text.read_source(mini, "gen.H").first()["content"] == "gen add_ints"
    assert source_text.read_source(mini, "/usr/include/dead.h").first()["line_count"] == 1
    assert source_text.read_source(mini, "none").count() == 0
    with pytest.raises(ValueError):
        source_text.search_matches(mini, "")


def test_drift(spark, mini):
    live = frame(spark, "path string, content binary", ("src/a.c", b"changed"))
    assert rows(source_text.list_source_drift(mini, live), "path", "live_missing") == [
        ("src/a.c", False), ("src/copy.c", True),
    ]
    assert source_text.verify_live(mini, "src/copy.c", live).first()["live_missing"]
    digest = mini.sources.filter("path = 'src/a.c'").first()["blob_hash"]
    assert source_text.verify_source(mini, "src/a.c", digest.upper()).first()["matches"]
