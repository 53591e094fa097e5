"""Collection of a small build tree, with the inspection tools' output given."""

import gzip
import json

import pytest
from conftest import rows
from test_debug_info import DUMP
from test_sources import _document, _log, _node

from codefacts.plans import collect
from codefacts.plans.collect import Build, PreflightError, SourceError
from codefacts.plans.index import Index

CI = """graph: {{ title: "../src/{0}.c"
node: {{ title: "main" label: "main\\nsrc/../../src/{0}.c:20:5\\n8 bytes (static)\\n0 dynamic objects" }}
}}
"""
CGRAPH = """Initial Symbol table:

main/1 (main)
  Type: function definition analyzed
  Visibility: externally_visible public
  Calls: inner/2 (inlined) (1.00 per call) hook/3 (1.00 per call)

inner/2 (inner)
  Type: function definition analyzed
  Visibility:

hook/3 (hook)
  Type: function{hook}
  Visibility: {visibility}

stray/4 (stray)
  Type: function
  Body removed by symtab_remove_unreachable_nodes

adder/5 (adder)
  Type: function definition analyzed
  Referring: g_ops/9 (addr)
"""
MAP = """Archive member included to satisfy reference by file (symbol)
Discarded input sections
 .text          0x0000000000001040       0x42 a.p/a.c.o
                0x0000000000001040                main
 .text          0x0000000000001200        0x6 lib/libs.a.p/b.c.o
                0x0000000000001200                hook
"""
NM = "main T 0000000000001040 42\nhook W 0000000000001200 6\nadder t 0000000000001300 4\n_start T 0000000000001000 1"
OBJDUMP = """0000000000001040 <main>:
    104b:\tcall   1200 <hook>
    1050:\tcall   1030 <puts@plt>

0000000000001300 <adder>:
    1301:\tcall   1040 <main>
"""


@pytest.fixture
def tree(tmp_path):
    root, build = tmp_path / "p", tmp_path / "p" / "build"
    files = {
        "src/a.c": "int main(void)\n{\n  return 0;\n}\n", "src/b.c": "void hook(void) {}\n", "include/ops.h": "#define X 1\n",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    for folder, unit, hook, visibility in (("a.p", "a", "", "public"), ("lib/libs.a.p", "b", " definition analyzed", "public weak")):
        d = build / folder
        d.mkdir(parents=True)
        (d / f"{unit}.c.o").write_bytes(b"\x7fELF")
        (d / f"{unit}.c.ci").write_text(CI.format(unit))
        (d / f"{unit}.c.c.000i.cgraph").write_text(CGRAPH.format(hook=hook, visibility=visibility))
        (d / f"{unit}.c.c.091i.icf").write_text("Introduced new external node (main.localalias/9).\nAnalyzing function: inner/2\n  x = main.localalias (1);\n")
        record = {"kind": "success", "pass": "0x2", "message": ["Inlined ", _node("inner/2"), " into ", _node("main/1"), "."], "location": {"file": f"../src/{unit}.c", "line": 3, "column": 2}}
        (d / f"{unit}.c.c.opt-record.json.gz").write_bytes(gzip.compress(_document([record]).encode()))
    (build / "app.map").write_text(MAP)
    (build / "config.h").write_text("#define C 1\n")
    (build / ".ninja_deps").write_bytes(_log(("a.p/a.c.o", 0), ("../src/a.c", 1), ("../include/ops.h", 2), (str(tmp_path / "sys" / "s.h"), 3), ("config.h", 4), (0, [1, 2, 3, 4])))
    (tmp_path / "sys").mkdir()
    (tmp_path / "sys" / "s.h").write_text("extern\n")
    info = build / "meson-info"
    info.mkdir()
    group = lambda unit: {"language": "c", "compiler": ["cc"], "parameters": [], "sources": [f"{root}/src/{unit}.c"], "generated_sources": []}
    (info / "intro-targets.json").write_text(json.dumps([
        {"name": "app", "type": "executable", "filename": [f"{build}/app"], "target_sources": [group("a"), {"linker": ["cc"], "parameters": ["-o", "app"]}]},
        {"name": "s", "type": "static library", "filename": [f"{build}/lib/libs.a"], "target_sources": [group("b")]},
    ]))
    (info / "intro-compilers.json").write_text(json.dumps({"host": {"c": {"version": "16.2.1"}}}))
    (info / "meson-info.json").write_text(json.dumps({"meson_version": {"full": "1.12.0"}}))
    return tmp_path


def make_build(spark, text_lines, tree):
    root = f"{tree}/p"
    dump = DUMP.replace('"/p/', f'"{root}/').replace('"/p/build"', f'"{root}/build"')
    first = text_lines(dump, "a.p/a.c.o")
    second = text_lines(dump.replace("../src/a.c", "../src/b.c").replace("(12)", "(13)"), "lib/libs.a.p/b.c.o")
    empty = first.limit(0)
    objects = text_lines("main T 0 1\nadder t 0 1", "a.p/a.c.o").unionByName(text_lines("hook W 0 6\nmain T 0 1", "lib/libs.a.p/b.c.o"))
    lines = text_lines(f"""include_directories[  0] = "{root}/src"
file_names[  1]:
           name: "a.c"
      dir_index: 0
0x0000000000000000     31      7      1   0             0       0  is_stmt""", "a.p/a.c.o")
    return Build(spark, f"{root}/build", root, {
        "debug": first.unionByName(second), "lines": lines, "nm": text_lines(NM, "app"), "objects_nm": objects,
        "disassembly": text_lines(OBJDUMP, "app"), "relocations": empty, "symbol_table": empty,
    })


def test_collect_end_to_end(spark, text_lines, tree):
    out = str(tree / "index")
    build = make_build(spark, text_lines, tree)
    collect.build_snapshot(build, out, include_external=(f"{tree}/sys/**",))
    index = Index(spark, out, f"{tree}/p")
    facts = index._facts

    usrs = {r["usr"] for r in facts.symbols.collect()}
    # stray is internal, undefined and unreferenced in both units.
    assert usrs == {
        "c:@F@main", "c:@F@hook", "c:src/a.c@F@inner", "c:src/b.c@F@inner", "c:src/a.c@F@adder", "c:src/b.c@F@adder",
    }
    main = index.describe_symbol("c:@F@main")
    assert main.rows.first()["signature"] == "int (op_fn, double, int (*)(int, int), ...)"
    assert rows(main.parts["definitions"], "file", "line") == [("src/a.c", 20), ("src/b.c", 20)]
    # inner has no call-graph node: its site comes from the abstract instance.
    inner = index.describe_symbol("c:src/a.c@F@inner").parts["definitions"].first()
    assert (inner["file"], inner["line"]) == ("include/i.h", 12)
    assert rows(index.list_callees("c:@F@main").rows, "name") == [("hook",), ("inner",), ("inner",)]
    assert rows(index.list_linked_callees("c:@F@main", "app").rows, "name") == [("hook",)]
    assert rows(index.list_linked_callers("c:@F@main", "app").rows, "usr") == [("c:src/a.c@F@adder",)]
    link = index.describe_link_resolution("c:@F@hook", "app").rows.first()
    assert (link["winning_object"], link["linkage_kind"], link["archive"]) == ("lib/libs.a.p/b.c.o", "weak", "lib/libs.a")
    assert rows(facts.link_losers, "usr", "object") == [("c:@F@main", "lib/libs.a.p/b.c.o")]
    verdict = index.explain_call("c:@F@main", "c:src/a.c@F@inner").rows.first()
    assert (verdict["verdict"], verdict["cgraph_inlined"], verdict["linked_edge"]) == ("inlined_and_present", True, False)
    assert rows(facts.icf_group_members, "winner_usr", "loser_usr") == [
        ("c:@F@main", "c:src/a.c@F@inner"), ("c:@F@main", "c:src/b.c@F@inner"),
    ]
    assert rows(facts.types, "usr") == [
        ("c:include/ops.h@E@__anon_9_1",), ("c:include/ops.h@S@ops",), ("c:include/ops.h@T@op_fn",),
    ]
    assert rows(index.describe_type("c:include/ops.h@S@ops").parts["fields"], "name", "ordinal") == [("add", 0), ("sub", 1)]
    assert facts.enum_constants.count() == 2
    sites = index.list_indirect_call_sites(caller_usr="c:@F@main").rows.collect()
    assert [r["callee_type"] for r in sites] == ["int (int, int)", ""] and sites[0]["file"] == "src/a.c"
    assert rows(facts.sources, "path") == [("build/config.h",), ("include/ops.h",), ("src/a.c",), ("src/b.c",)]
    assert facts.sources.filter("is_generated").first()["path"] == "build/config.h"
    assert rows(facts.external_sources, "abs_path") == [(f"{tree}/sys/s.h",)]
    assert facts.blobs.count() == 5
    assert rows(index.list_targets().rows) == [("app", "executable", 1, 2), ("s", "static_library", 1, 0)]
    assert index.list_source_drift().rows.isEmpty()


def test_preflight_and_source_errors(spark, text_lines, tree):
    build = make_build(spark, text_lines, tree)
    with pytest.raises(SourceError, match="match no header"):
        collect.source_plane(build, collect.build_plane(build, [])["declared"], False, ("/none/**",))
    with pytest.raises(ValueError, match="unknown target"):
        collect.build_plane(build, ["nope"])
    (tree / "p" / "src" / "b.c").unlink()
    with pytest.raises(SourceError, match="src/b.c"):
        collect.source_plane(build, collect.build_plane(build, [])["declared"], False, ())
    (tree / "p" / "build" / "a.p" / "a.c.ci").unlink()
    with pytest.raises(PreflightError, match="missing_ci.*1 of 2"):
        collect.build_snapshot(make_build(spark, text_lines, tree), str(tree / "out"))
    assert not (tree / "out").exists()


def test_strict_refuses_newer_sources(spark, text_lines, tree):
    import os
    import time

    later = time.time() + 500
    os.utime(tree / "p" / "build" / "a.p" / "a.c.o", (later - 100, later - 100))
    os.utime(tree / "p" / "include" / "ops.h", (later, later))
    build = make_build(spark, text_lines, tree)
    declared = collect.build_plane(build, [])["declared"]
    with pytest.raises(SourceError, match="ops.h is newer"):
        collect.source_plane(build, declared, True, ())
    assert collect.source_plane(build, declared, False, ())["sources"].count() == 4
