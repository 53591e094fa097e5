"""Readers on hand-written dumps; blocks of a few lines exercise the carrying of context."""

import gzip
import json
import re
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.sources import (
    build_description,
    build_tree,
    callgraph_info,
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
from codefacts.sources.lines import carry_forward, read_lines


def test_read_lines_orders_split_files(spark, tmp_path):
    lines = [f"line {i} é" for i in range(5000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode() + b"\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_lines(spark, str(tmp_path), "*.txt")
        assert df.select("block").distinct().count() > 1
        got = [r["line"] for r in df.orderBy("block", "pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines
    assert df.first()["file"] == str(tmp_path / "a.txt")


@pytest.mark.parametrize("per_block", [1, 2, 5, 100])
def test_carry_forward_equals_a_plain_scan(spark, text_lines, per_block):
    lines = ["x", "A", "x", "x", "B", "x", "C", "x", "x", "x", "x"]
    df = text_lines("\n".join(lines), per_block=per_block)
    mark = F.when(F.col("line") != "x", F.col("line"))
    for current in (True, False):
        got = carry_forward(df, {"m": mark}, include_current=current).orderBy("pos").collect()
        want, last = [], None
        for line in lines:
            before = last
            last = line if line != "x" else last
            want.append(last if current else before)
        assert [r["m"] for r in got] == want


CI = """graph: { title: "../src/a.c"
node: { title: "f" label: "f\\nsrc/a.c:3:5\\n48 bytes (static)\\n2 dynamic objects" }
node: { title: "puts" label: "puts\\n<built-in>" shape : ellipse }
node: { title: "__indirect_call" label: "Indirect Call Placeholder" shape : ellipse }
edge: { sourcename: "f" targetname: "puts" label: "src/a.c:4:3" }
edge: { sourcename: "f" targetname: "__indirect_call" label: "src/a.c:9:7" }
}"""


def test_callgraph_info(text_lines):
    lines = text_lines(CI)
    assert rows(callgraph_info.titles(lines)) == [("f", "../src/a.c")]
    nodes = {r["name"]: r for r in callgraph_info.nodes(lines).collect()}
    f = nodes["f"]
    assert (f["decl_file"], f["decl_line"], f["decl_column"]) == ("src/a.c", 3, 5)
    assert (f["stack_bytes"], f["stack_kind"], f["dynamic_objects"], f["is_external"]) == (48, "static", 2, False)
    assert nodes["puts"]["is_external"] and nodes["puts"]["decl_file"] == ""
    assert nodes["__indirect_call"]["is_indirect"]
    assert rows(callgraph_info.edges(lines), "callee", "site_line", "is_indirect") == [
        ("__indirect_call", 9, True),
        ("puts", 4, False),
    ]


CGRAPH = """Trivially needed symbols: main/5
Initial Symbol table:

main/5 (main)
  Type: function definition analyzed
  Visibility: force_output public
  References: ops/9 (read)
  Calls: helper/4 (1.00 per call) puts/8 (1.00 per call)
helper/4 (helper)
  Type: function definition analyzed
  Referring: ops/9 (addr)
  Calls:
noise at column zero
  Visibility: never seen

Optimized Symbol table:

main/5 (main)
  Type: function definition analyzed
  Visibility: externally_visible public
  Calls: helper.constprop.0/11 (inlined) (1.00 per call) puts/8 (1073741824 (estimated locally),1.00 per call)
helper.constprop.0/11 (helper.constprop.0)
  Type: function definition analyzed
  Clone of helper/4
Removing basic block
  Address is taken.
Final Symbol table:
main/5 (main)
  Type: function
  Body removed by symtab_remove_unreachable_nodes
  Calls: puts/8
"""


@pytest.mark.parametrize("per_block", [1, 4, 100])
def test_symbol_table_dump_keeps_the_richer_observation(text_lines, per_block):
    lines = text_lines(CGRAPH, per_block=per_block)
    nodes = {r["local_id"]: r for r in symbol_table_dump.nodes(lines).collect()}
    assert set(nodes) == {"5", "4", "11"}
    main = nodes["5"]
    assert (main["kind"], main["analyzed"], main["body_removed"]) == ("function", True, True)
    assert main["visibility"] == ["externally_visible", "public"]
    assert nodes["4"]["address_taken"] and nodes["4"]["visibility"] == []
    assert nodes["11"]["clone_of"] == "4" and not nodes["11"]["address_taken"]
    # Two calls beat one; of two lists of two the later stands.
    assert rows(symbol_table_dump.calls(lines), "caller_id", "callee_id", "inlined") == [
        ("5", "11", True),
        ("5", "8", False),
    ]


INLINE = """IPA function summary for f/1 inlinable
  calls:
    g/2 function not considered for inlining
IPA function summary for h/3 not inlinable
  calls:
    g/2 inlined
IPA function summary for f/1 inlinable
  calls:
    g/2 inlined
      freq:1.00
    puts/9 function body not available

    late/7 inlined
Some other text
    k/5 inlined
"""


def test_inline_dump_takes_the_last_summary(text_lines):
    lines = text_lines(INLINE)
    assert rows(inline_dump.inlined_callees(lines), "local_id", "callee_id") == [("1", "2"), ("3", "2")]
    assert rows(inline_dump.summaries(lines), "local_id", "inlinable") == [("1", True), ("3", False)]


ICF = """Introduced new external node (win.localalias/40).
Analyzing function: win/1
  _1 = win.localalias (x);
Analyzing function: lose/2
  retval = win.localalias (x_2(D)); [tail call]
  retval = ghost.localalias (x);
Introduced new external node (lonely.localalias/41).
"""


def test_folding_needs_both_signals(text_lines):
    assert rows(folding_dump.members(text_lines(ICF)), "winner", "loser") == [("win", "lose")]


def _document(records, form="1"):
    tree = [{"id": "0x1", "name": "top", "optgroups": [], "children": [
        {"id": "0x2", "name": "einline", "optgroups": ["ipa", "inline"], "children": [
            {"id": "0x3", "name": "deep", "optgroups": ["inline"]}]},
        {"id": "0x4", "name": "vect", "optgroups": ["vec"]}]}]
    return json.dumps([{"format": form}, tree, records])


def _node(name):
    return {"symtab_node": name, "location": {"file": "a.c"}}


def test_optimization_records(spark, tmp_path):
    at = {"file": "src/a.c", "line": 7, "column": 3}
    records = [
        {"kind": "success", "pass": "0x2", "message": ["Inlined ", _node("g/2"), " into ", _node("f.part/1"), " now"], "location": at},
        {"kind": "failure", "pass": "0x3", "message": ["not inlinable: ", _node("f/1"), " -> ", _node("g/2"), ", function body not available.\n\nsummary"]},
        {"kind": "success", "pass": "0x2", "message": ["Inlining ", _node("g/2"), " to ", _node("f/1"), ""]},
        {"kind": "note", "pass": "0x2", "message": ["Considering ", _node("g/2"), " into ", _node("f/1")]},
        {"kind": "success", "pass": "0x4", "message": ["x ", _node("g/2"), " into ", _node("f/1")]},
        {"kind": "success", "pass": "0x2", "message": ["one ", _node("g/2")]},
        {"kind": "success", "pass": "0x2", "message": ["x ", _node("g/2"), " beside ", _node("f/1")]},
        {"kind": "success", "pass": "0x2", "message": ["Inlining ", _node("g/2"), " to ", _node("f/1"), ""]},
        {"kind": "failure", "pass": "0x2", "message": ["{\"symtab_node\": \"text\"} ", _node("f/1"), "->", _node("h/3"), ", call is cold"]},
    ]
    path = tmp_path / "a.c.c.opt-record.json.gz"
    path.write_bytes(gzip.compress(_document(records).encode()))
    docs = optimization_record.read_documents(spark, str(tmp_path))
    got = rows(
        optimization_record.records(docs),
        "pass", "caller", "caller_id", "callee", "callee_id", "inlined", "reason", "line",
    )
    assert got == sorted([
        ("einline", "f.part", "1", "g", "2", True, "", 7),
        ("deep", "f", "1", "g", "2", False, "function body not available", 0),
        ("einline", "f", "1", "g", "2", True, "", 0),
        ("einline", "f", "1", "h", "3", False, "call is cold", 0),
    ], key=str)


def test_optimization_record_refuses_other_formats(spark):
    docs = spark.createDataFrame([("f", _document([], form="2"))], "file string, document string")
    with pytest.raises(Exception, match="unsupported optimization-record format 2"):
        optimization_record.records(docs).collect()


def test_symbol_listing(text_lines):
    lines = text_lines("compute T 11d0 29\n\n__bss_start B 4018\nprintf@GLIBC U\nlocal t 10 zz\nbad\nweak W 1 2\nu1 u 1 2")
    got = rows(symbol_listing.symbols(lines), "name", "nm_kind", "address", "size", "linkage_kind", "is_local", "is_function")
    assert got == sorted([
        ("compute", "T", "11d0", 0x29, "strong", False, True),
        ("__bss_start", "B", "4018", 0, "strong", False, False),
        ("printf@GLIBC", "U", "", 0, "", False, False),
        ("local", "t", "10", 0, "", True, True),
        ("weak", "W", "1", 2, "weak", False, True),
        ("u1", "u", "1", 2, "unique_global", True, False),
    ], key=str)


OBJDUMP = """
a.out:     file format elf64-x86-64
    1000:\tcall   9 <too_early>
0000000000001040 <main>:
    1040:\tpush   %rbx
    104b:\tcall   11d0 <compute>
    1050:\tcall   *0x2d5e(%rip)        # 3dc0 <g_ops>
    1055:\tjmp    1030 <printf@plt>
    1057:\tjne    1040 <main>

00000000000011d0 <compute>:
    11d0:\tcall   1040 <main>
"""


@pytest.mark.parametrize("per_block", [1, 3, 50])
def test_disassembly(text_lines, per_block):
    got = rows(disassembly.direct_calls(text_lines(OBJDUMP, per_block=per_block)).drop("file"))
    assert got == [
        ("compute", "00000000000011d0", "main", "1040"),
        ("main", "0000000000001040", "compute", "11d0"),
        ("main", "0000000000001040", "printf@plt", "1030"),
    ]


MAP = """ .text          0x0000000000000001        0x1 early.o
                0x0000000000000001                ignored
Archive member included to satisfy reference by file (symbol)

lib/libs.a.p/weak.c.o
                              app/app.p/main.c.o (hook)
                              app/app.p/other.c.o (again)
Discarded input sections

 .text          0x0000000000001040       0x42 app/app.p/main.c.o
                0x0000000000001040                main
 *fill*         0x0000000000001082        0xe
                0x0000000000001090                orphan
 .text.add_ints
                0x00000000000011c0        0x4 lib/libs.a.p/u.c.o
                0x00000000000011c0                add_ints
 .text.never_called
 .text          0x0000000000001200        0x6 app/app.p/strong.c.o
                0x0000000000001200                hook
                0x0000000000001200                main
                0x0000000000001204        0x6 not/after/a/header.c.o
                0x0000000000001205                last
"""


@pytest.mark.parametrize("per_block", [1, 2, 7, 100])
def test_linker_map(text_lines, per_block):
    lines = text_lines(MAP, per_block=per_block)
    assert rows(linker_map.origins(lines), "name", "object") == [
        ("add_ints", "lib/libs.a.p/u.c.o"),
        ("hook", "app/app.p/strong.c.o"),
        ("last", "app/app.p/strong.c.o"),
        ("main", "app/app.p/main.c.o"),
    ]
    assert rows(linker_map.archive_pulls(lines), "object", "referrer", "symbol") == [
        ("lib/libs.a.p/weak.c.o", "app/app.p/main.c.o", "hook")
    ]


def _log(*records, version=4):
    data = dependency_log.MAGIC + struct.pack("<I", version)
    for record in records:
        if isinstance(record, tuple) and isinstance(record[0], str):
            name, ident = record
            raw = name.encode()
            raw += b"\0" * (-len(raw) % 4)
            data += struct.pack("<I", len(raw) + 4) + raw + struct.pack("<I", 0xFFFFFFFF ^ ident)
        else:
            out, inputs = record
            body = struct.pack(f"<3I{len(inputs)}I", out, 1, 0, *inputs)
            data += struct.pack("<I", len(body) | 1 << 31) + body
    return data


def test_dependency_log(spark, tmp_path):
    good = _log(("a.o", 0), ("../x.c", 1), (0, [1]), ("h.h", 2), (0, [1, 2]), ("b.o", 3), (3, []), (9, [1]))
    (tmp_path / ".ninja_deps").write_bytes(good + b"\x10\0\0")
    got = rows(dependency_log.read_dependencies(spark, str(tmp_path)), "output", "ordinal", "input")
    assert got == [("a.o", 0, "../x.c"), ("a.o", 1, "h.h")]
    for bad in (b"nothing", _log(version=3), _log(("a", 5))):
        with pytest.raises(ValueError):
            list(dependency_log.entries(bad))


def test_build_description(spark, tmp_path):
    info = tmp_path / "meson-info"
    info.mkdir()
    c = {"language": "c", "compiler": ["cc"], "parameters": ["-g"], "sources": ["/p/a.c", "/p/a.c"], "generated_sources": ["/p/b/g.h"]}
    link = {"linker": ["cc", "-o"], "parameters": ["app", "-lm"]}
    asm = {"language": "nasm", "sources": ["/p/x.asm"]}
    (info / "intro-targets.json").write_text(json.dumps([
        {"name": "app", "type": "executable", "filename": ["/p/b/app"], "target_sources": [c, asm, link]},
        {"name": "s", "type": "static library", "filename": ["/p/b/libs.a"], "target_sources": []},
        {"name": "j", "type": "jar", "filename": [], "target_sources": []},
    ]))
    (info / "intro-compilers.json").write_text(json.dumps({"host": {"c": {"id": "gcc", "version": "16.2.1"}}}))
    raw = build_description.read(spark, str(tmp_path), "intro-targets", build_description.TARGETS_SCHEMA)
    assert rows(build_description.targets(raw), "name", "kind", "link_command") == [
        ("app", "executable", "cc -o app -lm"), ("j", "jar", ""), ("s", "static_library", ""),
    ]
    assert rows(build_description.target_files(raw)) == [
        ("app", "/p/a.c", False), ("app", "/p/a.c", False), ("app", "/p/b/g.h", True),
    ]
    compilers = build_description.read(spark, str(tmp_path), "intro-compilers", build_description.COMPILERS_SCHEMA)
    assert build_description.compiler(compilers).first()["version"] == "16.2.1"


def test_build_tree(spark, tmp_path):
    for name in (
        "app/app.p/main.c.o", "app/app.p/main.c.ci", "app/app.p/main.c.i", "app/app.p/main.c.c.000i.cgraph",
        "app/app.p/main.c.c.091i.icf", "app/app.p/main.c.c.opt-record.json.gz", "app/app.p/main2.c.ci",
        "lib/x.c.o", "meson-private/sanity.c.o", "deep/meson-private/kept.c.o", "app1.map", "app/inner.map",
    ):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    files = build_tree.list_files(spark, str(tmp_path))
    got = {r["object"]: r for r in build_tree.artifacts(files, str(tmp_path)).collect()}
    assert set(got) == {"app/app.p/main.c.o", "lib/x.c.o", "deep/meson-private/kept.c.o"}
    main = got["app/app.p/main.c.o"]
    base = f"{tmp_path}/app/app.p/main.c"
    assert (main["ci"], main["preprocessed"], main["cgraph"], main["icf"], main["inline"], main["opt_record"]) == (
        f"{base}.ci", f"{base}.i", f"{base}.c.000i.cgraph", f"{base}.c.091i.icf", None, f"{base}.c.opt-record.json.gz",
    )
    assert got["lib/x.c.o"]["ci"] is None
    assert rows(build_tree.linker_maps(files, str(tmp_path))) == [("app1", f"{tmp_path}/app1.map")]


def test_tools_stream_lines(spark, tmp_path):
    (tmp_path / "a").write_text("one\ntwo\nthree\n")
    files = spark.createDataFrame([("x", str(tmp_path / "a"))], "file string, path string")
    got = tools.run(files, ("cat",), keep="t").orderBy("pos").collect()
    assert [(r["file"], r["pos"], r["line"]) for r in got] == [("x", 1, "two"), ("x", 2, "three")]
    with pytest.raises(Exception, match="cat failed"):
        tools.run(spark.createDataFrame([("x", "/no/such")], "file string, path string"), ("cat",)).collect()


def test_object_tables(text_lines):
    table = text_lines("""include_directories[  0] = "/p/build"
include_directories[  1] = "../src"
file_names[  1]:
           name: "a.c"
      dir_index: 1
file_names[  2]:
           name: "/usr/h.h"
      dir_index: 0
Address            Line   Column File   ISA Discriminator OpIndex Flags
0x0000000000000000      5      1      1   0             0       0  is_stmt
0x0000000000000010      6      3      1   0             0       0  is_stmt
0x0000000000000010      7      4      2   0             0       0  is_stmt""")
    assert rows(object_tables.line_rows(table), "address", "line", "column", "source") == [
        (0, 5, 1, "../src/a.c"), (16, 7, 4, "/usr/h.h"),
    ]
    reloc = text_lines("""RELOCATION RECORDS FOR [.text]:
OFFSET           TYPE              VALUE
0000000000000012 R_X86_64_PC32     g_ops+0x0000000000000004
0000000000000020 R_X86_64_PC32     g_hook-0x0000000000000004
RELOCATION RECORDS FOR [.text.f]:
0000000000000001 R_X86_64_PLT32    puts""")
    assert rows(object_tables.relocations(reloc).drop("file")) == [
        (".text", 18, "g_ops", 4), (".text", 32, "g_hook", -4), (".text.f", 1, "puts", 0),
    ]
    symbols = text_lines("""0000000000000000 l    df *ABS*\t0000000000000000 a.c
0000000000000010 g     F .text\t0000000000000029 compute
0000000000000000 l     F .text.f\t0000000000000005 .hidden f""")
    assert rows(object_tables.function_symbols(symbols).drop("file")) == [
        ("compute", ".text", 16, 41), ("f", ".text.f", 0, 5),
    ]


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _watched(spark, df):
    """``df`` and a count of the rows read of it."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.coalesce(1).mapInArrow(counted, df.schema), read


def test_dependency_logs_are_parsed_once(spark):
    logs = spark.createDataFrame([(f"f{i}", b"# ninjadeps\n\x04\x00\x00\x00") for i in range(3)], "file string, content binary")
    watched, read = _watched(spark, logs)
    assert dependency_log.dependencies(watched).collect() == []
    assert read.value == 3


def test_inline_dumps_leave_text_behind(text_lines):
    plan = _optimized(inline_dump.inlined_callees(text_lines(INLINE))).split("\n")
    below = [after for line, after in zip(plan, plan[1:]) if "Window [last(" in line and "Window [" not in after]
    assert below and not any(re.search(r"(\[|, )line#\d+[,\]]", line) for line in below)


def test_nodes_leave_calls_behind(text_lines):
    assert "Calls:" not in _optimized(symbol_table_dump.nodes(text_lines("f/1 (f)\n  Calls: g/2")))


def test_messages_of_records_are_read_once(spark):
    docs = spark.createDataFrame([("f", "[]")], "file string, document string")
    plan = _optimized(optimization_record.records(docs))
    assert (plan.count("schemaOfVariant("), plan.count("ArrowEvalPython")) == (1, 1)


def test_observing_resolves_no_clones(spark, tmp_path, monkeypatch):
    from codefacts.operators import symbol_ingest
    import codefacts.plans.ingest_queries  # noqa: F401  (it registers the query)
    from codefacts.plans.queries import REGISTRY

    spark.sql("SELECT 5L AS l_orderkey, 1L AS l_partkey, 1 AS l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1L AS p_partkey, 'a b' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 45 AS p_size").write.parquet(
        str(tmp_path / "part.parquet")
    )
    monkeypatch.setattr(symbol_ingest, "attribute_clones", lambda *_: pytest.fail("clones were resolved"))
    assert rows(REGISTRY["symbol_observe"](spark, str(tmp_path)), "name", "object") == [("a_b_1", "obj/u_5.c.o")]
