"""Nothing is dropped without a word: depth, size, names and remote paths."""

import struct
import sys

import pytest
from conftest import rows

from codefacts.operators import symbol_ingest
from codefacts.sources import build_tree, debug_info, dependency_log, tools

NODES = "object string, local_id long, clone_of string, name string, linkage_name string, address_taken boolean"
DIES = "file string, offset long, parent long, tag string, name string, type_ref long, abstract_origin_ref long, prototyped boolean"


def test_clones_of_clones_to_any_depth(spark):
    chain = [("a.o", i, str(i - 1), f"f.{i}", f"f.{i}", False) for i in range(2, 9)]
    ring = [("a.o", 20, "21", "r", "r", False), ("a.o", 21, "20", "r", "r", False)]
    observed = spark.createDataFrame([("a.o", "1", "c:@F@f")], "object string, local_id string, usr string")
    clones = spark.createDataFrame([*chain, *ring], NODES)
    clones = clones.withColumn("local_id", clones["local_id"].cast("string"))
    found = symbol_ingest.attribute_clones(clones, observed)
    assert rows(found, "local_id", "usr") == [(str(i), "c:@F@f") for i in range(2, 9)]


def test_bodies_nested_deeper_than_any_bound(spark):
    depth = 34
    dies = [("f", 0, None, "subprogram", "host", None, None, True)]
    dies += [("f", i, i - 1, "inlined_subroutine", None, None, 1000 + i, True) for i in range(1, depth + 1)]
    dies += [("f", 1000 + i, None, "subprogram", f"g{i}", None, None, True) for i in range(1, depth + 1)]
    found = debug_info.enclosing(spark.createDataFrame(dies, DIES), "inlined_subroutine").collect()
    levels = {r["offset"]: (r["function"], r["inlined_levels"]) for r in found}
    assert levels == {i: ("host", i - 1) for i in range(1, depth + 1)}


def test_qualifiers_to_any_depth_and_in_a_circle(spark):
    chain = [("f", i, None, "const_type", None, i + 1, None, None) for i in range(40)]
    dies = [*chain, ("f", 40, None, "base_type", "int", None, None, None)]
    dies += [("f", 50, None, "typedef", "a", 51, None, None), ("f", 51, None, "typedef", "b", 50, None, None)]
    found = {r["offset"]: r["base"] for r in debug_info.stripped_types(spark.createDataFrame(dies, DIES)).collect()}
    assert found == {i: 40 for i in range(41)}


def test_a_noisy_tool_does_not_block(spark, tmp_path):
    script = tmp_path / "noisy.py"
    script.write_text("import sys\nfor i in range(3):\n    sys.stderr.write('w' * 200_000)\n    print(i)\n")
    files = spark.createDataFrame([("x", str(script))], "file string, path string")
    assert tools.run(files, (sys.executable,)).count() == 3
    script.write_text("import sys\nsys.stderr.write('bad file')\nsys.exit(2)\n")
    with pytest.raises(Exception, match="bad file"):
        tools.run(files, (sys.executable,)).collect()


def test_dependency_log_by_uri_and_bad_sizes(spark, tmp_path):
    record = b"a.o\0" + struct.pack("<I", 0xFFFFFFFF)
    source = b"a.c\0" + struct.pack("<I", 0xFFFFFFFE)
    deps = struct.pack("<4I", 0, 1, 0, 1)
    head = dependency_log.MAGIC + struct.pack("<I", 4)
    good = head + struct.pack("<I", 8) + record + struct.pack("<I", 8) + source + struct.pack("<I", 16 | 1 << 31) + deps
    (tmp_path / ".ninja_deps").write_bytes(good)
    for place in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert rows(dependency_log.read_dependencies(spark, place), "output", "input") == [("a.o", "a.c")]
    assert dependency_log.read_dependencies(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="2 bytes"):
        list(dependency_log.entries(good + struct.pack("<I", 2) + b"xx"))


def test_names_with_percent_signs(spark, tmp_path):
    for name in ("100%.c", "a%20b.c", "plus+.c"):
        (tmp_path / name).write_text("x")
    found = rows(build_tree.list_files(spark, str(tmp_path)), "path")
    assert found == sorted((f"{tmp_path}/{n}",) for n in ("100%.c", "a%20b.c", "plus+.c"))
