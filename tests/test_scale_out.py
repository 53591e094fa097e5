"""What spreads large inputs and keeps old versions: address parts, named live files, running sums, leases."""

import shutil
import struct
import subprocess
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_operators import mini_facts

from codefacts.functions import text
from codefacts.plans import snapshot
from codefacts.plans.index import Index
from codefacts.plans.sql_query import sql_query
from codefacts.sources import dependency_log, disassembly, dump_source, symbol_listing, tools


needs_tools = pytest.mark.skipif(not all(map(shutil.which, ("as", "ld", "nm", "objdump"))), reason="no binary tools here")


@pytest.fixture(scope="module")
def binary(tmp_path_factory):
    """An assembled program of small functions that call each other; some names share an address."""
    folder = tmp_path_factory.mktemp("binary")
    code = [".text"]
    for i in range(40):
        code += [f".globl f{i}", f".type f{i}, @function", f"f{i}:", *(["nop"] * (i % 7)), f"call f{i // 2}", f"call f{(i * 7) % 40}", "ret"]
        code += [f".globl alias{i}", f".set alias{i}, f{i}"] if i % 10 == 0 else []
    code += [".globl _start", "_start:", "call f39", "jmp f20", ".section .extra, \"ax\"", ".globl late", "late:", "call f1", "ret"]
    (folder / "a.s").write_text("\n".join([*code, ""]))
    subprocess.run(["as", "-o", folder / "a.o", folder / "a.s"], check=True, timeout=120)
    subprocess.run(["ld", "-o", folder / "a", folder / "a.o"], check=True, timeout=120)
    return str(folder / "a")


@needs_tools
@pytest.mark.parametrize("per_part", [1, 7, 10_000])
def test_parts_of_a_binary_give_the_calls_of_the_whole(spark, binary, per_part):
    files = spark.createDataFrame([("app", binary), ("bare", binary)], "file string, path string")
    listing = symbol_listing.symbols(tools.run(files.filter("file = 'app'"), tools.DEFINED_SYMBOLS))
    functions = listing.filter("is_function AND address <> ''").select("file", "address")
    parts = tools.address_parts(files, functions, per_part)
    n = parts.filter("file = 'app'").count()
    assert n == 1 if per_part == 10_000 else n > 40 // per_part / 2
    assert parts.filter("file = 'bare'").count() == 1
    found = rows(disassembly.direct_calls(tools.run(parts, tools.DISASSEMBLY)))
    whole = rows(disassembly.direct_calls(tools.run(files, tools.DISASSEMBLY)))
    assert found == whole and sum(r[0] == "app" for r in whole) == 83
    keep = r"^[0-9a-fA-F]+\s+<|\s(call|jmp)\s"
    assert rows(disassembly.direct_calls(tools.run(parts, tools.DISASSEMBLY, keep))) == whole


@needs_tools
def test_inspections_are_not_merged_into_one_task(spark, binary):
    files = spark.createDataFrame([(f"app{i}", binary) for i in range(12)], "file string, path string")
    lines = tools.run(files, tools.DEFINED_SYMBOLS).withColumn("task", F.spark_partition_id())
    assert lines.select("task").distinct().count() > 4


# -- running sums -----------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 511, 513, 2000])
def test_columns_of_many_occurrences(spark, n):
    line = "é".join("ab" + "x" * (i % 5) for i in range(n)) + "tail"
    want, at, data = [], 0, line.encode()
    while (at := data.find(b"ab", at)) >= 0:
        want.append(at + 1)
        at += 2
    df = spark.createDataFrame([(line,)], "s string")
    assert df.select(text.literal_columns(F.col("s"), "ab").alias("c")).first()["c"] == want


def test_a_line_with_very_many_occurrences_is_quick(spark):
    df = spark.createDataFrame([("ab-" * 100_000,)], "s string").select(text.literal_columns(F.col("s"), "ab").alias("c"))
    df.select(F.size("c")).collect()
    began = time.perf_counter()
    found = df.select(F.size("c").alias("n"), F.element_at("c", -1).alias("last")).first()
    assert (found["n"], found["last"]) == (100_000, 3 * 99_999 + 1)
    assert time.perf_counter() - began < 10


# -- live files ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    snapshot.publish(mini_facts(spark), path)
    return path


def test_only_indexed_files_below_the_prefix_are_opened(spark, published, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "other [x]").mkdir()
    (tmp_path / "src" / "a.c").write_text("changed")
    for i in range(5):
        (tmp_path / "src" / f"not indexed {i}.c").write_text("x")
        (tmp_path / "other [x]" / f"{i}.bin").write_text("x")
    index = Index(spark, published, project_root=str(tmp_path))
    facts = index._facts
    for prefix in ("", "src/", "src/a"):
        live = index._live(facts.sources.select("path"), prefix)
        assert rows(live, "path") == [("src/a.c",)]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        live.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
        again = live.select("*")
        again.collect()
        scan = again._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().get("numFiles").get().value() == 1
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows(index.list_source_drift(path_prefix="src/a").rows, "path", "live_missing") == [("src/a.c", False)]
    assert rows(index.list_source_drift(path_prefix="nowhere/b").rows, "path") == []
    assert index._live(facts.sources.select("path"), "other [x]/").count() == 0


# -- the data source ------------------------------------------------------------------


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
def test_data_source_reads_every_line_once(spark, tmp_path, split):
    dump_source.register(spark)
    texts = {"a.ci": "one\r\n\nthree é\nlast", "b.ci": "\n", "empty.ci": "", "other.txt": "no"}
    (tmp_path / "sub").mkdir()
    for name, body in texts.items():
        (tmp_path / "sub" / name).write_bytes(body.encode())
    reader = lambda **options: spark.read.format(dump_source.NAME).options(**{"pattern": "*.ci", "splitBytes": split} | options)
    lines = reader().load(str(tmp_path))
    found = [(r["file"].rpartition("/")[2], r["line"]) for r in lines.orderBy("file", "block", "pos").collect()]
    assert found == [("a.ci", "one"), ("a.ci", ""), ("a.ci", "three é"), ("a.ci", "last"), ("b.ci", "")]
    assert rows(reader(keep="^(one|last)$").load(str(tmp_path)), "line") == [("last",), ("one",)]
    assert reader().load(str(tmp_path / "sub" / "other.txt")).count() == 1
    for bad in (reader().load(str(tmp_path / "none")), reader(splitBytes=0).load(str(tmp_path))):
        with pytest.raises(Exception, match="none|positive"):
            bad.collect()


# -- dependency logs ------------------------------------------------------------------


def _record(text: str, number: int) -> bytes:
    raw = text.encode() + b"\0" * (-len(text.encode()) % 4)
    return struct.pack("<I", len(raw) + 4) + raw + struct.pack("<I", 0xFFFFFFFF ^ number)


def _log(n: int) -> bytes:
    data = dependency_log.MAGIC + struct.pack("<I", 4)
    for i in range(n):
        body = struct.pack("<5I", 2 * i, 1, 0, 2 * i + 1, 1)
        data += _record(f"o{i}.o", 2 * i) + _record(f"s{i}é.c", 2 * i + 1) + struct.pack("<I", len(body) | 1 << 31) + body
    return data


@pytest.mark.parametrize("size", [1, 3, 64, 1000])
def test_a_log_in_chunks_gives_the_entries_of_the_whole(size):
    data = _log(50) + b"\x40\0"
    whole = list(dependency_log.entries(data))
    assert len(whole) == 100 and whole[3][1:] == ("o1.o", 1, "s0é.c")
    assert list(dependency_log.entries(data[i : i + size] for i in range(0, len(data), size))) == whole
    for bad in (b"", data[:5], data[:14], dependency_log.MAGIC + b"\3\0\0\0"):
        with pytest.raises(ValueError):
            list(dependency_log.entries(bad[i : i + size] for i in range(0, len(bad), size)))


def test_a_log_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / ".ninja_deps").write_bytes(_log(3))
    monkeypatch.setattr(dependency_log, "CHUNK_BYTES", 7)
    want = rows(dependency_log.read_dependencies(spark, str(tmp_path / "one")), "output", "ordinal", "input")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    place = "viewfs://logs/in"
    found = dependency_log.read_dependencies(spark, f"{place}/one", f"{place}/none")
    assert rows(found, "output", "ordinal", "input") == want and len(want) == 6
    assert {r["file"] for r in found.collect()} == {f"{place}/one/.ninja_deps"}


# -- leases -------------------------------------------------------------------------


def test_vacuum_keeps_what_is_read_and_removes_the_rest(spark, tmp_path):
    facts, path = mini_facts(spark), str(tmp_path / "idx")
    first = snapshot.publish(facts, path)
    reader = snapshot.open_snapshot(spark, path, leased=True)
    broken = mini_facts(spark)
    broken._built["blobs"] = broken.blobs.selectExpr("raise_error('disk full') AS hash", "size", "content")
    with pytest.raises(Exception, match="disk full"):
        snapshot.publish(broken, path, replace=True)
    second = snapshot.publish(facts, path, replace=True)
    assert snapshot.vacuum(spark, path) == []  # all of them are young
    removed = snapshot.vacuum(spark, path, grace=0)
    assert len(removed) == 1 and removed[0] not in (first, second)  # the failed one
    assert reader.version == first and reader.facts.symbols.count() == 7
    reader.close()
    assert snapshot.vacuum(spark, path, grace=0) == [first]
    assert snapshot.open_snapshot(spark, path).version == second
    lost = snapshot.open_snapshot(spark, path, leased=True)
    third = snapshot.publish(facts, path, replace=True)
    assert snapshot.vacuum(spark, path, grace=0) == []
    assert snapshot.vacuum(spark, path, grace=0, lease_seconds=0) == [lost.version]
    assert snapshot.current_version(spark, path) == third


def test_a_catalog_holds_the_version_in_use_and_the_one_before(spark, tmp_path):
    facts, path = mini_facts(spark), str(tmp_path / "idx")
    versions = [snapshot.publish(facts, path)]
    catalog = snapshot.Catalog(spark, path)
    for _ in range(2):
        versions.append(snapshot.publish(facts, path, replace=True))
        catalog.reload()
    assert snapshot.vacuum(spark, path, grace=0) == versions[:1]
    assert catalog.snapshot.facts.symbols.count() == 7


# -- raw SQL --------------------------------------------------------------------------


def test_statements_see_their_own_snapshot_and_leave_views_alone(spark, published, tmp_path):
    spark.createDataFrame([("mine",)], "word string").createOrReplaceTempView("symbols")
    smaller = mini_facts(spark)
    smaller._built["symbols"] = smaller.symbols.limit(3)
    snapshot.publish(smaller, str(tmp_path / "idx"))
    one, two = snapshot.open_snapshot(spark, published), snapshot.open_snapshot(spark, str(tmp_path / "idx"))
    count = "SELECT count(*) AS n FROM symbols"
    for _ in range(2):
        assert sql_query(one, count)["rows"] == [[7]] and sql_query(two, count)["rows"] == [[3]]
    assert [tuple(r) for r in spark.sql("SELECT * FROM symbols").collect()] == [("mine",)]
    spark.catalog.dropTempView("symbols")


def test_publication_samples_few_rows_for_the_driver_and_puts_the_setting_back(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    usual, seen, write = spark.conf.get(key), [], snapshot._write_sorted

    def watched(*args):
        seen.append(int(spark.conf.get(key)))
        write(*args)

    monkeypatch.setattr(snapshot, "_write_sorted", watched)
    snapshot.publish(mini_facts(spark), str(tmp_path / "idx"))
    assert seen and max(seen) <= 20
    assert spark.conf.get(key) == usual
