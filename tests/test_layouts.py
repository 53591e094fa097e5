"""Stored copies, line offsets and trigrams: same answers, less read."""

import hashlib
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import text
from codefacts.operators import callgraph, common, inlining, source_text, text_index, types
from codefacts.operators.source_ingest import dedup_blobs
from codefacts.plans import snapshot
from codefacts.plans.index import Index

N = 400


def name(i: int) -> str:
    return f"c:@F@f{i:05d}"


def content(i: int) -> str:
    rng = random.Random(i)
    words = [rng.choice(["alpha", "beta", "gämma", "δelta", "x", ""]) for _ in range(rng.randint(0, 60))]
    body = "\n".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    return body + ("\n" if i % 3 else "") + (f"needle_{i} = 漢字;\n" if i % 50 == 0 else "")


@pytest.fixture(scope="module")
def wide(spark):
    """Facts large enough to fill several row groups."""
    session = spark
    ids = session.range(N)
    usr = lambda c: F.format_string("c:@F@f%05d", c)
    symbols = ids.select(usr(F.col("id")).alias("usr"), F.format_string("f%05d", F.col("id")).alias("name"), F.lit("function").alias("kind"),
                         F.lit("external").alias("linkage"), F.lit("int (void)").alias("signature"), F.lit(False).alias("address_taken"))
    pairs = session.range(N * 40).select((F.col("id") % N).alias("a"), ((F.col("id") * 7919 + 13) % N).alias("b"))
    ends = pairs.select(usr(F.col("a")).alias("caller_usr"), usr(F.col("b")).alias("callee_usr"))
    edges = ends.withColumn("source", F.lit("compiler_cgraph")).withColumn("target", F.lit(None).cast("string"))
    linked = ends.withColumn("source", F.lit("objdump")).withColumn("target", F.lit("app"))
    records = ends.select("*", F.lit("inline").alias("pass"), F.lit(True).alias("inlined"), F.lit("").alias("reason"), F.lit("a.c").alias("file"),
                          F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("a.o").alias("object"))
    instances = ends.select("callee_usr", "caller_usr", F.lit(None).cast("string").alias("parent_callee_usr"), F.lit(1).alias("depth"),
                            F.lit("a.c").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("a.o").alias("object"))
    links = session.range(N * 20).select(F.concat(F.lit("app"), F.col("id") % 20).alias("target"), usr(F.floor(F.col("id") / 20)).alias("usr"),
                                         F.lit("").alias("name"), F.lit("a.o").alias("winning_object"), F.lit("strong").alias("linkage_kind"),
                                         F.lit("").alias("archive"))
    targets = session.createDataFrame([(f"app{i}", "executable", "") for i in range(20)], "name string, kind string, link_command string")
    held = ids.select(F.format_string("t%05d", F.col("id")).alias("usr"), F.format_string("T%d", F.col("id")).alias("name"), F.lit("struct").alias("kind"),
                      F.lit("a.h").alias("decl_file"), F.lit(1).alias("decl_line"), F.lit(8).alias("byte_size"), F.lit("").alias("underlying"))
    fields = session.range(N * 20).select(F.format_string("t%05d", F.col("id") % N).alias("type_usr"), F.lit("f").alias("name"), F.lit("int").alias("type"),
                                          F.floor(F.col("id") / N).cast("int").alias("ordinal"), F.lit(0).alias("byte_offset"))
    files = session.createDataFrame([(f"src/{i:04d}.c", content(i)) for i in range(N)], "path string, body string").repartition(3)
    hashed = files.select("path", F.col("body").cast("binary").alias("content")).withColumn("hash", F.sha2("content", 256))
    blobs = hashed.select("hash", F.octet_length("content").cast("bigint").alias("size"), "content").dropDuplicates(["hash"])
    sources = hashed.select("path", F.col("hash").alias("blob_hash"), F.lit(False).alias("is_generated"))
    none = lambda ddl: session.createDataFrame([], ddl)
    tables = dict(
        symbols=symbols, targets=targets, types=held, type_fields=fields, call_edges=edges.unionByName(linked), inline_records=records, inline_instances=instances,
        link_resolutions=links, blobs=blobs, sources=sources, inline_decisions=ends.distinct().withColumn("inlined", F.lit(True)),
        symbol_definitions=none("usr string, file string, line int, decl_file string, decl_line int, is_weak boolean, linkage_name string"),
        symbol_names=symbols.select("usr", F.col("name").alias("linkage_name")), enum_constants=none("usr string, type_usr string, name string, value bigint"),
        indirect_call_sites=none("site_id bigint, caller_usr string, file string, line int, column int, callee_type string, field_hint string"),
        icf_groups=none("winner_usr string, object_file string"), icf_group_members=none("winner_usr string, object_file string, loser_usr string"),
        target_sources=session.createDataFrame([("app0", f"src/{i:04d}.c") for i in range(0, N, 2)], "target string, file string"),
        external_sources=none("abs_path string, blob_hash string"), generated_sources=none("builddir_rel string, blob_hash string, is_generated boolean"),
    )
    return Facts.of(session, tables)


@pytest.fixture(scope="module")
def stored(spark, wide, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layouts"))
    snapshot.publish(wide, path, row_group_bytes=4096)
    return snapshot.open_snapshot(spark, path)


def read_rows(df) -> dict[str, int]:
    """Rows that each scan of a table gave out, after skipping row groups and pages."""
    session = df.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = df.select("*")
        again.collect()
        leaves = again._jdf.queryExecution().executedPlan().collectLeaves()
        out = {}
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            table = leaf.relation().location().rootPaths().apply(0).getName()
            out[table] = out.get(table, 0) + leaf.metrics().get("numOutputRows").get().value()
        return out
    finally:
        session.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(
    ("table", "total", "ask"),
    [
        ("call_edges.by_callee_usr", 16_000, lambda f: f.by("call_edges", "callee_usr").filter((F.col("source") == "compiler_cgraph") & (F.col("callee_usr") == name(200)))),
        ("call_edges", 16_000, lambda f: f.by("call_edges", "caller_usr").filter((F.col("source") == "compiler_cgraph") & (F.col("caller_usr") == name(200)))),
        ("inline_records.by_callee_usr", 16_000, lambda f: f.by("inline_records", "callee_usr").filter(F.col("callee_usr") == name(200))),
        ("inline_instances.by_callee_usr", 16_000, lambda f: f.by("inline_instances", "callee_usr").filter(F.col("callee_usr") == name(200))),
        ("link_resolutions.by_target", 8_000, lambda f: f.by("link_resolutions", "target").filter(F.col("target") == "app3")),
        ("type_fields", 8_000, lambda f: f.by("type_fields", "type_usr").filter(F.col("type_usr") == "t00100")),
    ],
)
def test_a_lookup_reads_few_rows_of_a_sorted_copy(stored, table, total, ask):
    read = read_rows(ask(stored.facts))
    assert set(read) == {table}
    assert 0 < read[table] <= total / 3


def test_answers_from_copies_equal_those_of_the_facts(wide, stored):
    pairs = [
        (callgraph.list_callers, (name(7),)), (callgraph.list_callers, (name(7), "app3")), (callgraph.list_callees, (name(7), "app3")),
        (callgraph.list_linked_callers, (name(7), "app")), (inlining.summary, (name(7), "callee_usr")), (inlining.summary, (name(7), "caller_usr")), (types.fields, ("t00007",)),
    ]
    for ask, values in pairs:
        want = rows(ask(wide, *values))
        assert want and rows(ask(stored.facts, *values)) == want
    assert rows(types.find_type(stored.facts, "T7", exact=True)) == rows(types.find_type(wide, "T7", exact=True))


def test_snapshots_without_copies_still_answer(spark, wide, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "COPIES", {})
    snapshot.publish(wide, str(tmp_path))
    opened = snapshot.open_snapshot(spark, str(tmp_path))
    assert rows(callgraph.list_callers(opened.facts, name(7))) == rows(callgraph.list_callers(wide, name(7)))


# -- line offsets -----------------------------------------------------------------


@pytest.mark.parametrize("most_lines", [1_000_000, 37])
def test_windows_equal_those_of_split_contents(spark, stored, wide, most_lines):
    odd = ["", "\n", "\n\n", "a", "a\n", "a\n\n", "\na", "é\n漢\r\n\nz"]
    made = spark.createDataFrame([(f"{i:064x}", bytearray(t.encode())) for i, t in enumerate(odd)], "hash string, content binary")
    for facts in (stored.facts, wide, Facts.of(spark, {"blobs": made})):
        lines = spark.range(-1, 9).select(F.col("id").cast("int").alias("line"))
        asked = facts.blobs.select(F.col("hash").alias("blob_hash")).crossJoin(lines)
        body = F.col("content").cast("string")
        want = asked.join(facts.blobs.withColumnRenamed("hash", "blob_hash"), "blob_hash").select("blob_hash", "line", text.line_window(body, F.col("line"), 2).alias("w"))
        want = want.filter("w IS NOT NULL").select("blob_hash", "line", "w.*")
        found = text_index.windows(facts, asked, 2, most_lines).select("blob_hash", "line", "snippet.*")
        assert rows(found) == rows(want)


def test_no_content_is_shuffled_for_windows(stored):
    asked = stored.facts.sources.select("blob_hash", F.lit(2).alias("line"))
    plan = text_index.with_windows(stored.facts, asked, 1)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
    assert shuffled
    for at, line in enumerate(plan.splitlines()):
        if "ColumnarToRow" in line or "FileScan" in line and "content" in line:
            above = plan.splitlines()[at - 4 : at]
            assert not any("hashpartitioning" in a and "content" in line for a in above)


# -- trigrams ---------------------------------------------------------------------

PATTERNS = ["needle_", "alpha beta", "漢字;", "x", "al", "gämma δ"]
REGEXES = [r"needle_\d+", r"(alpha|beta) gäm+a", r"δel(ta)?\b", r"^x", r"(?i)ALPHA beta", r"[ab]l?pha", r"n(ee|oo)dle_[12]50", r"(alpha|.*)gämma", r"(beta|δelta )+x", "alpha.{0,3}beta|漢字"]


def plain_matches(pattern):
    out = []
    for i in range(N):
        for n, line in enumerate(content(i).removesuffix("\n").split("\n"), 1) if content(i) else ():
            for m in re.finditer(pattern, line):
                out.append((f"src/{i:04d}.c", n, len(line[: m.start()].encode()) + 1, m.group(0)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("pattern", "regex"), [*((p, False) for p in PATTERNS), *((p, True) for p in REGEXES)])
def test_search_by_trigrams_finds_every_match(stored, pattern, regex):
    wanted = source_text.files(stored.facts)
    found = source_text.file_matches(source_text.blob_matches(stored.facts, pattern, regex, wanted), wanted)
    assert rows(found, "path", "line", "column", "match_text") == plain_matches(pattern if regex else re.escape(pattern))


def test_few_contents_are_read_for_a_rare_text(stored):
    wanted = source_text.files(stored.facts)
    for pattern, regex, n in (("needle_", False, N // 50), (r"needle_\d+ =", True, N // 50), ("needle_150", False, 1), (r"le_[12]50", True, 2)):
        chosen = text_index.candidates(stored.facts, text_index.clauses_of(pattern, regex))
        assert chosen.count() == n
        # row groups of this snapshot hold 100 contents
        assert read_rows(text_index.chosen_contents(stored.facts, pattern, regex, wanted))["blobs"] <= 100 * n
    own = source_text.files(stored.facts, target="app0", path_prefix="src/00")
    assert text_index.chosen_contents(stored.facts, "x", False, own).count() <= 50


def test_clauses_hold_for_every_match():
    rng = random.Random(6)
    atoms = ["a", "b", "é", "[ab]", ".", "a?", "b*", "(ab)+", "(a|bé)", "(ab|.*)", "^", "$", r"\b", "(?:aé){2,3}", "[^a]", "(a|)", "(?i:b)", "(?=a)"]
    for _ in range(3000):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randint(1, 7)))
        clauses = text_index.clauses_of(pattern, True)
        for _ in range(4):
            line = "".join(rng.choice("abéB ") for _ in range(rng.randint(0, 14)))
            if re.search(pattern, line):
                assert all(any(s in line.encode() for s in clause) for clause in clauses), (pattern, clauses, line)


def test_index_search_reads_contents_once(spark, stored):
    index = Index(spark, stored.path)
    answer = index.search_source("needle_", context=1, limit=3)
    assert answer.truncated and answer.rows.count() == 3
    assert answer.parts["summary"].first()["total"] == len(plain_matches("needle_"))
    assert {r["path"]: r["n"] for r in answer.parts["matches_by_file"].collect()} == {f"src/{i:04d}.c": 1 for i in range(0, N, 50)}
    for part in (answer.rows, *answer.parts.values()):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "contains(" not in plan.lower()


def test_derived_contents_are_made_once_for_many_windows(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    texts = [("".join(f"line {i} {j}\n" for j in range(30)),) for i in range(60)]
    raw = spark.createDataFrame(texts, "t string").selectExpr("cast(t AS binary) AS content").mapInArrow(counted, "content binary")
    facts = Facts.of(spark, {"blobs": dedup_blobs(raw)})
    hashes = spark.createDataFrame(texts, "t string").select(F.sha2(F.col("t").cast("binary"), 256).alias("blob_hash"))
    asked = hashes.crossJoin(spark.range(1, 31).select(F.col("id").cast("int").alias("line")))
    found = text_index.windows(facts, asked, 1, 100).select("blob_hash", "line", "snippet.start_line", "snippet.end_line", "snippet.text")
    got = found.collect()
    # Once for the lines and once for the windows, whatever the number of rounds.
    assert len(got) == 1800 and made.value <= 2 * len(texts)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): t.splitlines() for (t,) in texts}
    for h, line, first, last, text_ in got:
        assert (first, last) == (max(line - 1, 1), min(line + 1, 30))
        assert text_ == "\n".join(by_hash[h][first - 1 : last])


def test_places_of_many_windows_are_worked_out_once(stored):
    asked = stored.facts.sources.select("blob_hash", F.lit(2).alias("line"))
    plan = text_index.windows(stored.facts, asked, 1, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "line_starts" not in plan and "collect_list" not in plan
