"""Publishing, opening, reloading and asking a snapshot."""

import re
import threading

import pytest
from conftest import rows
from test_operators import mini_facts

from codefacts import schemas
from codefacts.plans import snapshot
from codefacts.plans.index import Index
from codefacts.plans.snapshot import SnapshotError
from codefacts.plans.sql_query import SqlRefused, row_limit

MAIN, ADD = "c:@F@main", "c:src/a.c@F@add_ints"


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    facts = mini_facts(spark)
    # Losing objects are stored as candidates per name and derived when read.
    facts._builders["object_defs"] = lambda: spark.createDataFrame(
        [("hook", "lib/libs.a.p/weak.o", "W"), ("hook", "app1/strong.o", "T")],
        "name string, object string, nm_kind string",
    )
    links = facts.link_resolutions.join(facts.symbols.select("usr", "name"), "usr")
    facts._built["link_resolutions"] = links
    snapshot.publish(facts, path, properties={"gcc_version": "16"})
    return facts, path


@pytest.fixture(scope="module")
def index(spark, published):
    return Index(spark, published[1], project_root="/p")


def test_paths_are_diagnosed(spark, tmp_path):
    assert "does not exist" in snapshot.diagnose(spark, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    assert "is a file" in snapshot.diagnose(spark, str(tmp_path / "file"))
    (tmp_path / "empty").mkdir()
    assert "is empty" in snapshot.diagnose(spark, str(tmp_path / "empty"))
    (tmp_path / "half" / "v-1").mkdir(parents=True)
    assert "did not finish" in snapshot.diagnose(spark, str(tmp_path / "half"))
    with pytest.raises(SnapshotError):
        snapshot.open_snapshot(spark, str(tmp_path / "none"))


def test_publish_refuses_to_overwrite_and_failures_change_nothing(spark, published):
    facts, path = published
    before = snapshot.current_version(spark, path)
    with pytest.raises(SnapshotError, match="replace"):
        snapshot.publish(facts, path)
    broken = mini_facts(spark)
    broken._built["blobs"] = broken.blobs.selectExpr("raise_error('disk full') AS hash", "size", "content")
    with pytest.raises(Exception, match="disk full"):
        snapshot.publish(broken, path, replace=True)
    assert snapshot.current_version(spark, path) == before


def test_other_schema_version_is_refused(spark, published, tmp_path, monkeypatch):
    facts, _ = published
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", "9")
    snapshot.publish(facts, str(tmp_path))
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", "10")
    with pytest.raises(SnapshotError, match="schema version 9"):
        snapshot.open_snapshot(spark, str(tmp_path))


def test_ids_are_ranks(index):
    table = index._facts.symbols.orderBy("usr").collect()
    assert [r["id"] for r in table] == list(range(1, len(table) + 1))


def test_vocabularies_are_closed(index):
    facts = index._facts
    for column, values in schemas.VOCABULARIES.items():
        table, name = column.split(".")
        if table == "symbol_reachability":
            continue
        found = {str(r[0]) for r in getattr(facts, table).select(name).distinct().collect()}
        assert found <= set(values), column


def test_schema_names_real_columns(index):
    for table in index._facts.names:
        declared = {c.split()[0] for c in schemas.TABLE_SCHEMAS.get(table, "").split(", ") if c}
        assert declared <= set(getattr(index._facts, table).columns), table


@pytest.mark.parametrize("name", list(schemas.RECIPES))
def test_recipes_run(index, name):
    described = {r["name"]: r for r in index.describe_schema()["join_recipes"]}
    sql = described[name]["sql"]
    values = {
        "name": "add_ints.constprop.0", "usr": MAIN, "caller_usr": MAIN, "callee_usr": ADD, "path": "src/a.c",
        "target": "app1", "builddir_rel": "gen.H",
    }
    if name in ("source_callers", "runtime_callers"):
        values["usr"] = "c:@F@hook"
    if name == "inlined_into":
        values["usr"] = ADD
    if name == "external_declaration":
        values["usr"] = "c:@F@dead"
    used = {k: values[k] for k in re.findall(r":(\w+)", sql)}
    answer = index.sql_query(sql, used)
    assert answer["rowcount"] >= 1


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE symbols", "CREATE TABLE x AS SELECT 1", "INSERT INTO symbols SELECT * FROM symbols",
        "SET spark.sql.shuffle.partitions=1", "CACHE TABLE symbols", "SELECT * FROM parquet.`/etc`",
        "SELECT java_method('java.lang.System', 'exit', '1')", "SELECT * FROM default.symbols", "SELECT * FROM nowhere",
        "WITH a AS (SELECT * FROM csv.`/etc/passwd`) SELECT * FROM a",
        "SELECT (SELECT max(value) FROM text.`/etc/passwd`)", "SELECT 1 WHERE EXISTS (SELECT * FROM text.`/etc/passwd`)",
        "SELECT * FROM symbols WHERE usr IN (SELECT value FROM text.`/etc/passwd`)", "DELETE FROM symbols", "nonsense",
        "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT 1; SELECT 2",
    ],
)
def test_only_queries_pass(index, sql):
    with pytest.raises(SqlRefused):
        index.sql_query(sql)


def test_sql_queries(index):
    answer = index.sql_query(
        """WITH RECURSIVE hops(usr, n) AS (
             SELECT usr, 0 FROM symbols WHERE name = 'main'
             UNION ALL SELECT e.callee_usr, n + 1 FROM hops JOIN call_edges e ON e.caller_usr = hops.usr
             WHERE n < 2 AND e.source = 'compiler_cgraph')
           SELECT s.name, max(n) AS n FROM hops JOIN symbols s ON s.usr = hops.usr GROUP BY s.name ORDER BY s.name"""
    )
    assert answer["rows"] == [["add_ints", 1], ["hook", 1], ["main", 0]]
    ids = index.sql_query(
        """SELECT c.name FROM call_edges e JOIN symbols s ON s.id = e.callee_id JOIN symbols c ON c.id = e.caller_id
           JOIN targets t ON t.id = e.target_id WHERE s.name = ? AND t.name = ?""",
        ["hook", "app1"],
    )
    assert ids["rows"] == [["main"]]
    page = index.sql_query("SELECT usr, row_number() OVER (ORDER BY usr) AS n FROM symbols ORDER BY usr", limit=2)
    assert (page["rowcount"], page["truncated"]) == (2, True)
    assert index.sql_query("SELECT count(*) AS n FROM symbol_reachability r JOIN symbols s ON s.id = r.symbol_id")["rows"] == [[4]]
    content = index.sql_query("SELECT content FROM blobs ORDER BY size LIMIT 1")
    assert content["rows"] == [["gen add_ints"]]
    assert row_limit(None) == 500 and row_limit(20_000) == 20_000
    with pytest.raises(ValueError):
        row_limit(0)
    assert index.sql_frame("SELECT usr FROM symbols").count() > 2


def test_every_question(index):
    assert index.find_symbol("main").rows.count() == 1
    empty = index.find_symbol("flow")
    assert empty.rows.isEmpty() and "find_type" in empty.note
    described = index.describe_symbol("c:@F@hook")
    assert rows(described.parts["losing_objects"], "target", "object") == [
        ("app1", "lib/libs.a.p/weak.o"), ("app2", "app1/strong.o"),
    ]
    main = index.describe_symbol(MAIN).parts["definitions"].first()
    assert main["snippet"]["text"].startswith("int main") and main["absolute_path"] == "/p/src/a.c"
    assert rows(index.list_callers(ADD).rows, "name") == [("main",)]
    assert rows(index.list_callees(MAIN, "app1").rows, "name") == [("hook",)]
    assert index.list_call_paths(MAIN, ADD).rows.count() == 1
    assert rows(index.list_linked_callers("c:@F@printf", "app1").rows, "name") == [("hook",), ("main",)]
    assert rows(index.list_linked_callees(MAIN, "app1").rows, "name") == [("hook",), ("printf",)]
    inlined = index.describe_inlining(MAIN, limit=1)
    assert inlined.truncated and inlined.parts["records"].count() == 1
    assert rows(inlined.rows, "plane", "key", "n") == [
        ("cgraph_edges", "", 1), ("instances", "1", 1), ("records", "einline", 1), ("records", "inline", 1),
    ]
    assert index.list_inline_instances(ADD).parts["instances"].first()["caller"] == "main"
    verdict = index.explain_call(MAIN, ADD)
    assert tuple(verdict.rows.first()) == ("inlined_and_present", "", True, False)
    silent = index.explain_call(MAIN, "c:@F@hook", target="app1").rows.first()
    assert (silent["verdict"], silent["cgraph_inlined"], silent["linked_edge"]) == ("no_decision_logged", None, True)
    assert index.find_type("ops").rows.count() == 1
    layout = index.describe_type("c:h.h@S@ops").parts["fields"].collect()
    assert [r["byte_offset"] for r in layout] == [0, 8, 16, 24]
    assert [r["value"] for r in index.describe_type("c:h.h@E@flow").parts["constants"].collect()] == [0, 7, 9]
    assert index.list_indirect_call_sites(limit=1).truncated
    assert index.list_address_taken_functions("int (int, int)").rows.count() == 2
    assert index.resolve_indirect_call(1).rows.count() == 2
    assert index.describe_link_resolution("c:@F@hook", "app2").rows.first()["archive"] == "lib/libs.a"
    assert index.list_weak_symbols().rows.count() == 2
    assert index.list_undefined_symbols("app1").rows.count() == 1
    assert index.list_icf_groups("app1").rows.first()["n_losers"] == 1
    assert index.list_unreachable_symbols("app1", limit=1).truncated
    assert index.list_entry_points("app1").rows.first()["name"] == "main"
    assert index.list_targets().rows.count() == 3
    assert index.describe_target("app2").parts["archives"].first()[0] == "lib/libs.a"
    assert index.list_source_files(target="app1").rows.count() == 1
    assert index.read_source("src/a.c", 1, 1).rows.first()["content"] == "int main(void)"
    found = index.search_source("add_ints", limit=2, context=1)
    assert found.truncated and found.rows.count() == 2 and found.parts["summary"].first()["total"] == 6
    assert index.list_targets().to_json().first()[0].startswith('{"name":"app1"')


def test_unknown_names_are_errors(index):
    for ask in (
        lambda: index.describe_symbol("c:@F@none"), lambda: index.list_callers("c:@F@none"),
        lambda: index.describe_target("none"), lambda: index.describe_type("none"), lambda: index.resolve_indirect_call(99),
        lambda: index.list_source_files(target="libs"), lambda: index.read_source("none"),
        lambda: index.describe_link_resolution(MAIN, "libs"), lambda: index.list_icf_groups("none"),
    ):
        with pytest.raises(LookupError):
            ask()


def test_drift_needs_a_tree(spark, published, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.c").write_text("changed")
    index = Index(spark, published[1], project_root=str(tmp_path))
    drift = index.list_source_drift()
    assert rows(drift.rows, "path", "live_missing") == [("src/a.c", False), ("src/copy.c", True)]
    assert drift.parts["checked"].first()[0] == 2
    with pytest.raises(ValueError):
        Index(spark, published[1]).list_source_drift()


def test_reload_swaps_under_running_queries(spark, published, tmp_path):
    facts, _ = published
    path = str(tmp_path / "idx")
    snapshot.publish(facts, path)
    index = Index(spark, path)
    before = index._catalog.snapshot
    failures = []

    def ask():
        for _ in range(3):
            try:
                assert index.list_targets().rows.count() == 3
            except Exception as error:
                failures.append(error)

    threads = [threading.Thread(target=ask) for _ in range(3)]
    for t in threads:
        t.start()
    snapshot.publish(facts, path, replace=True)
    changed = index.reload_index()
    for t in threads:
        t.join()
    assert not failures and changed["changed"] and changed["counts"]["symbols"] == 7
    assert before.facts.symbols.count() == 7  # the old version stays readable
    assert not index.reload_index()["changed"]
