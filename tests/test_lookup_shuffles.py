"""What crosses the shuffles of symbol resolution: rows without spelled identities, pairs and titles derived once."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codefacts.operators import debug_ingest, symbol_ingest
from codefacts.plans.ingest_queries import Compiled
from codefacts.seed import Seed
from codefacts.seed_dumps import Dumps


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lookup_prefers_the_external_identity_and_spells_none_below_its_joins(spark):
    seen = spark.createDataFrame(
        [
            ("o1", "add", "a.c"), ("o1", "add", "a.c"), ("o2", "own", "a.c"), ("o2", "own", "b.c"), ("o3", "own", None),
            ("o3", "own", ""), ("o4", "", "a.c"), ("o4", None, "a.c"), ("o5", "gone", "a.c"), (None, "F@x", "a@F@"),
        ],
        "object string, name string, source string",
    )
    known = ["c:@F@add", "c:a.c@F@add", "c:a.c@F@own", "c:a.c@F@own", "c:@F@", "c:a@F@@F@F@x", None]
    symbols = spark.createDataFrame([(u,) for u in known], "usr string")
    found = debug_ingest.lookup_symbols(seen, symbols, "name", "usr")
    assert found.columns == ["object", "name", "source", "usr"]
    want = [
        ("o1", "add", "a.c", "c:@F@add"), ("o1", "add", "a.c", "c:@F@add"), ("o2", "own", "a.c", "c:a.c@F@own"),
        ("o2", "own", "b.c", None), ("o3", "own", None, None), ("o3", "own", "", None), ("o4", "", "a.c", None),
        ("o4", None, "a.c", None), ("o5", "gone", "a.c", None), (None, "F@x", "a@F@", "c:a@F@@F@F@x"),
    ]
    assert rows(found) == sorted(want, key=str)
    kept = seen.repartition(2).withColumn("part", F.spark_partition_id())
    plan = plan_of(debug_ingest.lookup_symbols(kept, symbols, "name", "usr")).split("\n")
    below = [line for line in plan[1:] if "concat(" in line and not line.lstrip(" :+-").startswith("Join")]
    assert below == []


def test_observation_sends_linkage_instead_of_visibility(spark):
    nodes = spark.createDataFrame(
        [
            ("o", "1", "f", "f_link", "function", True, False, ["public", "weak"], True, ""),
            ("o", "2", "", "g_link", "", True, True, [], False, ""),
            ("p", "1", None, "h_link", None, False, False, None, None, ""),
            ("o", "3", "f.part.0", "f.part.0", "function", True, False, [], False, "1"),
        ],
        "object string, local_id string, name string, linkage_name string, kind string, analyzed boolean, body_removed boolean, "
        "visibility array<string>, address_taken boolean, clone_of string",
    )
    sites = spark.createDataFrame([("o", "f", "h.h", 7), ("o", "g_link", "", 9)], "object string, name string, decl_file string, decl_line int")
    units = spark.createDataFrame([("o", "a.c")], "object string, source string")
    seen = symbol_ingest.observe(nodes, sites, units)
    assert rows(seen, "object", "local_id", "usr", "name", "linkage", "plain_name", "has_body", "file", "line", "is_weak") == [
        ("o", "1", "c:@F@f", "f", "weak", "f", True, "h.h", 7, True),
        ("o", "2", "c:a.c@F@g_link", "g_link", "internal", "", False, "a.c", 9, False),
        ("p", "1", "c:@F@h_link", "h_link", "internal", None, False, "", 0, None),
    ]
    plan = plan_of(seen).split("\n")
    last_join = max(i for i, line in enumerate(plan) if "Join " in line)
    assert not any("visibility" in line for line in plan[: last_join + 1])


@pytest.fixture()
def seed(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (18, 2), (None, 2), (3, None), (16, 9)], "l_orderkey long, l_partkey long")
    parts = [(1, "red bolt", "Brand#1", "SMALL", 8), (2, "big gear", "Brand#2", "LARGE", 3)]
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
    spark.createDataFrame(parts, schema).write.parquet(f"{tmp_path}/part.parquet")
    return Seed(spark, str(tmp_path))


def test_pairs_of_units_and_symbols_are_told_apart_once(seed):
    pairs = Dumps(seed).unit_parts()
    assert rows(pairs, "unit", "pk", "name") == [(1, 1, "red_bolt_1"), (1, 2, "big_gear_2"), (2, 1, "red_bolt_1"), (None, 2, "big_gear_2")]
    assert "Aggregate" not in plan_of(pairs)


def test_titles_are_stored_before_rows_meet_them(seed):
    c = Compiled(seed)
    assert rows(c.units) == [
        ("obj/u_1.c.o", "src/unit_1.c"), ("obj/u_16.c.o", "/ext/unit_16.c"), ("obj/u_2.c.o", "src/unit_2.c"), ("obj/u_3.c.o", "src/unit_3.c"), (None, ""),
    ]
    assert "Aggregate" not in plan_of(c.units) and "Aggregate" not in plan_of(c.sources)
