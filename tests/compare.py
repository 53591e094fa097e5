"""Run registered queries and their SQL side by side and compare the results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, bool):
        return int(value)
    return value


def rows_by_name(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in order) for r in rows)


def type_class(name: str) -> str:
    name = name.lower()
    if any(k in name for k in ("int", "long", "short")):
        return "int"
    if any(k in name for k in ("char", "string")):
        return "text"
    return name


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: type_class(str(d[1])) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    for f in df.schema.fields:
        have = type_class(f.dataType.typeName())
        if have != types[f.name] and not types[f.name] == "number":
            return f"type of {f.name}: {have} != {types[f.name]}"
    got = rows_by_name(df.columns, df.collect())
    want = rows_by_name(columns, expected)
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{sum(got.values())} rows vs {sum(want.values())}; "
            f"extra {list(extra.items())[:2]} missing {list(missing.items())[:2]}"
        )
    return None


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from codefacts.session import local_session

    spark = local_session("8")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                n = len(con.execute(oracles[name]).fetchall())
            else:
                problem, n = None, len(df.collect())
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        took = time.time() - started
        kind = "ok" if name in oracles else "rows"
        print(f"{'FAIL' if problem else kind} {name} rows={n} {took:.2f}s {problem or ''}", flush=True)
        bad += bool(problem)
    for name in set(oracles) - set(queries):
        print("oracle without query:", name)
    print("failed:", bad, "of", len(names or queries))
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
