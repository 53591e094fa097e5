"""Column functions against plain Python."""

import posixpath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codefacts.functions import identity, paths, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind, path, name, usr",
    [
        ("function", "", "f", "c:@F@f"),
        ("function", "a/b.c", "f", "c:a/b.c@F@f"),
        ("variable", "", "v", "c:@V@v"),
        ("variable", "a/b.c", "v", "c:a/b.c@V@v"),
    ],
)
def test_symbol_usr(spark, kind, path, name, usr):
    assert one(spark, identity.symbol_usr(F.col("k"), F.col("p"), F.col("n")), k=kind, p=path, n=name) == usr


@pytest.mark.parametrize(
    "kind, name, usr",
    [
        ("typedef", "t", "c:h.h@T@t"),
        ("struct", "s", "c:h.h@S@s"),
        ("union", "", "c:h.h@U@__anon_4_9"),
        ("enum", "", "c:h.h@E@__anon_4_9"),
    ],
)
def test_type_usr(spark, kind, name, usr):
    column = identity.type_usr(F.col("k"), F.lit("h.h"), F.col("n"), F.lit(4), F.lit(9))
    assert one(spark, column, k=kind, n=name) == usr
    assert one(spark, identity.enum_member_usr(column, F.lit("M")), k=kind, n=name) == usr + "@M"


@pytest.mark.parametrize(
    "name, base, suffix",
    [
        ("f.constprop.0", "f", ".constprop.0"),
        ("f.isra", "f", ".isra"),
        ("f.part.2.constprop.1", "f.part.2", ".constprop.1"),
        ("f.other.1", "f.other.1", ""),
        ("f", "f", ""),
    ],
)
def test_clone_names(spark, name, base, suffix):
    assert one(spark, identity.clone_base(F.col("n")), n=name) == base
    assert one(spark, identity.clone_suffix(F.col("n")), n=name) == suffix


@pytest.mark.parametrize(
    "path, rel, inside",
    [
        ("../src/a.c", "src/a.c", True),
        ("gen/x.h", "build/gen/x.h", True),
        ("/p/src/./b/../a.c", "src/a.c", True),
        ("/usr/include/stdio.h", "/usr/include/stdio.h", False),
        ("../../other/a.c", "/other/a.c", False),
        ("/project/a.c", "/project/a.c", False),
        ("", "", False),
    ],
)
def test_resolve(spark, path, rel, inside):
    found = one(spark, paths.resolve(F.col("p"), "/p/build", "/p"), p=path)
    assert (found["rel"], found["in_project"]) == (rel, inside)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "bc", "..", ".", ""]), max_size=7), min_size=1, max_size=20))
def test_clean_is_normpath(spark, samples):
    given_paths = ["/" + "/".join(s) for s in samples]
    df = spark.createDataFrame([(p,) for p in given_paths], "p string")
    got = [r["c"] for r in df.select(paths.clean(F.col("p")).alias("c")).collect()]
    assert got == [posixpath.normpath("/" + p.lstrip("/")) for p in given_paths]


@pytest.mark.parametrize(
    "pattern, path, hit",
    [
        ("/usr/include/**", "/usr/include", True),
        ("/usr/include/**", "/usr/include/a/b.h", True),
        ("/usr/include/**", "/usr/includes/a.h", False),
        ("/usr/include/*.h", "/usr/include/a.h", True),
        ("/usr/include/*.h", "/usr/include/a/b.h", False),
        ("/opt/v?/x.h", "/opt/v1/x.h", True),
        ("/opt/v[12]/x.h", "/opt/v3/x.h", False),
        ("/opt/x.h", "/opt/x.h", True),
    ],
)
def test_globs(spark, pattern, path, hit):
    assert one(spark, paths.glob_condition(F.col("p"), pattern), p=path) is hit


@pytest.mark.parametrize("pattern", ["", "  ", "include/*.h", "/a/**/b.h"])
def test_bad_globs(spark, pattern):
    with pytest.raises(ValueError):
        paths.glob_condition(F.col("p"), pattern)


def test_archive_and_directory(spark):
    assert one(spark, paths.archive_of(F.col("p")), p="lib/libx.a.p/u.c.o") == "lib/libx.a"
    assert one(spark, paths.archive_of(F.col("p")), p="app/app.p/u.c.o") == ""
    assert one(spark, paths.directory_of(F.col("p")), p="a/b/c.h") == "a/b"
    assert one(spark, paths.directory_of(F.col("p")), p="c.h") == "."


def test_tokens_fold_and_split(spark):
    got = one(spark, text.tokens(F.col("a"), F.col("b")), a="add_Ints2 été", b="int (int, Char *)")
    assert got == ["add", "ints2", "ete", "int", "char"]
    assert text.query_words("add_in*") == ["add", "in"]
    assert text.query_words("é__") == []


@pytest.mark.parametrize(
    "value, lines",
    [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\n", ["a", ""]), ("\n", [""]), ("a\nb", ["a", "b"])],
)
def test_lines(spark, value, lines):
    assert one(spark, text.lines(F.col("t")), t=value) == lines


@pytest.mark.parametrize(
    "line, context, expected",
    [(1, 1, (1, 2, "a\nb")), (4, 2, (2, 4, "b\nc\nd")), (9, 3, None), (0, 3, None), (6, 2, (4, 4, "d"))],
)
def test_line_window(spark, line, context, expected):
    got = one(spark, text.line_window(F.col("t"), F.col("n"), context), t="a\nb\nc\nd\n", n=line)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "start, end, expected",
    [(2, 3, "b\nc"), (0, 0, "a\nb\nc"), (3, 9, "c"), (3, 2, ""), (-1, 1, "a")],
)
def test_line_slice(spark, start, end, expected):
    assert one(spark, text.line_slice(F.col("t"), start, end), t="a\nb\nc\n") == expected


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="aé.\\E*b", max_size=14), min_size=1, max_size=15),
    st.text(alphabet="aé.\\E*", min_size=1, max_size=3),
)
def test_literal_columns_are_byte_accurate(spark, samples, pattern):
    def brute(line):
        data, needle, at, out = line.encode(), pattern.encode(), 0, []
        while (at := data.find(needle, at)) >= 0:
            out.append(at + 1)
            at += len(needle)
        return out

    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r["c"] for r in df.select(text.literal_columns(F.col("s"), pattern).alias("c")).collect()]
    assert got == [brute(s) for s in samples]


def test_regex_columns_count_bytes(spark):
    df = spark.createDataFrame([("été add_ints(été)",)], "s string")
    got = df.select(text.regex_matches(r"add_\w+|é\)")("s").alias("m")).first()["m"]
    assert [(m["column"], m["match_text"]) for m in got] == [(7, "add_ints"), (19, "é)")]
