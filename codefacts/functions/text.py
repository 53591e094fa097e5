"""Text helpers: search tokens, line windows and byte-accurate match columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with a diacritic and the base letter they index as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
BASE = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
# Fixed value: what separates two index tokens (the underscore separates too).
TOKEN_BREAK = r"[^\p{L}\p{N}]+"
# Fixed value: what a query word may consist of; anything else splits it.
QUERY_WORD = re.compile(r"[A-Za-z0-9]+")


#: Values that are named in a filter rather than joined.
MOST_NAMED = 100


def any_of(column: str, values: list[str]) -> Column:
    """Equalities in a balanced tree: Parquet tests each against a page's range, but of a list only the least and greatest value."""
    if len(values) <= 1:
        return F.col(column) == values[0] if values else F.lit(False)
    half = len(values) // 2
    return any_of(column, values[:half]) | any_of(column, values[half:])


def fold(text: Column) -> Column:
    """Case- and diacritic-folded text."""
    return F.translate(F.lower(text), ACCENTED, BASE)


def tokens(*columns: Column) -> Column:
    """Distinct index tokens of one or more text columns."""
    joined = F.concat_ws(" ", *columns)
    parts = F.split(fold(joined), TOKEN_BREAK)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def query_words(query: str) -> list[str]:
    """Prefixes a query asks for; empty when it holds separators only."""
    return [w.lower() for w in QUERY_WORD.findall(query)]


def like_contains(column: Column, query: str) -> Column:
    """ASCII-case-insensitive containment with no wildcard meaning in ``query``."""
    return F.contains(F.lower(column), F.lit(query.lower()))


def lines(text: Column) -> Column:
    """Lines of a text; one trailing newline does not open another line."""
    parts = F.split(text, "\n", -1)
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_window(text: Column, line: Column, context: int) -> Column:
    """Struct ``(start_line, end_line, text)`` around a 1-based line, or NULL."""
    parts = lines(text)
    total = F.size(parts)
    start = F.greatest(line - F.lit(context), F.lit(1))
    end = F.least(line + F.lit(context), total)
    length = F.greatest(end - start + 1, F.lit(0))
    body = F.array_join(F.slice(parts, start, length), "\n")
    window = F.struct(
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), body.alias("text")
    )
    return F.when((line > 0) & (total > 0) & (start <= end), window)


def line_slice(text: Column, start_line: int, end_line: int) -> Column:
    """Inclusive slice of lines; bounds clamp, an end of zero means the last line."""
    parts = lines(text)
    total = F.size(parts)
    start = F.lit(max(start_line, 1))
    end = F.when((F.lit(end_line) <= 0) | (F.lit(end_line) > total), total).otherwise(F.lit(end_line))
    length = F.greatest(end - start + 1, F.lit(0))
    return F.array_join(F.slice(parts, start, length), "\n")


def java_quote(literal: str) -> str:
    """Java regex that matches ``literal`` itself."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


#: Occurrences whose places are added up in one array; longer lists are added up part by part.
PIECES = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running_sums(values: Column) -> Column:
    return F.aggregate(
        values,
        F.array().cast("array<int>"),
        lambda seen, v: F.concat(seen, F.array(F.coalesce(F.try_element_at(seen, F.lit(-1)), F.lit(0)) + v)),
    )


def literal_columns(line: Column, pattern: str) -> Column:
    """1-based byte columns of every non-overlapping occurrence in a line.

    The k-th starts after k pieces and k - 1 patterns. Running sums copy their
    array at every step, so they are made over parts and over the parts' totals.
    """
    width = len(pattern.encode("utf-8"))

    def places(steps: Column) -> Column:
        last_part = F.greatest(F.floor((F.size(steps) - 1) / PIECES).cast("int"), F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last_part), lambda i: _running_sums(F.slice(steps, i * PIECES + 1, F.lit(PIECES))))
        return _let(parts, joined)

    def joined(parts: Column) -> Column:
        totals = _running_sums(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        before = F.concat(F.array(F.lit(0)), F.slice(totals, F.lit(1), F.size(parts) - 1))
        return F.flatten(F.zip_with(parts, before, lambda p, base: F.transform(p, lambda x: x + base - F.lit(width - 1))))

    def steps(pieces: Column) -> Column:
        ends = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.transform(ends, lambda p: F.octet_length(p).cast("int") + F.lit(width))

    return _let(F.split(line, java_quote(pattern), -1), lambda pieces: _let(steps(pieces), places))


def regex_matches(pattern: str):
    """Pandas UDF giving ``(column, text)`` for every regex match in a line.

    Columns count bytes; the dialect is Python's ``re``.
    """
    re.compile(pattern)

    @F.pandas_udf("array<struct<column:int,match_text:string>>")
    def spans(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)

        def one(value):
            if value is None:
                return None
            return [
                {"column": len(value[: m.start()].encode("utf-8")) + 1, "match_text": m.group(0)}
                for m in compiled.finditer(value)
            ]

        return values.map(one)

    return spans
