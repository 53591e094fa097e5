"""Reading, listing, checking and searching the stored sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions import paths, text
from codefacts.operators import common, text_index

# File extensions by kind, compared in lower case.
SOURCE_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".c++", ".m", ".mm")
HEADER_EXTENSIONS = (".h", ".hh", ".hpp", ".hxx", ".h++", ".inc")


def kind_condition(kind: str | None, path: Column, is_generated: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    match (kind or "").lower():
        case "generated":
            return is_generated
        case "source":
            return extension.isin(*SOURCE_EXTENSIONS)
        case "header":
            return extension.isin(*HEADER_EXTENSIONS)
        case _:
            return F.lit(True)


def files(
    facts: Facts,
    target: str | Column | None = None,
    path_prefix: str = "",
    kind: str | None = None,
    include_external: bool = False,
) -> DataFrame:
    """``(table_ord, path, blob_hash, is_generated)`` of the indexed files.

    Only project sources belong to targets, so a target filter leaves the
    other tables out.
    """
    rows = facts.sources.select(F.lit(0).alias("table_ord"), "path", "blob_hash", "is_generated")
    if target is not None:
        own = (
            facts.target_sources.filter(F.col("target") == common.value(target))
            .select(F.col("file").alias("path"))
            .distinct()
        )
        rows = rows.join(own, "path", "left_semi")
    else:
        rows = rows.unionByName(
            facts.generated_sources.select(
                F.lit(1).alias("table_ord"),
                F.col("builddir_rel").alias("path"),
                "blob_hash",
                F.lit(True).alias("is_generated"),
            )
        )
        if include_external:
            rows = rows.unionByName(
                facts.external_sources.select(
                    F.lit(2).alias("table_ord"),
                    F.col("abs_path").alias("path"),
                    "blob_hash",
                    F.lit(False).alias("is_generated"),
                )
            )
    if path_prefix:
        rows = rows.filter(F.col("path").startswith(path_prefix))
    return rows.filter(kind_condition(kind, F.col("path"), F.col("is_generated")))


def list_source_files(facts: Facts, **filters) -> DataFrame:
    """Order by ``(table_ord, path)``."""
    sizes = facts.blobs.select(F.col("hash").alias("blob_hash"), "size")
    return (
        files(facts, **filters)
        .join(sizes, "blob_hash", "left")
        .withColumn("size", F.coalesce("size", F.lit(0)))
    )


def file_targets(facts: Facts, **filters) -> DataFrame:
    """``(path, target)`` membership of the listed project files."""
    listed = files(facts, **filters).filter(F.col("table_ord") == 0).select("path")
    members = facts.target_sources.select(F.col("file").alias("path"), "target")
    return members.join(listed, "path", "left_semi")


def locate(facts: Facts, path: str | Column) -> DataFrame:
    """The one stored file a path means: external when absolute, else source, else generated."""
    p = common.value(path)
    hits = (
        facts.external_sources.filter((F.col("abs_path") == p) & p.startswith("/"))
        .select(F.lit(0).alias("rank"), F.col("abs_path").alias("path"), "blob_hash")
        .unionByName(
            facts.sources.filter((F.col("path") == p) & ~p.startswith("/")).select(
                F.lit(1).alias("rank"), "path", "blob_hash"
            )
        )
        .unionByName(
            facts.generated_sources.filter((F.col("builddir_rel") == p) & ~p.startswith("/")).select(
                F.lit(2).alias("rank"), F.col("builddir_rel").alias("path"), "blob_hash"
            )
        )
    )
    return hits.orderBy("rank").limit(1).drop("rank")


def read_source(facts: Facts, path: str | Column, start_line: int = 0, end_line: int = 0) -> DataFrame:
    return slice_files(facts, locate(facts, path), start_line, end_line)


def read_stored(facts: Facts, path: str, blob_hash: str, start_line: int = 0, end_line: int = 0) -> DataFrame:
    """One stored file by its hash, a filter the content scan can skip by."""
    body = F.col("content").cast("string")
    return facts.blobs.filter(F.col("hash") == blob_hash).select(
        F.lit(path).alias("path"),
        F.col("hash").alias("blob_hash"),
        F.size(text.lines(body)).alias("line_count"),
        text.line_slice(body, start_line, end_line).alias("content"),
    )


def slice_files(facts: Facts, located: DataFrame, start_line: int = 0, end_line: int = 0) -> DataFrame:
    """Content slice and total line count of any set of ``(path, blob_hash)`` rows."""
    contents = facts.blobs.select(F.col("hash").alias("blob_hash"), "content")
    body = F.col("content").cast("string")
    return located.join(contents, "blob_hash").select(
        "path",
        "blob_hash",
        F.size(text.lines(body)).alias("line_count"),
        text.line_slice(body, start_line, end_line).alias("content"),
    )


def verify_source(facts: Facts, path: str | Column, expected_hash: str | Column) -> DataFrame:
    expected = common.value(expected_hash)
    return facts.sources.filter(F.col("path") == common.value(path)).select(
        "path",
        F.col("blob_hash").alias("indexed_hash"),
        (F.lower("blob_hash") == F.lower(expected)).alias("matches"),
        F.lit("expected_hash").alias("comparison_source"),
    )


def live_hashes(live: DataFrame) -> DataFrame:
    """``(path, live_hash)`` of ``(path, content)`` rows read from the working tree."""
    return live.select("path", F.sha2(F.col("content"), 256).alias("live_hash"))


def verify_live(facts: Facts, path: str | Column, live: DataFrame) -> DataFrame:
    p = common.value(path)
    return (
        facts.sources.filter(F.col("path") == p)
        .join(live_hashes(live.filter(F.col("path") == p)), "path", "left")
        .select(
            "path",
            F.col("blob_hash").alias("indexed_hash"),
            F.coalesce(F.col("live_hash") == F.col("blob_hash"), F.lit(False)).alias("matches"),
            F.col("live_hash").isNull().alias("live_missing"),
            F.lit("live_file").alias("comparison_source"),
        )
    )


def list_source_drift(
    facts: Facts, live: DataFrame, target: str | Column | None = None, path_prefix: str = ""
) -> DataFrame:
    """Indexed files whose live content differs or is gone. Only hashes are shuffled."""
    rows = files(facts, target, path_prefix).filter(F.col("table_ord") == 0)
    return (
        rows.join(live_hashes(live), "path", "left")
        .filter(F.col("live_hash").isNull() | (F.col("live_hash") != F.col("blob_hash")))
        .select(
            "path",
            F.col("blob_hash").alias("indexed_hash"),
            F.coalesce("live_hash", F.lit("")).alias("live_hash"),
            F.col("live_hash").isNull().alias("live_missing"),
        )
    )


def _line_matches(body: Column, pattern: str, regex: bool) -> Column:
    """Matches of one line as an array of ``(column, match_text)``."""
    if regex:
        return text.regex_matches(pattern)(body)
    columns = text.literal_columns(body, pattern)
    return F.transform(
        columns, lambda c: F.struct(c.alias("column"), F.lit(pattern).alias("match_text"))
    )


def blob_matches(facts: Facts, pattern: str, regex: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """``(blob_hash, line, column, match_text)`` over each distinct content once, of those in ``wanted`` if given.

    Copies of a file share one blob, so the text is searched per blob, where it
    is read, and only the matches are joined to the paths that carry it: no
    content is ever shuffled. Where trigrams are stored they choose the blobs.
    """
    if not pattern:
        raise ValueError("search pattern is empty")
    contents = text_index.chosen_contents(facts, pattern, regex, wanted).select(
        F.col("hash").alias("blob_hash"), F.col("content").cast("string").alias("body")
    )
    if not regex:
        contents = contents.filter(F.contains("body", F.lit(pattern)))
    numbered = contents.select(
        "blob_hash", F.posexplode(text.lines(F.col("body"))).alias("index", "row")
    )
    if not regex:
        numbered = numbered.filter(F.contains("row", F.lit(pattern)))
    return numbered.select(
        "blob_hash",
        (F.col("index") + 1).alias("line"),
        F.explode(_line_matches(F.col("row"), pattern, regex)).alias("hit"),
    ).select("blob_hash", "line", "hit.column", "hit.match_text")


def file_matches(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The matches of ``blob_matches`` in each of the files ``wanted``."""
    return wanted.join(found, "blob_hash").select(
        "table_ord", "path", "line", "column", "match_text", "blob_hash"
    )


def file_counts(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(path, n)``: matches are counted per blob before they meet the paths."""
    per_blob = found.groupBy("blob_hash").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(per_blob, "blob_hash").groupBy("path").agg(F.sum("n").alias("n"))


def search_matches(
    facts: Facts, pattern: str, regex: bool = False, context: int = 0, **filters
) -> DataFrame:
    """Every match; order by ``(table_ord, path, line, column)`` for a page."""
    rows = file_matches(blob_matches(facts, pattern, regex), files(facts, **filters))
    return with_context(facts, rows, context) if context > 0 else rows


def with_context(facts: Facts, rows: DataFrame, context: int) -> DataFrame:
    """Add the line window around each row."""
    return text_index.with_windows(facts, rows, context)


def search_by_file(facts: Facts, pattern: str, regex: bool = False, **filters) -> DataFrame:
    return file_counts(blob_matches(facts, pattern, regex), files(facts, **filters))


def search_by_directory(by_file: DataFrame) -> DataFrame:
    return by_file.groupBy(paths.directory_of(F.col("path")).alias("directory")).agg(
        F.sum("n").alias("n")
    )


def top_counts(counts: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    ordered = counts.orderBy(F.desc("n"), key)
    return ordered if limit is None else ordered.limit(limit)


def search_summary(by_file: DataFrame, scanned: DataFrame) -> DataFrame:
    """Exact totals, whatever page of matches is shown."""
    return by_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("files_with_matches"),
        scanned.agg(F.count(F.lit(1))).scalar().alias("files_scanned"),
    )
