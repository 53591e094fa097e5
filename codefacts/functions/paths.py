"""Path arithmetic on columns.

Paths are cleaned with array expressions so the work stays in the JVM: split
on ``/``, drop empty and ``.`` segments, and let every ``..`` remove the
segment before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_segments(segments: Column) -> Column:
    empty = F.array().cast("array<string>")

    # try_element_at yields NULL on an empty prefix, so a leading .. is kept.
    def step(done: Column, segment: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        pop = (segment == "..") & last.isNotNull() & (last != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(segment.isin("", "."), done)
            .when(pop, popped)
            .otherwise(F.concat(done, F.array(segment)))
        )

    return F.aggregate(segments, empty, step)


def clean(path: Column) -> Column:
    """Lexically shortest equivalent of an absolute path."""
    folded = _fold_segments(F.split(path, "/"))
    # Parents of the root are the root itself.
    kept = F.filter(folded, lambda s: s != "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def absolute(path: Column, build_dir: str) -> Column:
    joined = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(build_dir.rstrip("/") + "/"), path)
    )
    return clean(joined)


def is_under(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def resolve(path: Column, build_dir: str, project_root: str) -> Column:
    """Struct ``(rel, in_project)`` for a path taken from a dump.

    Relative paths are relative to the build directory. A path outside the
    project keeps its absolute form.
    """
    root = project_root.rstrip("/")
    full = absolute(path, build_dir)
    inside = is_under(full, root) | (full == root)
    rel = F.when(full == root, F.lit(".")).otherwise(F.substring(full, len(root) + 2, 1 << 30))
    missing = path.isNull() | (path == "")
    return F.struct(
        F.when(missing, F.lit("")).when(inside, rel).otherwise(full).alias("rel"),
        (~missing & inside).alias("in_project"),
    )


def project_relative(path: Column, build_dir: str, project_root: str) -> Column:
    return resolve(path, build_dir, project_root)["rel"]


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; unchanged when it is not below it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def local_path(uri: Column) -> Column:
    """File path of a ``file:`` URI as Spark's file sources report it."""
    return F.url_decode(F.regexp_replace(F.replace(uri, F.lit("+"), F.lit("%2B")), r"^file:/+", "/"))


def plain_path(uri: Column) -> Column:
    """File path of a ``file:`` URI whose characters are not encoded, as in ``binaryFile``'s path column."""
    return F.regexp_replace(uri, r"^file:/+", "/")


def directory_of(path: Column) -> Column:
    """Everything before the last slash, ``.`` for a file at the root."""
    head = F.regexp_extract(path, r"^(.+)/[^/]*$", 1)
    return F.when(head == "", F.lit(".")).otherwise(head)


def archive_of(object_path: Column) -> Column:
    """Archive an object was bundled into, by the ``<name>.a.p/`` directory rule."""
    at = F.instr(object_path, ".a.p/")
    return F.when(at > 0, F.substring(object_path, F.lit(1), at + 1)).otherwise(F.lit(""))


def glob_condition(path: Column, pattern: str) -> Column:
    """Match an absolute path against one include pattern.

    ``/dir/**`` takes the directory and everything below it; any other pattern
    is a shell glob whose wildcards do not cross ``/``.
    """
    text = pattern.strip()
    if not text:
        raise ValueError("empty include pattern")
    if not text.startswith("/"):
        raise ValueError(f"include pattern must be an absolute path: {pattern!r}")
    if text.endswith("/**"):
        prefix = text[: -len("/**")]
        return (path == prefix) | path.startswith(prefix + "/")
    if "**" in text:
        raise ValueError(f"'**' is only supported as a trailing /**: {pattern!r}")
    return path.rlike(glob_to_regex(pattern))


def glob_to_regex(pattern: str) -> str:
    """Java regex for a single-segment shell glob."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out.append("[" + pattern[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + "$"
