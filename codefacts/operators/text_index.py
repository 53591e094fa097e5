"""What is derived from stored contents so that a question reads little of them.

``blob_lines`` has the byte offset of every line of a blob: a window around a
line is a substring, cut where the content lies. ``blob_trigrams`` has, for
every three bytes in a row and every block of 64 blobs, which of them hold
these bytes (one bit each), and ``blob_blocks`` the place of each blob in its
block: a literal, or what a regular expression cannot match without, chooses
the blobs to read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.facts import Facts
from codefacts.functions.text import MOST_NAMED, any_of
from codefacts.session import store

#: Blobs of a block: the bits of a long.
BLOCK = 64
#: Hex digits of a block's name, the beginning of its first hash.
NAME_DIGITS = 24
#: Hashes that are joined with contents; beyond it all contents are read.
MOST_JOINED = 200_000
#: Asked lines that are sent to every task at once; more go in several rounds, each over its own range of hashes.
MOST_LINES = 200_000
#: Alternatives that one place of a regular expression may stand for.
MOST_ALTERNATIVES = 16

MIXED = "block string, trigram int, members bigint, hash string, slot int"


# -- lines ------------------------------------------------------------------------


def blob_lines(blobs: DataFrame) -> DataFrame:
    """``(hash, line_starts, text_end)``: byte offsets of the lines, and where the text ends without a last newline."""

    def run(batches):
        for batch in batches:
            starts, ends = [], []
            for content in batch.column(1):
                data = np.frombuffer(content.as_buffer() if content.is_valid else b"", np.uint8)
                after = np.flatnonzero(data == 10).astype(np.int32) + 1
                starts.append(np.concatenate((np.zeros(1, np.int32), after[after < len(data)])) if len(data) else after)
                ends.append(len(data) - int(len(data) > 0 and data[-1] == 10))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.int32())], names=["hash", "line_starts", "text_end"]
            )

    return blobs.select("hash", "content").mapInArrow(run, "hash string, line_starts array<int>, text_end int")


def lines_of(facts: Facts) -> DataFrame:
    return facts.blob_lines if "blob_lines" in facts else blob_lines(facts.blobs)


def _spans(facts: Facts, asked: DataFrame, context: int) -> DataFrame:
    """``(blob_hash, asked)``: for each blob the windows to cut, as lines and as bytes."""
    total = F.size("line_starts")
    first, last = F.greatest(F.col("line") - context, F.lit(1)), F.least(F.col("line") + context, total)
    begin = F.element_at("line_starts", F.col("start_line"))
    end = F.when(F.col("end_line") < total, F.try_element_at("line_starts", F.col("end_line") + 1) - 1).otherwise(F.col("text_end"))
    lines = lines_of(facts).withColumnRenamed("hash", "blob_hash")
    found = asked.join(lines, "blob_hash").select("*", first.cast("int").alias("start_line"), last.cast("int").alias("end_line"))
    found = found.filter((F.col("line") > 0) & (F.col("start_line") <= F.col("end_line")))
    window = F.struct("line", "start_line", "end_line", begin.alias("begin"), (end - begin).alias("size"))
    return found.select("blob_hash", window.alias("window")).groupBy("blob_hash").agg(F.collect_list("window").alias("asked"))


def windows(facts: Facts, rows: DataFrame, context: int, most_lines: int = MOST_LINES) -> DataFrame:
    """``(blob_hash, line, snippet)`` of the distinct places in ``rows``.

    The asked places of a blob travel to its content, which is not shuffled for it:
    they are sent to every task if they are few. Where they are many, ranges of
    hashes take turns; contents are sorted by hash when stored, so each range
    reads its own part of them and of the places. Contents that are not stored
    would be derived anew for each range; they are dealt out by hash as it is,
    and many places meet them there.
    """
    asked = store(rows.select("blob_hash", F.col("line").cast("int").alias("line")).filter("blob_hash IS NOT NULL AND line > 0").distinct())
    rounds = -(-asked.count() // most_lines) or 1
    spans, out = _spans(facts, asked, context), None
    contents = facts.blobs.select(F.col("hash").alias("blob_hash"), "content")
    if rounds == 1:
        met = [contents.join(F.broadcast(spans), "blob_hash")]
    elif "blob_lines" not in facts:
        met = [contents.join(spans.hint("merge"), "blob_hash")]
    else:
        spans = store(spans.repartitionByRange("blob_hash").sortWithinPartitions("blob_hash"))
        cuts = ["", *(f"{i * 16**6 // rounds:06x}" for i in range(1, rounds)), "g"]
        ranges = [(F.col("blob_hash") >= low) & (F.col("blob_hash") < high) for low, high in zip(cuts, cuts[1:], strict=False)]
        met = [contents.filter(within).join(F.broadcast(spans.filter(within)), "blob_hash") for within in ranges]
    for part in met:
        part = part.select("blob_hash", F.transform("asked", lambda w: _cut(F.col("content"), w)).alias("cut"))
        out = part if out is None else out.unionByName(part)
    return out.select("blob_hash", F.explode("cut").alias("cut")).select("blob_hash", "cut.line", "cut.snippet")


def _cut(content: Column, window: Column) -> Column:
    text = F.substr(content, window["begin"] + 1, window["size"]).cast("string")
    snippet = F.struct(window["start_line"].alias("start_line"), window["end_line"].alias("end_line"), text.alias("text"))
    return F.struct(window["line"].alias("line"), snippet.alias("snippet"))


def with_windows(facts: Facts, rows: DataFrame, context: int) -> DataFrame:
    """``rows`` with the window around ``line`` as column ``snippet``, null where there is none."""
    found = windows(facts, rows, context).select(F.col("blob_hash").alias("_hash"), F.col("line").alias("_line"), "snippet")
    at = (F.col("blob_hash") == F.col("_hash")) & (F.col("line") == F.col("_line"))
    return rows.join(found, at, "left").drop("_hash", "_line")


# -- trigrams ---------------------------------------------------------------------


def trigrams_of(data: bytes) -> np.ndarray:
    """The distinct numbers of three bytes in a row, none of them a newline."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    if len(b) < 3:
        return np.zeros(0, np.int32)
    kept = (b[:-2] != 10) & (b[1:-1] != 10) & (b[2:] != 10)
    return np.unique(((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[kept])


def index_blobs(blobs: DataFrame) -> DataFrame:
    """Postings (trigram, members) and places (hash, slot) of blocks of blobs, in one pass over contents sorted by hash."""

    def block_rows(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        name, n = held[0][0][:NAME_DIGITS], len(held)
        every = np.concatenate([t for _, t in held])
        bits = np.repeat(np.uint64(1) << np.arange(n, dtype=np.uint64), [len(t) for _, t in held])
        order = np.argsort(every, kind="stable")
        found, first = np.unique(every[order], return_index=True)
        members = np.bitwise_or.reduceat(bits[order], first) if len(found) else np.zeros(0, np.uint64)
        k = len(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (k + n)), pa.array([*found.tolist(), *[None] * n], pa.int32()), pa.array([*members.view(np.int64).tolist(), *[None] * n], pa.int64()),
                pa.array([*[None] * k, *(h for h, _ in held)], pa.string()), pa.array([*[None] * k, *range(n)], pa.int32()),
            ],
            names=[c.split()[0] for c in MIXED.split(", ")],
        )

    def run(batches):
        held = []
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((name, trigrams_of(content.as_buffer() if content.is_valid else b"")))
                if len(held) == BLOCK:
                    yield block_rows(held)
                    held = []
        if held:
            yield block_rows(held)

    return blobs.select("hash", "content").mapInArrow(run, MIXED)


def clauses_of(pattern: str, regex: bool) -> list[list[bytes]]:
    """What every match holds: for each clause at least one of its byte strings, each of three bytes or more.

    Empty where nothing is known, as for ignored case or a pattern of wildcards.
    """
    if not regex:
        literal = pattern.encode("utf-8")
        return [[literal]] if len(trigrams_of(literal)) else []
    parsed = re._parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return []
    found: list[set[str]] = []
    _close(_required(list(parsed), {""}, found), found)
    clauses = [sorted(s.encode("utf-8") for s in clause) for clause in found if clause]
    return [c for c in clauses if all(len(trigrams_of(s)) for s in c)]


def _close(now: set[str], found: list[set[str]]) -> set[str]:
    """Ends the strings read so far: what follows need not stand beside them. Nothing known is noted as an empty clause."""
    found.append(now if all(now) else set())
    return {""}


def _class_members(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        match str(kind):
            case "LITERAL":
                out.add(chr(value))
            case "RANGE" if value[1] - value[0] < MOST_ALTERNATIVES:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            case _:
                return None
    return out


def _required(items: list, now: set[str], found: list[set[str]]) -> set[str]:
    """Strings that may end where ``items`` do, begun by ``now``; clauses met on the way go to ``found``."""
    for kind, value in items:
        match str(kind):
            case "LITERAL":
                options = {chr(value)}
            case "IN":
                options = _class_members(value)
            case "AT":
                continue
            case "SUBPATTERN" if not value[1] and not value[2]:
                now = _required(list(value[3]), now, found)
                continue
            case "MAX_REPEAT" | "MIN_REPEAT" | "POSSESSIVE_REPEAT" if value[0] >= 1:
                now = _required(list(value[2]), now, found)
                if value[1] > 1:
                    now = _close(now, found)
                continue
            case "BRANCH":
                branches = []
                for branch in value[1]:
                    inner: list[set[str]] = []
                    ends = _required(list(branch), {""}, inner)
                    branches.append((inner, ends))
                if all(not inner for inner, _ in branches):
                    options = set().union(*(ends for _, ends in branches))
                else:
                    # one clause of each branch: every match holds one of them
                    now = _close(now, found)
                    chosen = [max([*inner, ends], key=lambda c: min(map(len, c), default=0)) for inner, ends in branches]
                    known = all(c and all(c) for c in chosen)
                    _close(set().union(*chosen) if known else {""}, found)
                    continue
            case _:
                options = None
        if options is None or len(now) * len(options) > MOST_ALTERNATIVES:
            now = _close(now, found)
            if options is None or len(options) > MOST_ALTERNATIVES:
                continue
        now = {a + b for a in now for b in options}
    return now


def candidates(facts: Facts, clauses: Iterable[list[bytes]]) -> DataFrame:
    """``(hash)`` of the blobs whose trigrams allow every clause."""
    wanted = [
        (c, a, int(t), len(numbers))
        for c, clause in enumerate(clauses)
        for a, text in enumerate(clause)
        for numbers in [trigrams_of(text)]
        for t in numbers
    ]
    n_clauses = 1 + max(c for c, *_ in wanted)
    asked = facts.spark.createDataFrame(wanted, "clause int, alternative int, trigram int, n int")
    # as many values as the pattern has letters: they reach the scan of the sorted postings
    postings = facts.blob_trigrams.filter(F.col("trigram").isin(sorted({t for _, _, t, _ in wanted})))
    met = postings.join(F.broadcast(asked), "trigram").groupBy("block", "clause", "alternative")
    met = met.agg(F.bit_and("members").alias("members"), F.count("*").alias("found"), F.first("n").alias("n")).filter("found = n")
    met = met.groupBy("block", "clause").agg(F.bit_or("members").alias("members"))
    met = met.groupBy("block").agg(F.bit_and("members").alias("members"), F.count("*").alias("found")).filter((F.col("found") == n_clauses) & (F.col("members") != 0))
    places = facts.blob_blocks.join(met.select("block", "members"), "block")
    return places.filter(F.getbit("members", F.col("slot")) == 1).select("hash")


def chosen_contents(facts: Facts, pattern: str, regex: bool, wanted: DataFrame | None) -> DataFrame:
    """``(hash, content)`` of the blobs that may hold a match, of those in ``wanted`` (blob_hash) if it is given.

    A few hashes are named in the filter of the scan; some more meet the
    contents in a join that moves no content; where most of a large index is
    wanted anyway, all contents are read and nothing is looked up.
    """
    clauses = clauses_of(pattern, regex) if {"blob_trigrams", "blob_blocks"} <= set(facts.names) else []
    contents = facts.blobs.select("hash", "content")
    chosen = candidates(facts, clauses) if clauses else None
    if wanted is not None:
        own = wanted.select(F.col("blob_hash").alias("hash")).distinct()
        chosen = own if chosen is None else chosen.join(own, "hash", "left_semi")
    if chosen is None:
        return contents
    named = [r["hash"] for r in chosen.limit(MOST_NAMED + 1).collect()]
    if len(named) <= MOST_NAMED:
        return contents.filter(any_of("hash", sorted(named)))
    if chosen.limit(MOST_JOINED + 1).count() <= MOST_JOINED:
        return contents.join(F.broadcast(chosen), "hash", "left_semi")
    return contents
