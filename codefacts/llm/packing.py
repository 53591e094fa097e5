"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

Best fit looks at lengths only, and there are at most ``capacity`` different
ones. So the corpus is reduced to a histogram of piece lengths; best-fit
decreasing runs on it with a segment tree over remaining capacities, taking
equal pieces together. That gives the very packing that placing the pieces one
by one would give, whatever their number. The plan, a few thousand runs of
slots, is then joined back to the pieces by their rank among pieces of the same
length, which Spark counts in two levels.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import Scratch, require
from codefacts.llm.tokens import default_vocabulary, encoder

CAPACITY = 1024
#: Closes every document; fixed value of the packing contract.
CLOSING_ID = 2


class CapacityTree:
    """Segment tree over remaining capacities 0..top, each leaf the number of open bins that have it."""

    def __init__(self, top: int):
        self.size = 1
        while self.size <= top:
            self.size *= 2
        self.open = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, bins: int) -> None:
        at = self.size + capacity
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` with an open bin, in logarithmic time."""
        at = self.size + length
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


@dataclass(frozen=True)
class Slots:
    """Pieces of ``length`` with ranks from ``first_rank``: ``each`` per bin, in bins from ``first_bin`` on, at ``offset``."""

    length: int
    first_rank: int
    n_pieces: int
    first_bin: int
    each: int
    offset: int


def best_fit_decreasing(histogram: Mapping[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Where best-fit decreasing puts the pieces of each length; ties between bins go to those opened or filled last.

    A bin that took a piece is the tightest for the next equal one as long as
    it fits, so a bin takes as many as it can before the next bin is looked at.
    """
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    tree, groups, bins, plan = CapacityTree(capacity), {}, 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            each = (capacity if room is None else room) // length
            wanted = max(1, left // each)
            if room is None:
                room, first, count = capacity, bins, wanted
                bins += count
            else:
                first, held = groups[room].pop()
                count = min(held, wanted)
                if held > count:
                    groups[room].append((first + count, held - count))
                tree.add(room, -count)
            each = min(each, left)
            plan.append(Slots(length, rank, each * count, first, each, capacity - room))
            rank, left = rank + each * count, left - each * count
            rest = room - each * length
            groups.setdefault(rest, []).append((first, count))
            tree.add(rest, count)
    return plan


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at its end, the shorter one first."""
    first = size % capacity
    starts = ([0] if first else []) + list(range(first, size, capacity))
    return [(s, (first if s == 0 and first else capacity)) for s in starts]


@dataclass(frozen=True)
class Packing:
    """``pieces``: doc_key, piece, start, length, sequence_id, offset. ``tokens``: doc_key, piece, ids (uint32, little-endian)."""

    pieces: DataFrame
    tokens: DataFrame

    def placed_tokens(self) -> DataFrame:
        """One row per piece with its ids; grouped by sequence and ordered by offset they are the packed sequences."""
        return self.pieces.join(self.tokens.select("row", "piece", "ids"), ["row", "piece"])


def tokenised_pieces(docs: DataFrame, text: str, key: str, capacity: int, vocabulary: str, closing_id: int) -> DataFrame:
    """Pieces of every document with their ids and, within a task, their rank among pieces of the same length."""
    schema = "row string, doc_key bigint, piece int, start bigint, length int, part bigint, part_rank bigint, ids binary"

    def run(batches):
        from pyspark import TaskContext

        encode, seen = encoder(vocabulary).ids, np.zeros(capacity + 1, np.int64)
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            columns = [[] for _ in range(8)]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(body), np.uint32(closing_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    found = (f"{part}-{number}", doc, piece, start, length, part, seen[length], ids[start : start + length].tobytes())
                    seen[length] += 1
                    for column, value in zip(columns, found, strict=True):
                        column.append(value)
                number += 1
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["row", "doc_key", "piece", "start", "length", "part", "part_rank", "ids"],
            )

    return docs.select(F.col(key).cast("bigint").alias("doc_key"), F.col(text)).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
    closing_id: int = CLOSING_ID,
) -> Packing:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Ids are those of the text followed by ``closing_id``; null text counts as
    empty and gives a piece of one token. Longer documents are cut, the first
    piece being the shorter one. Rows with equal or null keys are packed each
    on its own. An empty table gives no sequences.
    """
    require(docs, key, text)
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.store(tokenised_pieces(docs, text, key, capacity, vocabulary or default_vocabulary(), closing_id), "tokens")
    counts = scratch.store(tokens.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows come to the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit_decreasing(histogram, capacity)
    slots = docs.sparkSession.createDataFrame(
        [(s.length, s.first_rank, s.first_rank + s.n_pieces, s.first_bin, s.each, s.offset) for s in plan],
        "slot_length int, first_rank bigint, end_rank bigint, first_bin bigint, each int, slot_offset int",
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = tokens.drop("ids").join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("part_rank"))
    # A plan has at most a few runs per length, so its size is bounded by the capacity, not by the corpus.
    within = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    step = F.col("rank") - F.col("first_rank")
    pieces = ranked.join(F.broadcast(slots), within).select(
        "row", "doc_key", "piece", "start", F.col("length").cast("bigint").alias("length"),
        (F.col("first_bin") + F.floor(step / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("slot_offset") + (step % F.col("each")) * F.col("length")).cast("bigint").alias("offset"),
    )
    return Packing(pieces, tokens)
