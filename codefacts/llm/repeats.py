"""Suffix-array deduplication: every byte that a long repeated string covers is removed.

A string of ``window`` bytes that also starts elsewhere is a repeat. Sorting
all suffixes would move every text hundreds of times over, so only suffixes at
anchors are sorted. An anchor is the place of the smallest gram of a window,
hence chosen by content: equal windows have it at the same place.

1.  Grams of anchors are counted. A window that holds a gram met only once
    cannot be repeated; consecutive windows of one anchor that are left form a
    segment.
2.  A task sorts its segments by what follows the anchor, then by what stands
    before it, and keeps equal ones once: a front-coded run.
3.  Splitters sampled from the runs cut all runs into ranges. A range's runs
    are merged by a loser tree that never compares a known prefix again.
    Segments met more than once are repeats as a whole.
4.  What windows of the other segments share stands within the range, since
    segments of one anchor are neighbours in the order and a range ends between
    anchors. Only an anchor that fills more than a range is divided. Strings
    that begin alike are neighbours in the order, so a window can be met beyond
    the range's end only if the end itself begins with what the window holds
    from the anchor on. Such windows are settled in a further step by one row
    per different window and range; which ones, the merged prefixes tell.
5.  Repeats go back to the places where the segments were met, and the texts
    lose the bytes that they cover.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, bounded_sample, require
from codefacts.llm.shingles import _powers, mix, to_signed
from codefacts.llm.suffix_runs import Suffix, common_prefix, decode, encode, merged

#: Length of a repeat, in bytes.
WINDOW = 400

#: Bytes of a gram, whose hash ranks the places of an anchor.
GRAM = 32
#: Grams of a stretch that has an anchor of its own, for ruling out.
NEAR = 64
#: Bits of the filter of repeated grams. It never misses one; those that it lets through by chance cost work, not correctness.
FILTER_BITS = 26
#: Grams and bytes of segments that a task gathers before it sends or sorts them.
GATHERED_GRAMS, GATHERED_BYTES = 1 << 20, 12 << 20
#: Bytes of text of a block, the part of a run that travels as one value.
BLOCK_BYTES = 1 << 20
#: Splitters are sampled from at most so many strings.
SAMPLED = 4000
PLACE = np.uint64((1 << 26) - 1)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

Segment = tuple[int, int, int]  # first and last window, place of the anchor

_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(77)) * np.uint64(0x9E3779B97F4A7C15))


def gram_numbers(data: np.ndarray) -> np.ndarray:
    """A 64-bit number for the gram that starts at each byte."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=running[1:])
    return mix((running[GRAM:] - running[:n]) * inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` consecutive values, for each place where they begin."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, values.dtype)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, NONE)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(numbers: np.ndarray, width: int, most: int = int(PLACE) + 1) -> np.ndarray:
    """The place of the leftmost smallest gram of each ``width`` grams in a row.

    The low bits of a number give way to its place, so that a minimum names it.
    Texts of more grams than these bits count are worked off in overlapping pieces.
    """
    out, step = [np.zeros(0, np.int64)], most - width + 1
    for at in range(0, len(numbers) - width + 1, step):
        piece = numbers[at : at + most]
        placed = (piece & ~PLACE) | np.arange(len(piece), dtype=np.uint64)
        out.append((sliding_min(placed, width) & PLACE).astype(np.int64) + at)
    return np.concatenate(out)


def stretch_anchors(numbers: np.ndarray) -> np.ndarray:
    """The place of the anchor of every short stretch of grams; those of windows are among them."""
    return anchors(numbers, NEAR)


def near_anchors(numbers: np.ndarray) -> np.ndarray:
    return np.unique(stretch_anchors(numbers))


def segments_of(data: np.ndarray, window: int, repeated) -> list[Segment]:
    """Runs of windows of one anchor that hold no short stretch whose anchor's gram was met only once.

    ``repeated`` tells of numbers whether they may repeat. A copy of a window
    has the same stretches, so the anchor of each would have been met again;
    a stretch that reaches over the window's edge says nothing about it.
    """
    n = len(data) - window + 1
    if n <= 0:
        return []
    numbers = gram_numbers(data)
    places = stretch_anchors(numbers)
    turns = np.concatenate(([0], np.flatnonzero(np.diff(places)) + 1, [len(places)]))
    single = ~repeated(numbers[places[turns[:-1]]])
    first, last = turns[:-1][single], turns[1:][single] - 1  # the stretches of a gram met once
    ruled = np.zeros(n + 1, np.int64)
    np.add.at(ruled, np.clip(first + NEAR + GRAM - 1 - window, 0, n), 1)
    np.add.at(ruled, np.clip(last + 1, 0, n), -1)
    left = np.flatnonzero(np.cumsum(ruled[:-1]) == 0)
    if not len(left):
        return []
    anchor = anchors(numbers, window - GRAM + 1)
    ends = np.flatnonzero((np.diff(left) != 1) | (np.diff(anchor[left]) != 0))
    first, last = left[np.concatenate(([0], ends + 1))], left[np.concatenate((ends, [len(left) - 1]))]
    return list(zip(first.tolist(), last.tolist(), anchor[first].tolist(), strict=True))


def _power_of_two(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def _repeated_grams(slim: DataFrame, window: int, parts: int) -> np.ndarray:
    """A bit per range of gram numbers: whether one of them was met twice. A fixed number of bytes comes to the driver."""
    parts = min(_power_of_two(parts), 1 << 12)
    shift = np.uint64(64 - FILTER_BITS)

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        numbers, counts = np.unique(np.concatenate(held), return_counts=True)
        numbers = np.sort(np.concatenate((numbers, numbers[counts > 1])))  # twice is all that matters
        part = (numbers >> np.uint64(32)).astype(np.int64) * parts >> 32
        cuts = np.flatnonzero(np.diff(part)) + 1
        blobs = [p.tobytes() for p in np.split(numbers, cuts)]
        return pa.RecordBatch.from_arrays([pa.array(part[np.concatenate(([0], cuts))].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "grams"])

    def gather(batches):
        held, n = [], 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                data = np.frombuffer((body or "").encode(), np.uint8)
                if len(data) < window:
                    continue
                numbers = gram_numbers(data)
                held.append(numbers[near_anchors(numbers)])
                n += len(held[-1])
                if n >= GATHERED_GRAMS:
                    yield sent(held)
                    held, n = [], 0
        if held:
            yield sent(held)

    def marked(batches):
        by_part: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_part.setdefault(part, []).append(np.frombuffer(blob, np.uint64))
        for part, blobs in by_part.items():
            numbers = np.sort(np.concatenate(blobs))
            slots = np.unique(numbers[1:][numbers[1:] == numbers[:-1]] >> shift).astype(np.int64)
            per = (1 << FILTER_BITS) // parts
            bits = np.zeros(per, np.uint8)
            bits[slots - part * per] = 1
            if len(slots):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    packed = slim.select("body").mapInArrow(gather, "part int, grams binary").repartitionById(parts, F.col("part"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    per = len(out) // parts
    for row in packed.mapInArrow(marked, "part int, bits binary").toLocalIterator():
        out[row["part"] * per : (row["part"] + 1) * per] = np.frombuffer(row["bits"], np.uint8)
    return out


def _digest(text: bytes, before: int) -> tuple[int, int]:
    both = np.frombuffer(blake2b(text, digest_size=16, salt=before.to_bytes(4, "little")).digest(), np.int64)
    return int(both[0]), int(both[1])


def _runs(slim: DataFrame, bits: np.ndarray, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sorted runs (run, blob), and where each segment was met (doc_key, mark, h1, h2, first)."""
    shift = np.uint64(64 - FILTER_BITS)

    def repeated(numbers: np.ndarray) -> np.ndarray:
        slots = (numbers >> shift).astype(np.int64)
        return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1 > 0

    def batch_of(kind: list, doc: list, mark: list, h1: list, h2: list, first: list, blob: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip((kind, doc, mark, h1, h2, first, blob), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc_key", "mark", "h1", "h2", "first", "blob"])

    def run_of(found: dict) -> Iterator[pa.RecordBatch]:
        """A run in blocks, each a range of the order that can be read by itself."""
        order, block, size = sorted(found), [], 0
        for text, before in order:
            block.append(Suffix(text, before, *found[text, before]))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield batch_of([1], [None], [None], [None], [None], [None], [encode(block)])
                block, size = [], 0
        if block:
            yield batch_of([1], [None], [None], [None], [None], [None], [encode(block)])

    def build(batches) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, int], list[int]] = {}
        held = 0
        for batch in batches:
            docs, marks, firsts, ones, twos = [], [], [], [], []
            for doc, mark, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (body or "").encode()
                for first, last, anchor in segments_of(np.frombuffer(raw, np.uint8), window, repeated):
                    key = (raw[anchor : last + window] + raw[first:anchor], anchor - first)
                    entry = found.get(key)
                    if entry is None:
                        entry = found[key] = [0, *_digest(*key)]
                        held += len(key[0]) + 100
                    entry[0] = min(entry[0] + 1, 2)
                    docs.append(doc)
                    marks.append(mark)
                    firsts.append(first)
                    ones.append(entry[1])
                    twos.append(entry[2])
            if docs:
                yield batch_of([0] * len(docs), docs, marks, ones, twos, firsts, [None] * len(docs))
            if held >= GATHERED_BYTES:
                yield from run_of(found)
                found, held = {}, 0
        if found:
            yield from run_of(found)

    schema = "kind int, doc_key bigint, mark bigint, h1 bigint, h2 bigint, first bigint, blob binary"
    both = scratch.store(slim.select("doc_key", "mark", "body").mapInArrow(build, schema), "runs")
    return both.filter("kind = 1").select("blob"), both.filter("kind = 0").select("doc_key", "mark", "h1", "h2", "first")


def _splitters(runs: DataFrame, parts: int) -> list[bytes]:
    """Strings that cut the sorted order into ranges of nearly equal numbers of bytes, from a bounded sample."""

    def sampled(batches):
        for batch in batches:
            found = [(s.h2, s.text) for blob in batch.column(0).to_pylist() for s in decode(blob) if s.h1 & 31 == 0]
            columns = [pa.array([h for h, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text"])

    texts = sorted(r["text"] for r in bounded_sample(runs.mapInArrow(sampled, "id bigint, text binary"), "id", SAMPLED, 21).collect())
    return between_anchors(sorted({texts[len(texts) * i // parts] for i in range(1, parts)}) if texts else [])


def between_anchors(chosen: list[bytes]) -> list[bytes]:
    """Sorted cuts moved to before their anchor's gram, which so stays in one range, unless it fills more than a range."""
    return sorted({s[:GRAM] if i == 0 or chosen[i - 1][:GRAM] != s[:GRAM] else s for i, s in enumerate(chosen)})


def _pieces(runs: DataFrame, splitters: list[bytes]) -> DataFrame:
    """(part, blob): the runs cut at the splitters, front-coded anew at each cut."""

    def cut(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                piece, part, parts, blobs = [], 0, [], []
                for s in decode(blob):
                    while part < len(splitters) and s.text >= splitters[part]:
                        if piece:
                            parts.append(part)
                            blobs.append(encode(piece))
                            piece = []
                        part = bisect_right(splitters, s.text)
                    piece.append(s)
                if piece:
                    parts.append(part)
                    blobs.append(encode(piece))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return runs.mapInArrow(cut, "part int, blob binary").repartitionById(len(splitters) + 1, F.col("part"))


def _window_numbers(segments: list[Suffix], window: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per window of all segments laid end to end, and where each segment's windows start."""
    texts = [s.text[len(s.text) - s.before :] + s.text[: len(s.text) - s.before] for s in segments]
    counts = np.array([len(t) - window + 1 for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))[:-1]
    powers, inverse = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=running[1:])
    begins = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begins[-1]) - np.repeat(begins[:-1], counts) + np.repeat(starts, counts)
    return mix((running[at + window] - running[at]) * inverse[at]), begins


def _stretches(flags: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last) of runs of flagged windows inside segments."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[begins] = True
    on = np.flatnonzero(flags & (edge[:-1] | np.concatenate(([True], ~flags[:-1]))))
    off = np.flatnonzero(flags & (edge[1:] | np.concatenate((~flags[1:], [True]))))
    segment = np.searchsorted(begins, on, side="right") - 1
    return segment, on - begins[segment], off - begins[segment]


_MERGED = "kind int, h1 bigint, h2 bigint, low bigint, high bigint, window bigint"


def _resolved(pieces: DataFrame, splitters: list[bytes], window: int) -> DataFrame:
    """Kind 0: windows low..high of segment (h1, h2) repeat. Kind 1: window ``low`` asks whether its number is met
    in another range. Kind 2: a number that is met in this range, for those that ask."""
    divided = frozenset(s[:GRAM] for s in splitters if len(s) > GRAM)

    def rows(kind: int, one, two, low, high, number) -> pa.RecordBatch:
        n = len(number)
        columns = [np.full(n, kind, np.int32), one, two, low, high, number]
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c)) for c in columns], names=["kind", "h1", "h2", "low", "high", "window"])

    def crossing(segments: list[Suffix], begins: np.ndarray, after: int) -> np.ndarray:
        """Windows whose bytes from the anchor on also begin a string before the first or after the last segment.

        What a segment shares with a string farther off is the least of the prefixes shared in between; ``after`` is
        the one that the last segment shares with the string to come.
        """
        shared = np.array([s.shared for s in segments] + [after])
        reach = np.maximum(np.minimum.accumulate(shared[:-1]), np.minimum.accumulate(shared[:0:-1])[::-1])
        before = np.array([s.before for s in segments])
        counts = np.diff(begins)
        return window - np.repeat(before + begins[:-1], counts) + np.arange(begins[-1]) <= np.repeat(reach, counts)

    def group(segments: list[Suffix], after: int | None = None) -> Iterator[pa.RecordBatch]:
        """Settle the segments of some anchors; with ``after``, they are part of one anchor's and ask the other parts."""
        numbers, begins = _window_numbers(segments, window)
        _, back, counts = np.unique(numbers, return_inverse=True, return_counts=True)
        whole = np.repeat(np.array([s.count > 1 for s in segments]), np.diff(begins))
        known = whole | (counts[back] > 1)
        one, two = np.array([s.h1 for s in segments]), np.array([s.h2 for s in segments])
        segment, low, high = _stretches(known, begins)
        zeros = np.zeros(len(segment), np.int64)
        yield rows(0, one[segment], two[segment], low, high, zeros)
        if after is not None:
            across = crossing(segments, begins, after)
            asking = np.flatnonzero(~known & across)
            of = np.searchsorted(begins, asking, side="right") - 1
            yield rows(1, one[of], two[of], asking - begins[of], asking - begins[of], to_signed(numbers[asking]))
            there = to_signed(np.unique(numbers[known & across]))
            zeros = np.zeros(len(there), np.int64)
            yield rows(2, zeros, zeros, zeros, zeros, there)

    def merge(batches):
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blobs.setdefault(part, []).append(blob)
        for part in list(blobs):
            yield from settle(part, blobs.pop(part))

    def settle(part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        own, own_size, gram, edge = [], 0, None, False  # segments of the anchor at hand, and whether it is divided
        for s in merged([decode(b) for b in blobs]):
            if gram is None and part:
                s.shared = common_prefix(s.text, splitters[part - 1])
            if s.text[:GRAM] != gram:
                if own and edge:
                    yield from group(own, s.shared)
                else:
                    held += own
                    size += own_size
                own, own_size, gram = [], 0, s.text[:GRAM]
                edge = gram in divided
                if size >= GATHERED_BYTES // 4:
                    yield from group(held)
                    held, size = [], 0
            elif own_size >= GATHERED_BYTES // 4:
                # very many segments of one anchor are settled in parts that ask each other
                yield from group(own, s.shared)
                own, own_size, edge = [], 0, True
            own.append(s)
            own_size += len(s.text)
        if held:
            yield from group(held)
        if own:
            beyond = common_prefix(own[-1].text, splitters[part]) if part < len(splitters) else 0
            yield from group(own, beyond if edge else None)

    return pieces.mapInArrow(merge, _MERGED)


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_key, mark, body, keyed) and their repeated stretches as (doc_key, mark, spans of start and stop in bytes).

    ``mark`` is a hash of key and text: rows of equal key and text share their
    result, and each is a place where the other's strings also start.
    """
    require(docs, text, key)
    if window < GRAM + NEAR:
        raise ValueError(f"a repeat must be of {GRAM + NEAR} bytes at least")
    scratch = Scratch(docs.sparkSession, "repeats")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = F.col(key).isNotNull()
    marked = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(-1)).alias("doc_key"), F.xxhash64(keyed, F.col(key), F.col(text)).alias("mark"), F.col(text).alias("body"), keyed.alias("keyed")
    )
    slim = marked.drop("keyed")
    bits = _repeated_grams(slim, window, parts)
    runs, places = _runs(slim, bits, window, scratch)
    splitters = _splitters(runs, parts)
    resolved = scratch.store(_resolved(_pieces(runs, splitters), splitters, window), "resolved")
    asked = resolved.filter("kind = 1").select("h1", "h2", "low", "window")
    met = resolved.filter("kind > 0").groupBy("window").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    across = asked.join(met, "window").select("h1", "h2", "low", F.col("low").alias("high"))
    stretches = resolved.filter("kind = 0").select("h1", "h2", "low", "high").unionByName(across)
    hits = places.join(stretches, ["h1", "h2"]).select(
        "doc_key", "mark", F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + window).alias("stop")).alias("span")
    )
    return marked, hits.groupBy("doc_key", "mark").agg(F.collect_list("span").alias("spans"))


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_key, n_bytes, spans, kept): maximal removed stretches in bytes, and the remaining bytes.

    Every byte is removed that lies in a string of ``window`` bytes which also
    starts elsewhere, in the same or another document, as the input stands;
    repeats may overlap. No string reaches over the end of a document. Null
    texts count as empty, shorter texts are kept whole, every row has a result,
    rows with a null key too (doc_key null). Remaining bytes may start or end
    inside a character, so they are binary. An empty table gives none.
    """
    slim, spans = find_repeats(docs, text, key, window)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches):
        for batch in batches:
            sizes, found, kept = [], [], []
            for body, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = (body or "").encode()
                gone = _joined(marked)
                sizes.append(len(raw))
                found.append([{"start": a, "stop": b} for a, b in gone])
                edges = [0, *[x for ab in gone for x in ab], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_key", "n_bytes", "spans", "kept"])

    # a key of -1 and none stand for different documents
    both = slim.withColumn("own_key", F.when(F.col("keyed"), F.col("doc_key"))).join(spans, ["doc_key", "mark"], "left")
    return both.select(F.col("own_key").alias("doc_key"), "body", "spans").mapInArrow(
        cut, "doc_key bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )
