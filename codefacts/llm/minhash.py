"""Document fingerprints by MinHash, and near duplicates by bands of them.

A document's word shingles are numbered; each of ``PERMUTATIONS`` permutations of
the 64-bit numbers (multiplication by an odd number, then an addition) has one
smallest image over its shingles. A fingerprint keeps 16 bits of each of these
minima, so the share of equal places estimates the Jaccard likeness of two
documents. Near duplicates are looked for among documents that agree in a whole
band of places, and decided by the exact Jaccard likeness of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, require, text_bytes
from codefacts.llm.components import components
from codefacts.llm.shingles import CHUNK, WIDTH, mix, shingle_numbers, shingle_sets, to_signed, word_numbers

PERMUTATIONS = 128
#: Hex digits of a place, and places of a band.
DIGITS, BAND = 4, 4
#: Shingles whose images are made at once, so that they stay in the processor's cache.
BLOCK = 32_768
#: Likeness of near duplicates, and how far below it an estimate may lie (five standard deviations) before a pair is left.
THRESHOLD, ALLOWANCE = 0.75, 0.19

_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _SHIFTS = _SEEDS[:PERMUTATIONS] | np.uint64(1), _SEEDS[PERMUTATIONS:]


def minima(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The smallest image of each run ``starts[i]:starts[i+1]`` under every permutation; no run is empty."""
    out = np.empty((PERMUTATIONS, len(starts) - 1), np.uint64)
    at = 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK, side="right")) - 1)
        block, first = numbers[starts[at] : starts[stop]], starts[at:stop] - starts[at]
        image = np.empty_like(block)
        for i in range(PERMUTATIONS):
            np.multiply(block, _FACTORS[i], out=image)
            np.add(image, _SHIFTS[i], out=image)
            out[i, at:stop] = np.minimum.reduceat(image, first)
        at = stop
    return out.T


def signatures(text: pa.Array, width: int = WIDTH) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 16-bit places per text; texts without words have all bits set."""
    data, starts = text_bytes(text)
    out = np.full((len(starts) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    at = 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + CHUNK, side="right")) - 1)
        words, first = word_numbers(data[starts[at] : starts[stop]], starts[at : stop + 1] - starts[at])
        runs = [shingle_numbers(words[first[i] : first[i + 1]], width) for i in range(stop - at)]
        held = [i for i, run in enumerate(runs) if len(run)]
        if held:
            edges = np.concatenate(([0], np.cumsum([len(runs[i]) for i in held])))
            least = mix(minima(np.concatenate([runs[i] for i in held]), edges))
            out[np.array(held) + at] = (least >> np.uint64(48)).astype(np.uint16)
        at = stop
    return out


def hexed(places: np.ndarray) -> list[str]:
    """Fingerprints as text: ``DIGITS`` hex digits a place."""
    return [row.tobytes().hex() for row in places.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row: the estimated Jaccard likeness."""
    return (a == b).mean(1) if len(a) else np.zeros(0)


# -- fingerprints of documents and of their edited texts ------------------------

_ROWS = (
    "kind string, part int, doc_key bigint, n_chars bigint, body string, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points replaced by as many first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(keys: list, texts: list[str], places: np.ndarray, following: list[str], next_places: np.ndarray, width: int) -> pa.RecordBatch:
    new = [edited(t, n) for t, n in zip(texts, following, strict=True)]
    new_places = signatures(pa.array(new, pa.string()), width)
    columns = [
        ["row"] * len(keys), [None] * len(keys), keys, [len(t) for t in texts], [None] * len(keys), [sha256(t.encode()).hexdigest() for t in new], hexed(places), hexed(new_places),
        likeness(places, new_places), likeness(places, next_places),
    ]
    return _batch(columns)


def _batch(columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _ROWS.split(", ")])


def _stream(ordered: DataFrame, width: int) -> DataFrame:
    """Rows of all documents but the last of each task, and for each task its first and its last document as they are."""

    def edge(kind: str, part: int, key, text: str) -> pa.RecordBatch:
        return _batch([[kind], [part], [key], [None], [text], *([None],) * 5])

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not len(batch):
                continue
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places = signatures(batch.column(1), width)
            if last is None:
                yield edge("head", part, keys[0], texts[0])
            else:
                keys, texts, places = [last[0], *keys], [last[1], *texts], np.concatenate((last[2], places))
            yield _compared(keys[:-1], texts[:-1], places[:-1], texts[1:], places[1:], width)
            last = keys[-1], texts[-1], places[-1:]
        if last is not None:
            yield edge("tail", part, last[0], last[1])

    return ordered.mapInArrow(run, _ROWS)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The next document is the one with the next smaller key; after the last one
    comes the first. A document alone is its own next. Null text counts as
    empty. Rows without a key come last; rows of one key stand in order of a
    hash of their texts, equal rows in any order. Texts of fewer than ``width`` words have one shingle, and texts
    without words fingerprints with all bits set, like one another and no
    other. An empty table gives no rows.

    Texts cross one shuffle, by ranges of the key; a document whose next one
    lies in another task is finished afterwards, one for each task.
    """
    require(docs, key, text)
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # the running number lets equal rows of a hot key lie in several tasks
    slim = docs.select(F.col(key).cast("bigint").alias("doc_key"), body.alias("body"), F.xxhash64(body).alias("hash"), F.monotonically_increasing_id().alias("number"))
    order = [F.desc("doc_key"), F.asc("hash"), F.asc("number")]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_key", "body")
    found = scratch.store(_stream(ordered, width), "found")
    edges = found.filter("kind <> 'row'").select("kind", "part", "doc_key", "body")
    # one number for each task
    parts = sorted(r["part"] for r in edges.filter("kind = 'head'").select("part").collect())
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    heads = edges.filter("kind = 'head'").select(F.col("part").alias("next_part"), F.col("body").alias("following"))
    seams = edges.filter("kind = 'tail'").join(pairs, "part").join(heads, "next_part").select("doc_key", "body", "following")

    def finish(batches):
        for batch in batches:
            keys, texts, following = (c.to_pylist() for c in batch.columns)
            yield _compared(keys, texts, signatures(batch.column(1), width), following, signatures(batch.column(2), width), width)

    return found.filter("kind = 'row'").unionByName(seams.mapInArrow(finish, _ROWS)).drop("kind", "part", "body")


# -- near duplicates --------------------------------------------------------------


def _bands(fingerprint: Column) -> Column:
    """One number per band of places."""
    size = DIGITS * BAND
    return F.array(*(F.xxhash64(F.lit(i), F.substring(fingerprint, i * size + 1, size)) for i in range(PERMUTATIONS // BAND)))


def _shared_places(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


@dataclass(frozen=True)
class Near:
    """``documents``: doc_key, class_id, component, both smallest keys. ``links``: verified pairs a, b of class numbers with their likeness."""

    documents: DataFrame
    links: DataFrame


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH) -> Near:
    """Components of documents whose shingle sets have a Jaccard likeness of ``threshold`` or more and agree in a band.

    Equal texts are one class. Classes that agree in a band share a bucket. In
    each round classes are compared with some leaders of their buckets, twice
    as many as in the round before, until all are; pairs that are in one
    component already, were compared before, or whose fingerprints differ in too many
    places are left out. So a bucket of near copies costs one comparison for
    each, and no link between two components of a bucket is lost but by an
    estimate ``ALLOWANCE`` below the threshold. Two documents of a likeness of
    0.75 agree in no band in one of 200,000 cases; this search is not exact,
    ``jaccard.jaccard_join`` is.

    Every row has a result: texts without words and rows without a key, whose
    component is null if no row of their component has one, too. Equal texts of
    no words are one class. An empty table gives an empty result.
    """
    require(docs, key, text)
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(key).cast("bigint").alias("doc_key"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("body"))

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hexed(signatures(batch.column(2), width)))], names=["doc_key", "digest", "fingerprint"])

    def tokenise(batches):
        for batch in batches:
            sets = [to_signed(s).tobytes() for s in shingle_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "tokens"])

    def verify(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            sizes = [(np.intersect1d(np.frombuffer(p, np.int64), np.frombuffer(q, np.int64), True).size, (len(p) + len(q)) // 8) for p, q in zip(x, y, strict=True)]
            alike = [common / (total - common) if total > common else 0.0 for common, total in sizes]
            good = [common >= threshold * (total - common) and common > 0 for common, total in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(alike, pa.float64()), pa.array(good, pa.bool_())], names=["a", "b", "likeness", "linked"])

    marked = scratch.store(slim.mapInArrow(mark, "doc_key bigint, digest binary, fingerprint string"), "marked")
    classes = marked.groupBy("digest").agg(F.min("doc_key").alias("class_id"), F.first("fingerprint").alias("fingerprint"))
    classes = scratch.store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    some = classes.filter(F.col("fingerprint") != "f" * (PERMUTATIONS * DIGITS))
    members = some.select("node", F.explode(_bands(F.col("fingerprint"))).alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.store(members.join(shared, "bucket"), "buckets")
    wanted = buckets.select("node").distinct().join(classes.select("node", "digest", "fingerprint"), "node")
    places = F.array(*(F.substring("fingerprint", i * DIGITS + 1, DIGITS) for i in range(PERMUTATIONS)))
    wanted = scratch.store(wanted.withColumn("places", places).drop("fingerprint"), "wanted")
    texts = slim.join(wanted.select("node", "digest"), "digest").groupBy("node").agg(F.first("body").alias("body"))
    sets = scratch.store(texts.mapInArrow(tokenise, "node bigint, tokens binary"), "sets")
    most = buckets.agg(F.max("n")).first()[0] or 0
    labels = scratch.store(buckets.select("node").distinct().withColumn("component", F.col("node")), "labels")
    tested = spark.createDataFrame([], "a bigint, b bigint, likeness double, linked boolean")
    turn = 0
    while most >> max(turn - 1, 0) > 1 or (turn == 0 and most > 1):
        placed = buckets.join(labels, "node")
        open_ = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
        live = placed.join(open_, "bucket").join(wanted.select("node", "places"), "node")
        chosen = F.pmod(F.xxhash64("node", F.lit(turn)), F.greatest(F.lit(1), F.shiftright("n", turn))) == 0
        leaders = live.filter(chosen).select("bucket", *(F.col(c).alias(f"l_{c}") for c in ("node", "component", "places")))
        likely = _shared_places(F.col("places"), F.col("l_places")) >= (threshold - ALLOWANCE) * PERMUTATIONS
        pairs = live.join(leaders, "bucket").filter((F.col("component") != F.col("l_component")) & likely)
        pairs = pairs.select(F.least("node", "l_node").alias("a"), F.greatest("node", "l_node").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        full = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        scratch.store(full.mapInArrow(verify, "a bigint, b bigint, likeness double, linked boolean"), f"tested_{turn}")
        tested = spark.read.parquet(*(scratch.path(f"tested_{t}") for t in range(turn + 1)))
        links = tested.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
        grown = components(links, scratch, f"grown_{turn}").withColumnRenamed("component", "merged")
        labels = buckets.select("node").distinct().join(grown, "node", "left").select("node", F.coalesce("merged", "node").alias("component"))
        labels = scratch.store(labels, f"labels_{turn}")
        turn += 1
    named = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("class_id").alias("smallest"))
    named = named.join(names, "component").select("digest", "class_id", F.col("smallest").alias("component"))
    documents = marked.select("doc_key", "digest").join(named, "digest").select("doc_key", "class_id", "component")
    return Near(documents, tested.filter("linked").select("a", "b", "likeness"))
