"""Exact n-gram Jaccard self-join by a token-group matrix.

1.  Every text becomes its set of shingles. Equal sets form one class, and only
    a class's smallest document goes on.
2.  Min-hash bands gather similar documents around a leader; where the exact
    similarity to the leader reaches the threshold the document joins its group.
3.  The matrix holds, for every token of a group's documents' signatures, the
    group. A signature is the first part of a set in one order of all tokens,
    frequent ones last; two sets similar enough share a token of their
    signatures, so a token held by one group only can be left out.
4.  A document probes the matrix: how much it can share with a group's tokens
    is bounded by where the first shared token stands. Only groups that the
    bound lets through are opened, their documents bounded likewise, and the
    remaining pairs are compared by their whole sets.

Members of one group are linked through its leader, so pairs inside a group,
however large, are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, most_counted, require
from codefacts.llm.components import components
from codefacts.llm.shingles import WIDTH, mix, shingle_sets, to_signed

#: Similarity of linked documents, in hundredths.
PERCENT = 75
#: Min-hash bands that propose leaders, and min-hashes in each.
BANDS, BAND_WIDTH = 6, 3
#: A token may be frequent from so many documents of one task on; how frequent tells the sum over all tasks.
FREQUENT_FROM = 3
#: At most so many frequent tokens are ranked last, the most frequent ones. They set the order only; no token is dropped.
FREQUENT_LIMIT = 200_000
#: Counters of a task's frequency sketch.
SKETCH = 1 << 22
#: Bits of the filter that spares documents outside the candidate pairs from being cut again.
FILTER_BITS = 1 << 23
#: Ids of the matrix that a task gathers before it sends them on.
GATHERED = 1 << 20


def least_overlap(n: Column, m: Column, percent: int = PERCENT) -> Column:
    """Smallest common part of two sets of these sizes that links them."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def signature_size(n: int, percent: int) -> int:
    """Two linked sets share a token among the first so many of each."""
    return n - -(-percent * n // 100) + 1


@dataclass(frozen=True)
class Joined:
    """``documents``: doc_key, n_shingles, component. ``links``: verified pairs a, b, common between class representatives.
    ``classes``: doc_key, representative."""

    documents: DataFrame
    links: DataFrame
    classes: DataFrame


def _frequent(slim: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """Tokens that many documents of some task hold, the most frequent last. About ``FREQUENT_LIMIT`` in all come to the driver."""

    def run(batches):
        sketch, heavy = np.zeros(SKETCH, np.uint16), {}
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), width):
                slot = (tokens >> np.uint64(40)).astype(np.int64) & (SKETCH - 1)
                sketch[slot] = np.minimum(sketch[slot], np.uint16(60_000)) + np.uint16(1)
                for token in tokens[sketch[slot] >= FREQUENT_FROM].tolist():
                    heavy[token] = heavy.get(token, FREQUENT_FROM - 1) + 1
                if len(heavy) > 4 * FREQUENT_LIMIT:
                    yield _heavy_rows(heavy)
                    heavy = {}
        yield _heavy_rows(heavy)

    found = slim.select("body").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = most_counted(found, "n", FREQUENT_LIMIT, scratch, "frequent").toPandas()
    scratch.drop("frequent")
    return top.sort_values(["n", "token"])["token"].to_numpy(np.int64).view(np.uint64)


def _heavy_rows(heavy: dict[int, int]) -> pa.RecordBatch:
    tokens = np.fromiter(heavy, np.uint64, len(heavy)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(list(heavy.values()), pa.int64())], names=["token", "n"])


class _Order:
    """The one order of tokens: by number, frequent ones after all others by frequency."""

    def __init__(self, frequent: np.ndarray):
        by = np.argsort(frequent)
        self.tokens, self.rank = frequent[by], by

    def signature(self, tokens: np.ndarray, size: int) -> np.ndarray:
        if not len(self.tokens):
            return tokens[:size]
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        known = self.tokens[at] == tokens
        rare = tokens[~known]
        if len(rare) >= size:
            return rare[:size]
        common = tokens[known][np.argsort(self.rank[at[known]])]
        return np.concatenate((rare, common))[:size]


def _bounds() -> np.ndarray:
    step = (1 << 64) // (BANDS * BAND_WIDTH)
    return np.array([i * step for i in range(BANDS * BAND_WIDTH)], np.uint64)


def _min_hashes(tokens: np.ndarray, bounds: np.ndarray) -> list[int]:
    """One number per band. Token numbers are random, so the first one from each of equally spaced
    values on, going round at the end, is the smallest under one of as many orders."""
    at = np.searchsorted(tokens, bounds)
    least = mix(tokens[np.where(at < len(tokens), at, 0)] ^ bounds).reshape(BANDS, BAND_WIDTH)
    return to_signed(mix(least.sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))).tolist()


def _parity(tokens: np.ndarray) -> bytes:
    """For each of 2n or more classes of tokens, whether an odd number of them falls into it."""
    classes = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of how many tokens stand in just one of two sets, from their parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _signatures(slim: DataFrame, order: _Order, width: int, percent: int) -> DataFrame:
    """doc_key, n, a digest of the set, its bands, parities and signature (64-bit little-endian numbers)."""

    def run(batches):
        bounds = _bounds()
        for batch in batches:
            n, one, two, bands, parity, blobs = [], [], [], [], [], []
            for tokens in shingle_sets(batch.column(1), width):
                n.append(len(tokens))
                one.append(int(to_signed(tokens.sum(keepdims=True, dtype=np.uint64))[0]))
                two.append(int(to_signed(mix(tokens).sum(keepdims=True, dtype=np.uint64))[0]))
                bands.append(_min_hashes(tokens, bounds) if len(tokens) else [])
                parity.append(_parity(tokens) if len(tokens) else b"")
                blobs.append(order.signature(tokens, signature_size(len(tokens), percent)).tobytes() if len(tokens) else b"")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip((n, one, two, bands, parity, blobs), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_key", "n", "d1", "d2", "bands", "parity", "signature"])

    return slim.mapInArrow(run, "doc_key bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, parity binary, signature binary")


def _id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of a fixed-size filter: never misses an id, may let others through. Tokens are random already, keys are hashed."""
    slot = F.col(column).bitwiseAND(FILTER_BITS - 1) if column == "token" else F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    slots = ids.select(slot.alias("slot"))
    words = slots.select(F.expr("cast(slot div 32 AS int)").alias("word"), F.expr("shiftleft(1L, cast(slot % 32 AS int))").alias("bits"))
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _whole_sets(slim: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_key, tokens (blob) of the documents named by ``ids`` (doc_key); the filter drops most others in the scan."""
    bits = _id_filter(ids, "doc_key")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(2).to_numpy()
            wanted = pa.array((bits[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1) > 0)
            batch = batch.filter(wanted)
            blobs = pa.array([t.tobytes() for t in shingle_sets(batch.column(1), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["doc_key", "tokens"])

    slotted = slim.withColumn("slot", F.pmod(F.xxhash64("doc_key"), F.lit(FILTER_BITS)))
    return slotted.mapInArrow(run, "doc_key bigint, tokens binary")


def _plausible(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parities do not rule out: far fewer bytes than the sets, and never a link lost."""

    def run(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            gap = np.array([apart(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            most = (n + m - gap) // 2
            yield batch.filter(pa.array(100 * most >= percent * (n + m - most))).select(["a", "b"])

    of_a, of_b = (heads.select(F.col("doc_key").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "na", "pa", "nb", "pb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, slim: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, with the size of their common part."""
    ids = pairs.select(F.col("a").alias("doc_key")).unionByName(pairs.select(F.col("b").alias("doc_key")))
    sets = _whole_sets(slim, ids, width)

    def run(frames):
        for frame in frames:
            common, linked = [], []
            for x, y in zip(frame["ta"], frame["tb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                linked.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            out = pd.DataFrame({"a": frame["a"], "b": frame["b"], "common": common})
            yield out[np.array(linked, bool)]

    of_a, of_b = sets.select(F.col("doc_key").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("doc_key").alias("b"), F.col("tokens").alias("tb"))
    return scratch.store(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a bigint, b bigint, common bigint"), name)


def _leaders(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), b smaller: a representative and the leader of each of its bands.

    The leader of a band is the document that shares the most bands with
    others: in a family of copies that is the one that they are copies of, to
    which they are more alike than to each other.
    """
    banded = reps.select("doc_key", F.explode("bands").alias("band"))
    crowds = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    shared = scratch.store(banded.join(crowds, "band"), "bands")
    weights = shared.groupBy("doc_key").agg(F.sum("n").alias("weight"))
    weighed = shared.select("doc_key", "band").join(weights, "doc_key")
    first = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("doc_key")).alias("key"))).alias("best"))
    led = shared.select("doc_key", "band").join(first.select("band", (-F.col("best.key")).alias("leader")), "band").filter("doc_key <> leader")
    return led.select(F.greatest("doc_key", "leader").alias("a"), F.least("doc_key", "leader").alias("b")).distinct()


def _matrix(signed: DataFrame, parts: int) -> DataFrame:
    """(token, grp) for tokens that stand in signatures of two groups or more.

    A task sends each (token, group) once, packed by ranges of tokens, so a
    token of a large group travels once per task and not once per document.
    """
    kinds = np.dtype([("token", "<u8"), ("grp", "<i8")])

    def combined(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows["grp"], rows["token"]))]
        fresh = np.concatenate(([True], (rows["token"][1:] != rows["token"][:-1]) | (rows["grp"][1:] != rows["grp"][:-1])))
        return rows[fresh]

    def sent(rows: list[np.ndarray]) -> pa.RecordBatch:
        rows = combined(np.concatenate(rows))
        part = (rows["token"] >> np.uint64(32)).astype(np.int64) * parts >> 32
        cuts = np.flatnonzero(np.diff(part)) + 1
        pieces = np.split(rows, cuts)
        return pa.RecordBatch.from_arrays(
            [pa.array(part[np.concatenate(([0], cuts))].astype(np.int32)), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["part", "rows"]
        )

    def gather(batches):
        rows, held = [], 0
        for batch in batches:
            for blob, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = np.frombuffer(blob, np.uint64)
                new = np.zeros(len(tokens), kinds)
                new["token"], new["grp"] = tokens, group
                rows.append(new)
                held += len(new)
                if held >= GATHERED:
                    yield sent(rows)
                    rows, held = [], 0
        if held:
            yield sent(rows)

    def crossing(batches):
        rows = [np.frombuffer(blob, kinds) for batch in batches for blob in batch.column(1).to_pylist()]
        if not rows:
            return
        rows = combined(np.concatenate(rows))
        same = rows["token"][1:] == rows["token"][:-1]
        rows = rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        for at in range(0, len(rows), 200_000):
            some = rows[at : at + 200_000]
            columns = [to_signed(some["token"].copy()), some["grp"].copy()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "grp"])

    packed = signed.select("signature", "grp").mapInArrow(gather, "part int, rows binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(crossing, "token bigint, grp bigint")


def _probes(signed: DataFrame, matrix: DataFrame) -> DataFrame:
    """(token, doc_key, grp, n, place) of signature tokens that the matrix holds."""

    tokens = matrix.select("token").distinct()
    bits = _id_filter(tokens, "token")

    def run(batches):
        for batch in batches:
            blobs = [np.frombuffer(b, np.int64) for b in batch.column(0).to_pylist()]
            if not blobs:
                continue
            sizes = np.array([len(b) for b in blobs])
            token = np.concatenate(blobs)
            slot = token & (FILTER_BITS - 1)
            wanted = (bits[slot // 32] >> (slot % 32).astype(np.uint32)) & np.uint32(1) > 0
            repeat = lambda i: np.repeat(batch.column(i).to_numpy(), sizes)[wanted]
            places = np.concatenate([np.arange(s) for s in sizes])[wanted].astype(np.int32)
            columns = [token[wanted], repeat(1), repeat(2), repeat(3).astype(np.int32), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "doc_key", "grp", "n", "place"])

    groups = matrix.select("grp").distinct()
    near = signed.join(groups, "grp", "left_semi").select("signature", "doc_key", "grp", "n")
    exploded = near.mapInArrow(run, "token bigint, doc_key bigint, grp bigint, n int, place int")
    return exploded.join(tokens, "token", "left_semi")


def _candidates(probes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): documents of different groups that pass the bounds of the group and then their own.

    From a shared token on, two sets can share no more than what is left of the
    smaller rest. Linked sets share a token with enough left of both, so other
    tokens are passed over already where rows of the matrix meet.
    """
    room = F.col("n") - F.col("place")
    sides = probes.groupBy("token", F.col("grp").alias("other")).agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max(room).alias("room"), F.count("*").alias("members"), F.min("doc_key").alias("member")
    )
    smallest = F.greatest(F.col("min_n"), F.ceil(percent * F.col("n") / 100 - 1e-9))
    fits = (F.col("other") < F.col("grp")) & (100 * F.col("max_n") >= percent * F.col("n")) & (percent * F.col("min_n") <= 100 * F.col("n"))
    enough = F.least(room, F.col("room")) >= least_overlap(F.col("n"), smallest, percent)
    met = probes.alias("p").join(sides, (F.col("p.token") == sides["token"]) & fits & enough)
    opened = met.groupBy(F.col("doc_key").alias("a"), "other").agg(
        F.max("members").alias("members"), F.min("member").alias("member"), F.max("member").alias("last")
    )
    opened = scratch.store(opened, "opened")
    # where the tokens shared are those of one document of the group, the pair is known
    single = opened.filter("members = 1 AND member = last").select("a", F.col("member").alias("b"))
    several = opened.filter("members > 1 OR member < last").select("a", "other")
    asking = probes.select("token", F.col("doc_key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa")).join(several, "a")
    members = probes.select("token", F.col("doc_key").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("grp").alias("other"))
    close = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least_overlap(F.col("na"), F.col("nb"), percent)
    x, y = asking.alias("x"), members.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.other") == F.col("y.other"))
    pairs = x.join(y, same & close & left).select("a", "b").distinct()
    return single.unionByName(pairs)


def jaccard_join(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> Joined:
    """Components of documents linked by a Jaccard similarity of their shingle sets of ``percent`` hundredths or more.

    ``links`` span the components but are not all links: inside a group only
    those to its leader are listed, between groups the verified pairs.

    Words are runs of bytes other than blanks, tabs and line breaks, with A-Z
    read as a-z. A text of fewer than ``width`` words is one shingle; null and
    empty texts and texts of blanks have none and link with nothing. Documents
    of equal sets are a class; links stand between class representatives.
    ``component`` is the smallest key reachable, the document itself included.
    Every row has a result by its own text; rows that share a key link through
    it. Rows whose key is null link with nothing and have a null component. An
    empty table gives empty tables.
    """
    require(docs, key, text)
    scratch = Scratch(docs.sparkSession, "jaccard")
    slim = docs.select(F.col(key).cast("bigint").alias("doc_key"), F.col(text).alias("body"))
    order = _Order(_frequent(slim.select("body"), width, scratch))
    signed = scratch.store(_signatures(slim, order, width, percent), "signatures")
    slim = slim.filter("doc_key IS NOT NULL")
    known = signed.filter("doc_key IS NOT NULL AND n > 0")
    reps = scratch.store(known.groupBy("n", "d1", "d2").agg(F.min("doc_key").alias("rep")), "classes")
    heads = scratch.store(
        known.join(reps.select(F.col("rep").alias("doc_key"), "n", "d1", "d2"), ["doc_key", "n", "d1", "d2"], "left_semi")
        .select("doc_key", "n", "d1", "d2", "bands", "parity").dropDuplicates(["doc_key", "n", "d1", "d2"]), "heads"
    )
    light = scratch.store(signed.select("doc_key", "n", "d1", "d2"), "light")
    stars = _verified(scratch.store(_plausible(_leaders(heads, scratch), heads, percent), "leaders"), slim, width, percent, scratch, "stars")
    grouped = components(stars.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "groups")
    groups = heads.drop("bands", "parity").join(grouped.withColumnRenamed("node", "doc_key"), "doc_key", "left")
    groups = groups.withColumn("grp", F.coalesce("component", "doc_key")).drop("component")
    same = ["doc_key", "n", "d1", "d2"]
    placed = scratch.store(known.drop("bands", "parity").join(groups, same).select("doc_key", "n", "grp", "signature"), "placed")
    scratch.drop("signatures")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrix = scratch.store(_matrix(placed, parts), "matrix")
    probes = scratch.store(_probes(placed, matrix), "probes")
    scratch.drop("placed")
    pairs = scratch.store(_plausible(_candidates(probes, percent, scratch), heads, percent), "pairs")
    scratch.drop("probes", "matrix", "opened", "heads")
    crossed = _verified(pairs, slim, width, percent, scratch, "crossed")
    links = stars.unionByName(crossed)
    whole = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "linked")
    classes = light.join(reps, ["n", "d1", "d2"], "left").select("doc_key", "n", "rep")
    found = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    documents = found.select("doc_key", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_key").alias("component"))
    return Joined(documents, links, classes.select("doc_key", F.col("rep").alias("representative")))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, once each; rows without a key stay."""
    joined = jaccard_join(docs, text, key, percent=percent)
    found = joined.documents.filter("doc_key IS NOT NULL")
    gone = found.filter("doc_key <> component").select(F.col("doc_key").alias(key)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone, key, "left_anti").select(*columns)
    repeated = found.groupBy(F.col("doc_key").alias(key)).count().filter("count > 1").drop("count")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key, "left_semi").select(*columns).dropDuplicates([key])
    return kept.join(repeated, key, "left_anti").select(*columns).unionByName(once)
