"""Trie of the turns that conversations share from their beginnings, built by adaptive radix trees.

A turn becomes an id of ``WIDTH`` bytes: the byte length of its text,
big-endian, and a digest of role and text. A conversation is the string of its
ids; equal conversations are one string with a count. The strings are dealt out
by ranges of their byte order, and each task puts runs of a range into radix
trees. Path compression skips what a string shares with no other; only byte
depths that are multiples of ``WIDTH`` stand for a turn, and only these give
nodes.

A node whose conversations lie in several runs is completed by one aggregation.
Such nodes are the proper prefixes of the strings that part the runs, so every
run knows which of its nodes are shared, and which run has to count a shared
node as somebody's child: the first one that holds it. All figures of a subtree
are sums over runs.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, require
from codefacts.llm.radix import RadixTree
from codefacts.llm.suffix_runs import common_prefix

#: Bytes of a turn id: four of length, the rest digest.
WIDTH = 20
DIGEST = 16
#: Strings and bytes of a range, ranges at most (larger ranges take longer, no more memory), turns of a string that may part ranges.
RANGE_KEYS, RANGE_BYTES, MAX_RANGES, MAX_PARTING = 20_000, 16 << 20, 4096, 64
#: Bytes of strings held in one radix tree; a longer single string is held alone.
RUN_BYTES = 2 << 20
#: Bytes of ids joined into one row before they are hashed.
LIST_BYTES = 1 << 20
#: Shared nodes up to which they are sent to every task that looks for a parent.
MAX_BROADCAST = 500_000

_NODES = (
    "conv bigint, depth bigint, parent bigint, above binary, shared binary, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends binary"
)


def _short(column: Column) -> Column:
    """The first ``DIGEST`` bytes of a SHA-256, as a hex string."""
    return F.substring(F.sha2(column, 256), 1, 2 * DIGEST)


def turn_sequences(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_key, ids) of every conversation, its turn ids in order of ``turn``, null first.

    Null role or text counts as empty. Turns of one number stand in order of
    role, then of the first 64 characters of their text, then of their id;
    repeated rows are turns of their own. Rows without a key belong to no
    conversation. A conversation's ids must fit into one row (2 GiB).
    """
    require(conversations, key, turn, role, text)
    plain = conversations.select(
        F.col(key).cast("bigint").alias("conv_key"), F.col(turn).cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text")))
    ).filter("conv_key IS NOT NULL")
    told = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    ident = F.concat(F.lpad(F.hex(F.octet_length("text")), 8, "0"), _short(told.cast("binary")))
    one = F.struct("turn", "role", F.substring("text", 1, 64).alias("begins"), ident.alias("id"))
    turns = F.sort_array(F.collect_list(one))
    return plain.groupBy("conv_key").agg(F.unhex(F.array_join(F.transform(turns, lambda t: t["id"]), "")).alias("ids"))


def forked(sequences: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Every conversation c begun anew with the first h turns of c - c % family, its own first h left out; h = crc32(c) % modulus.

    A conversation whose family has no such member, or one with fewer turns,
    keeps what is there. The remainder has the sign of c.
    """
    sequences = Scratch(sequences.sparkSession, "forked").store(sequences, "sequences")
    key, h = F.col("conv_key"), (F.crc32(F.col("conv_key").cast("string").cast("binary")) % modulus).cast("int")
    heads = sequences.filter(key % family == 0).select(key.alias("head_key"), F.substring("ids", 1, WIDTH * (modulus - 1)).alias("head"))
    begun = F.coalesce(F.substr("head", F.lit(1), h * WIDTH), F.lit(b""))
    own = sequences.withColumn("head_key", key - key % family).join(heads, "head_key", "left")
    return own.select("conv_key", F.concat(begun, F.substr("ids", h * WIDTH + 1)).alias("ids"))


# -- ranges ---------------------------------------------------------------------


def _parting(strings: DataFrame, ranges: int, n: int) -> list[bytes]:
    """Strings that part the byte order into about ``ranges`` ranges, each as short as tells it from the sampled string before it."""
    if ranges < 2:
        return []
    number = F.pmod(F.xxhash64("ids"), F.lit(1 << 40))
    every = max(1, n // (16 * ranges))
    sample = strings.filter(number % every == 0).select("ids", (F.floor(number / every) % 4 == 0).alias("picked"))

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for ids, picked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if picked and last is not None:
                    turns = common_prefix(last, ids) // WIDTH + 1
                    out += [ids[: turns * WIDTH]] if turns <= MAX_PARTING else []
                last = ids
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["parting"])

    ordered = sample.repartitionByRange(max(1, ranges // 16), "ids").sortWithinPartitions("ids")
    # about four a range, each of at most MAX_PARTING turns
    found = sorted(bytes(r["parting"]) for r in ordered.mapInArrow(run, "parting binary").collect())
    step = max(1, round(len(found) / ranges))
    return found[step - 1 :: step]


def _run_nodes(keys: list[bytes], copies: list[int], convs: list[int], digests: list[bytes], low: int, high: int) -> pa.RecordBatch:
    """Nodes of one run of sorted strings. Its first string's prefixes of up to ``low`` turns, and its last one's of up to ``high``, are shared."""
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    depths, parents, sizes, n, conv, ends = [0], [-1], [0], [0], [None], [None]
    open_rows = [0]  # of the turns on the way down
    path = bytearray()
    for above, bytes_, value in tree.walk():
        del path[above:]
        path += bytes_
        del open_rows[above // WIDTH + 1 :]
        for depth in range(above // WIDTH + 1, len(path) // WIDTH + 1):
            parents.append(open_rows[-1])
            open_rows.append(len(depths))
            depths.append(depth)
            sizes.append(int.from_bytes(path[(depth - 1) * WIDTH : (depth - 1) * WIDTH + 4]))
            n.append(0)
            conv.append(None)
            ends.append(None)
        if value is not None:
            row = open_rows[-1]
            n[row], conv[row], ends[row] = copies[value], convs[value], digests[value]
    rows = len(depths)
    # rows come in key order, parents first: the first string's prefixes lead, the last row is the last string's end
    shared: list[bytes | None] = [None] * rows
    counted = bytearray(b"\1") * rows
    for row, mark in _marks(keys[0], low, range(low + 1)):
        shared[row], counted[row] = mark, 0
    chain = []
    row = rows - 1
    while row >= 0:
        chain.append(row)
        row = parents[row]
    for row, mark in _marks(keys[-1], high, chain[::-1]):
        shared[row] = mark
    children, leaves, saved = [0] * rows, [0] * rows, [0] * rows
    for row in range(rows - 1, -1, -1):
        up = parents[row]
        if not children[row] and not leaves[row] and shared[row] is None:
            leaves[row] = 1
        saved[row] += n[row] * sizes[row] - (sizes[row] if counted[row] else 0)
        if up >= 0:
            n[up] += n[row]
            conv[up] = conv[row] if conv[up] is None else min(conv[up], conv[row])
            children[up] += counted[row]
            leaves[up] += leaves[row]
            saved[up] += saved[row]
    parent = [None if p < 0 or shared[p] is not None else conv[p] for p in parents]
    above = [shared[p] if p >= 0 else None for p in parents]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.array(c, pa.int64()) for c in (conv, depths, parent)), *(pa.array(c, pa.binary()) for c in (above, shared)),
            *(pa.array(c, pa.int64()) for c in (n, children, leaves, saved)), pa.array(ends, pa.binary()),
        ],
        names=[f.split()[0] for f in _NODES.split(", ")],
    )


def _marks(key: bytes, turns: int, rows) -> Iterator[tuple[int, bytes]]:
    """(row, digest) of the prefixes of ``key`` of up to ``turns`` turns, ``rows`` in order of depth."""
    hashed = sha256()
    for depth, row in zip(range(turns + 1), rows, strict=False):
        if depth:
            hashed.update(key[(depth - 1) * WIDTH : depth * WIDTH])
        yield row, hashed.digest()[:DIGEST]


def _partial_nodes(strings: DataFrame, parting: list[bytes], run_bytes: int) -> DataFrame:
    """Nodes of all runs; those with ``shared`` are parts of a node."""

    def place(batches):
        for batch in batches:
            at = [bisect_right(parting, ids) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "range"])

    def build(batches):
        held: list[tuple[bytes, int, int, bytes]] = []
        size, now, low = 0, None, -1
        turns = lambda r: len(parting[r]) // WIDTH - 1
        flush = lambda high: _run_nodes(*map(list, zip(*held, strict=True)), low, max(high, 0))
        for batch in batches:
            for ids, copies, conv, digest, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (at != now or size + len(ids) > run_bytes):
                    high = turns(now) if at != now else common_prefix(held[-1][0], ids) // WIDTH
                    yield flush(high)
                    held, size, low = [], 0, high
                if at != now:
                    now, low = at, turns(at - 1) if at else -1
                held.append((ids, copies, conv, digest))
                size += len(ids)
        if held:
            yield flush(turns(now) if now < len(parting) else 0)

    placed = strings.select("ids", "copies", "conv", "digest").mapInArrow(place, "ids binary, copies bigint, conv bigint, digest binary, range int")
    dealt = placed.repartition(max(1, len(parting) + 1), "range").sortWithinPartitions("range", "ids")
    return dealt.mapInArrow(build, _NODES)


def _lists(members: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the hash of the sorted keys of each string, comma-joined.

    The keys of one string are sorted by all tasks and joined to long pieces
    first. A hash is made of its pieces in order, one piece in memory at a time.
    """

    def pieces(batches):
        digest, first, held, size = None, None, [], 0
        out = [], [], []

        def close():
            for column, value in zip(out, (digest, first, ",".join(held)), strict=True):
                column.append(value)

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["digest", "first", "piece"])
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            for found, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (found != digest or size > LIST_BYTES):
                    close()
                    held, size = [], 0
                if not held:
                    digest, first = found, key
                held.append(str(key))
                size += len(held[-1]) + 1
            yield rows()
        if held:
            close()
            yield rows()

    def hashes(batches):
        digest, hashed = None, None
        for batch in batches:
            out = [], []
            for found, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if found == digest:
                    hashed.update(b",")
                else:
                    if hashed:
                        out[0].append(digest)
                        out[1].append(hashed.hexdigest())
                    digest, hashed = found, sha256()
                hashed.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["digest", "ends_sha256"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([digest], pa.binary()), pa.array([hashed.hexdigest()])], names=["digest", "ends_sha256"])

    ordered = members.repartitionByRange("digest", "conv_key").sortWithinPartitions("digest", "conv_key")
    joined = ordered.mapInArrow(pieces, "digest binary, first bigint, piece string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashes, "digest binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, range_keys: int = RANGE_KEYS, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per distinct sequence of first turns: the nodes of the trie of (conv_key, ids).

    conv_id is the smallest member and, with depth, names a node: a
    conversation has one node per depth. parent_conv_id is null for the root,
    the textless node of depth 0 that every conversation belongs to, also one
    without turns. n_convs counts members, n_children children, n_leaves the
    childless nodes of the subtree (its top included), saved_tokens adds up
    (n_convs - 1) times the bytes of a node's last text over it. ends_sha256 is
    the hash of the keys of the conversations that end here, ascending and
    comma-joined. Without conversations there are no nodes. Keys must be
    distinct and not null, as ``turn_sequences`` gives them.
    """
    spark = sequences.sparkSession
    scratch = Scratch(spark, "prefix-trie")
    held = scratch.store(sequences.select("conv_key", "ids", F.unhex(_short(F.col("ids"))).alias("digest")), "held")
    strings = held.groupBy("ids", "digest").agg(F.count("*").alias("copies"), F.min("conv_key").alias("conv"))
    strings = scratch.store(strings, "strings")
    about = strings.agg(F.count("*").alias("n"), F.sum(F.length("ids")).alias("size")).first()
    n, size = about["n"], about["size"] or 0
    busy = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 500)
    ranges = min(MAX_RANGES, max(n // range_keys, size // range_bytes, busy))
    parts = scratch.store(_partial_nodes(strings, _parting(strings, ranges, n), run_bytes), "parts")
    whole = [F.min(c).alias(c) for c in ("conv", "depth", "parent")] + [F.first("above", True).alias("above")]
    whole += [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")] + [F.first("ends", True).alias("ends")]
    shared = scratch.store(parts.filter("shared IS NOT NULL").groupBy("shared").agg(*whole), "shared")
    nodes = parts.filter("shared IS NULL").drop("shared").unionByName(shared.drop("shared"))
    tops = shared.select(F.col("shared").alias("above"), F.col("conv").alias("top"))
    asked = nodes.filter("above IS NOT NULL").join(F.broadcast(tops) if tops.count() <= MAX_BROADCAST else tops, "above")
    nodes = asked.unionByName(nodes.filter("above IS NULL").withColumn("top", F.lit(None).cast("bigint")))
    lists = scratch.store(_lists(held.select("digest", "conv_key")), "lists")
    scratch.drop("held", "strings")
    ended = nodes.filter("ends IS NOT NULL").join(lists.withColumnRenamed("digest", "ends"), "ends")
    passed = nodes.filter("ends IS NULL").withColumn("ends_sha256", F.sha2(F.lit(b""), 256))
    return ended.unionByName(passed).select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "top").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256"
    )
