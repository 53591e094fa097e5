import hashlib
import random
import zlib

import pytest

from codefacts.llm import prefix_trie, queries
from codefacts.llm.radix import Direct, Few, Indexed, RadixTree

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, ids int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(convs):
    """Every prefix of every conversation, by dictionary."""
    members, ends = {(): []}, {}
    for c, turns in convs.items():
        ends.setdefault(tuple(turns), []).append(c)
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, of in members.items():
        if not of:
            continue
        subtree = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        out.append((
            min(of), len(node), min(members[node[:-1]]) if node else None, len(of), sum(len(n) == len(node) + 1 for n in subtree), sum(map(leaf, subtree)),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in subtree if n), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest(),
        ))
    return sorted(out)


def rebuilt(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def cases(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(-12, 0), 10**12 + 3, 2**62]:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é" * rng.randint(1, 3)])) for _ in range(rng.choice([1, 2, 5, 12]))]
        turns = turns if rng.random() < 0.6 else [("system", "start"), ("user", "hello"), *turns][: rng.randint(1, 9)]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(7, None, "system", "first"), (7, None, "assistant", "tied"), (8, 3, "user", "z"), (8, 3, "user", "y"), (None, 0, "user", "none")]
    rows += [rows[5], rows[5], (9, 4, "user", "long " * 40_000), (10, 4, "user", "long " * 40_000)]
    rng.shuffle(rows)
    return [(*r, "x", None) for r in rows]


def test_query_equals_brute_force(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_trie(spark, str(tmp_path))
    assert found.dtypes == [(c, "string" if c == "ends_sha256" else "bigint") for c in COLUMNS]
    assert sorted(map(tuple, found.collect())) == plain_trie(rebuilt(rows))


@pytest.mark.parametrize(("range_keys", "run_bytes"), [(20, 1 << 20), (5, 100), (1000, 1), (3, 1)])
def test_ranges_and_runs_change_nothing(spark, range_keys, run_bytes):
    rows = [r for r in cases(60, 2) if len(r[3] or "") < 100]
    # a third of all conversations are equal, another third share five turns
    rows += [(1000 + c, i, "user", "same", "x", None) for c in range(60) for i in range(6)]
    rows += [(2000 + c, i, "user", "deep" if i < 5 else f"own {c}", "x", None) for c in range(60) for i in range(6)]
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, TURNS))
    plain = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            plain.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    found = prefix_trie.prefix_trie(sequences, range_keys=range_keys, run_bytes=run_bytes)
    assert sorted(map(tuple, found.collect())) == plain_trie({c: [t[2:] for t in sorted(turns)] for c, turns in plain.items()})


def test_parting_strings_lie_between_strings_and_part_them(spark):
    rng = random.Random(4)
    keys = {b"".join(bytes([rng.randrange(3)]) * prefix_trie.WIDTH for _ in range(rng.randint(0, 6))) for _ in range(900)}
    found = prefix_trie._parting(spark.createDataFrame([(k,) for k in keys], "ids binary"), 20, len(keys))
    assert len(found) >= 5 and found == sorted(set(found))
    for p in found:
        assert any(k < p for k in keys) and any(k.startswith(p) for k in keys)
        below = max(k for k in keys if k < p)
        assert below.startswith(p[: -prefix_trie.WIDTH])


def test_empty_table_and_long_lists(spark, monkeypatch):
    empty = prefix_trie.prefix_trie(prefix_trie.turn_sequences(spark.createDataFrame([], TURNS)))
    assert empty.collect() == [] and empty.columns == COLUMNS
    monkeypatch.setattr(prefix_trie, "LIST_BYTES", 50)
    members = spark.createDataFrame([(bytes([i % 2]), i - 40) for i in range(500)], "digest binary, conv_key bigint").repartition(6)
    found = {bytes(r["digest"]): r["ends_sha256"] for r in prefix_trie._lists(members).collect()}
    for d in (0, 1):
        assert found[bytes([d])] == hashlib.sha256(",".join(str(i - 40) for i in range(d, 500, 2)).encode()).hexdigest()
    with pytest.raises(ValueError, match="missing columns"):
        prefix_trie.turn_sequences(members)


def test_radix_tree_grows_and_keeps_every_key_in_order():
    rng = random.Random(3)
    keys = {bytes(rng.choices(range(8), k=rng.randint(0, 6))) for _ in range(400)} | {b"q" + bytes([i]) + b"tail" for i in range(256)} | {b"q" + bytes([i]) for i in range(40)}
    tree, layouts = RadixTree(), set()
    order = list(keys)
    rng.shuffle(order)
    for i, key in enumerate(order):
        tree.insert(key, i)
        layouts.add((type(tree.root.kids), getattr(tree.root.kids, "room", 0)))
        at_q = tree.root.kids.get(ord("q")) if tree.root.kids else None
        layouts.add((type(at_q.kids), getattr(at_q.kids, "room", 0)) if at_q and at_q.kids else (None, 0))
    path, found = bytearray(), []
    for above, rest, value in tree.walk():
        del path[above:]
        path += rest
        if value is not None:
            found.append((bytes(path), value))
    assert found == sorted((k, i) for i, k in enumerate(order))
    assert {(Few, 4), (Few, 16), (Indexed, 0), (Direct, 0)} <= layouts
