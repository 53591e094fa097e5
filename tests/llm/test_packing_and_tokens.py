import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import packing, token_files
from codefacts.llm.packing import CapacityTree, best_fit_decreasing, cut
from codefacts.llm.tokens import default_vocabulary, encoder

DOCS = "doc_id bigint, text string, lang string"
TEXTS = ["one two three " * 40, None, "", "short text", "short text", "naïve café — 漢字 🙂 <|endoftext|> end", "word " * 3000]


def plain_best_fit(lengths, capacity):
    """Piece by piece: the tightest open bin, the one last changed among equals."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(room, -turn, i) for i, (room, turn) in enumerate(bins) if room >= length]
        i = min(fits)[2] if fits else len(bins)
        if not fits:
            bins.append((capacity, 0))
        bins[i] = (bins[i][0] - length, len(lengths) + 1)
    return sorted(capacity - room for room, _ in bins)


def test_capacity_tree_finds_the_tightest():
    rng = random.Random(1)
    tree, held = CapacityTree(100), {}
    for _ in range(500):
        c = rng.randint(0, 100)
        if held.get(c) and rng.random() < 0.5:
            held[c] -= 1
            tree.add(c, -1)
        else:
            held[c] = held.get(c, 0) + 1
            tree.add(c, 1)
        want = rng.randint(0, 100)
        assert tree.tightest(want) == min((k for k, n in held.items() if n and k >= want), default=None)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 8), 64, 33]) for _ in range(300)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    fill = {}
    for s in best_fit_decreasing(histogram, 64):
        for r in range(s.n_pieces):
            fill.setdefault(s.first_bin + r // s.each, []).append((s.offset + r % s.each * s.length, s.length))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(sum(n for _, n in p) for p in fill.values()) == plain_best_fit(lengths, 64)


def test_cut_puts_the_shorter_piece_first():
    assert cut(1, 4) == [(0, 1)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_encoder_equals_the_reference_library():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(default_vocabulary())
    rng = random.Random(4)
    texts = [t for t in TEXTS if t] + ["".join(chr(rng.choice([rng.randint(1, 0x250), 32, 10, rng.randint(97, 122)])) for _ in range(200)) for _ in range(60)]
    for text in texts:
        assert encoder(default_vocabulary()).ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_packed_sequences_hold_every_token_once(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no key", "x"), (3, "again", "y")], DOCS)
    packed = packing.pack(docs.repartition(3), capacity=128).placed_tokens().collect()
    own = {}
    for r in packed:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 128
        own.setdefault(r["row"], {})[r["piece"]] = (r["start"], ids.tolist())
    ids = lambda t: [*encoder(default_vocabulary()).ids(t).tolist(), 2]
    found = sorted(sum((p[1] for _, p in sorted(pieces.items())), []) for pieces in own.values())
    assert found == sorted(ids(t) for t in [*TEXTS, "no key", "again"])
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in places.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:i]) for i in range(len(pieces))]
    assert sorted(sum(n for _, n in p) for p in places.values()) == plain_best_fit([r["length"] for r in packed], 128)


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], DOCS)).pieces.count() == 0


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_scan_finds_every_document_of_flat_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    rows, want = [], []
    for f, n in enumerate([0, 1, 7, 300]):
        ids = rng.integers(0, 9, n).astype("<u2")  # 0 is the separator
        path = tmp_path / f"{f}.bin"
        path.write_bytes(ids.tobytes())
        rows.append((str(path), 2 * n))
        at = 0
        for i, end in enumerate([*np.flatnonzero(ids == 0).tolist(), n]):
            if end < n or at < n:
                want.append((str(path), i, at, end - at))
            at = end + 1
    files = spark.createDataFrame(rows, "path string, bytes bigint")
    found = token_files.scan_separators(files, 2, 0, block).select("path", "ordinal", "start", "n_tokens")
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_scan_refuses_half_ids(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole ids"):
        token_files.scan_separators(spark.createDataFrame([(str(tmp_path / "x.bin"), 3)], "path string, bytes bigint")).collect()


def test_token_counts_equal_the_encoder(spark):
    texts = [t for t in TEXTS if not t or "<|endoftext|>" not in t]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)
    found = {r["doc_key"]: r["n_tokens"] for r in token_files.token_counts(token_files.write_token_files(docs), 256).collect()}
    assert found == {i: len(encoder(default_vocabulary()).ids(t)) for i, t in enumerate(texts)}
    assert token_files.token_counts(token_files.write_token_files(docs.filter(F.lit(False)))).count() == 0
