import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.llm import minhash, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars string, kind int, body string"


def shingles(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé漢🙂") for _ in range(4))
    out = [None, "", " \n", "One two", "x" * 30_001, "é🙂" * 7]
    while len(out) < n:
        base = [word() for _ in range(rng.choice([3, 60, 150, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 12)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def rowed(pairs):
    return [(i, t, "x", "y", "z", 1, "b") for i, t in pairs]


def test_query_equals_brute_force(spark, tmp_path):
    pairs = [((i * 37) % 1000 - 50, t) for i, t in enumerate(texts(90))] + [(None, "no key at all here")]
    spark.createDataFrame(rowed(pairs), DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    frame = queries.op13_fingerprints(spark, str(tmp_path))
    assert frame.dtypes[:7] == [
        ("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
        ("near_edited", "double"), ("near_next", "double"),
    ]
    found = {r["doc_id"]: r for r in frame.collect()}
    order = sorted(pairs, key=lambda p: (p[0] is None, -(p[0] or 0)))
    assert len(found) == len(order)
    far = []
    for (i, text), (j, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following, r = text or "", following or "", found[i]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, other = (minhash.hexed(minhash.signatures(pa.array([t])))[0] for t in (text, new))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, other)
        assert found[j]["fingerprint"] == minhash.hexed(minhash.signatures(pa.array([following])))[0]
        same = lambda a, b: sum(a[k : k + 4] == b[k : k + 4] for k in range(0, 512, 4)) / 128
        assert (r["near_edited"], r["near_next"]) == (same(own, other), same(own, found[j]["fingerprint"]))
        far += [abs(r["near_edited"] - jaccard(shingles(text), shingles(new))), abs(r["near_next"] - jaccard(shingles(text), shingles(following)))]
    assert max(far) < 0.2 and np.mean(far) < 0.02


def test_equal_rows_one_document_and_none(spark):
    one = spark.createDataFrame(rowed([(5, "a b c d e f g h")]), DOCS)
    r = minhash.fingerprints(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"a b c d " + b"a b c d").hexdigest() and r["n_chars"] == 15
    assert r["near_next"] == 1.0
    copies = minhash.fingerprints(spark.createDataFrame(rowed([(7, "same text")] * 50 + [(8, None)] * 3), DOCS).repartition(4)).collect()
    assert len(copies) == 53 and len({r["fingerprint"] for r in copies}) == 2
    assert minhash.fingerprints(one.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        minhash.fingerprints(one.drop("text"))


def test_places_estimate_the_likeness():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.1, 0.5, 0.9):
        errors = []
        for _ in range(20):
            base = [rng.choice(words) for _ in range(600)]
            other = base[: int(600 * share)] + [rng.choice(words) for _ in range(600 - int(600 * share))]
            a, b = " ".join(base), " ".join(other)
            s = minhash.signatures(pa.array([a, b, a.upper()]))
            assert (s[0] == s[2]).all()
            errors.append(minhash.likeness(s[:1], s[1:2])[0] - jaccard(shingles(a), shingles(b)))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_minima_are_those_of_each_permutation():
    rng = np.random.default_rng(1)
    numbers, starts = rng.integers(0, 1 << 63, 100_000).astype(np.uint64), np.array([0, 1, 50, 40_000, 99_999, 100_000])
    found = minhash.minima(numbers, starts)
    for i in (0, 1, 127):
        factor, shift = int(minhash._FACTORS[i]), int(minhash._SHIFTS[i])
        for k in (0, 1, 3, 4):
            assert int(found[k, i]) == min((int(x) * factor + shift) % (1 << 64) for x in numbers[starts[k] : starts[k + 1]][:: 1 if k < 3 else 1])


def test_near_duplicates_equal_brute_force(spark):
    pairs = [(i * 3, t) for i, t in enumerate(texts(110, 2))]
    family = [f"p{k}" for k in range(200)]
    pairs += [(1000 + i, " ".join([*family[:i], f"own{i}", *family[i + 1 :]])) for i in range(40)]
    pairs += [(2000, pairs[20][1]), (2001, pairs[20][1]), (None, pairs[20][1]), (2002, pairs[30][1])]
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    # texts without words are one class where they are equal
    up[3] = up[0] = 0
    near = minhash.near_duplicates(spark.createDataFrame(rowed(pairs), DOCS).repartition(3))
    found = near.documents.collect()
    assert len(found) == len(pairs)
    assert {r["doc_key"]: r["component"] for r in found if r["doc_key"] is not None} == {i: top(i) for i in sets}
    assert [r["component"] for r in found if r["doc_key"] is None] == [top(20 * 3)]
    assert all(r["likeness"] >= 0.75 for r in near.links.collect())
    # a family of copies is linked to few leaders, not pair by pair
    assert near.links.count() < 40 * 39 // 2
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).documents.count() == 0
