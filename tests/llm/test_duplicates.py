import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codefacts.llm import ann, embed_dedup, jaccard, repeats
from codefacts.llm.common import Scratch
from codefacts.llm.components import components
from codefacts.llm.suffix_runs import Suffix, decode, encode, merged

DOCS = "doc_id bigint, text string"


def linked(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    rng.shuffle(links)
    edges = spark.createDataFrame(links, "u bigint, v bigint")
    found = {r["node"]: r["component"] for r in components(edges, Scratch(spark, "test")).collect()}
    assert found == linked({x for e in links for x in e}, links)
    assert components(edges.filter(F.lit(False)), Scratch(spark, "test")).count() == 0


# -- shingles -----------------------------------------------------------------


def shingles(text, n=5):
    import re

    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(3))
    common = [word() for _ in range(30)]
    texts = [None, "", " \t\n", "One two", "one TWO", "one two three four five", "É x", "é x"]
    for _ in range(25):
        base = [word() for _ in range(rng.choice([8, 40, 120]))] + (common if rng.random() < 0.4 else [])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "one two three four five"), rows[-1]], DOCS)
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[a] and sets[b]
    ]
    want = linked(ids, links)
    joined = jaccard.jaccard_join(docs.repartition(4))
    found = joined.documents.collect()
    assert len(found) == len(rows) + 2
    for r in found:
        if r["doc_key"] is not None:
            assert (r["n_shingles"], r["component"]) == (len(sets[r["doc_key"]]), want[r["doc_key"]])
    kept = [r["doc_id"] for r in jaccard.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values()))


def test_jaccard_join_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.jaccard_join(empty).documents.count() == 0
    assert jaccard.keep_one(empty).count() == 0


def test_large_group_is_linked_through_its_leader(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    joined = jaccard.jaccard_join(spark.createDataFrame(list(enumerate(texts)), DOCS))
    assert {r["component"] for r in joined.documents.collect()} == {0}
    assert joined.links.count() < 900


# -- repeats ------------------------------------------------------------------


def plain_repeats(rows, window):
    count = Counter(b[i : i + window] for _, b in rows for i in range(len(b) - window + 1))
    out = {}
    for key, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[key] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_merge_of_front_coded_runs():
    rng = random.Random(2)
    for _ in range(200):
        runs, every = [], Counter()
        for _ in range(rng.randint(0, 7)):
            run = sorted({(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))), rng.randint(0, 1)) for _ in range(rng.randint(0, 9))})
            every.update(run)
            runs.append([Suffix(t, b, 1, 0, 0) for t, b in run])
        found = [(s.text, s.before, s.count) for s in merged([decode(encode(r)) for r in runs])]
        assert found == sorted((t, b, n) for (t, b), n in every.items())


def test_repeats_equal_brute_force(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdeé ñ\n") for _ in range(n))
    passages = [text(n) for n in (110, 130, 300, 700)]
    texts = [None, "", "short", "ab" * 400, "xyz" * 90]
    for _ in range(60):
        texts.append("".join(rng.choice([text(rng.randint(0, 200)), rng.choice(passages), rng.choice(passages)[: rng.randint(100, 300)]]) for _ in range(rng.randint(1, 5))))
    texts += [texts[10], texts[10]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain_repeats([(i, (t or "").encode()) for i, t in rows], 120)
    found = repeats.remove_repeats(docs, window=120).collect()
    assert len(found) == len(rows)
    for r in found:
        removed = sum(s["stop"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) == want[r["doc_key"]]


def test_repeats_of_an_anchor_in_many_ranges(spark, monkeypatch):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcde fghij") for _ in range(n))
    passage = text(260)
    rows = [(i, text(rng.randint(0, 90)) + passage[rng.randint(0, 60) :] + text(rng.randint(0, 90))) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    seen = []

    def cuts(runs, parts):
        texts = sorted(s.text for r in runs.collect() for s in decode(bytes(r["blob"])))
        seen.extend(repeats.between_anchors(texts[::4]))
        return seen

    monkeypatch.setattr(repeats, "_splitters", cuts)
    found = {r["doc_key"]: r for r in repeats.remove_repeats(docs, window=120).collect()}
    want = plain_repeats([(i, t.encode()) for i, t in rows], 120)
    assert any(len(s) > repeats.GRAM for s in seen)
    for i, r in found.items():
        assert (r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"])) == want[i][:3]


def test_repeats_of_repeated_rows_and_null_keys(spark):
    long = " ".join(str(i * 7919) for i in range(300))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long[:500]), (2, "x")], DOCS)
    found = defaultdict(list)
    for r in repeats.remove_repeats(docs).collect():
        found[r["doc_key"]].append(bytes(r["kept"]))
    assert found == {1: [b"", b""], None: [b""], 2: [b"x"]}
    assert repeats.remove_repeats(docs.filter(F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="at least"):
        repeats.remove_repeats(docs, window=20)


# -- embeddings ---------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int"


def vectors(rng, n, size=24):
    rows, base = [], rng.normal(size=(12, size))
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=size) * rng.choice([0.02, 0.2, 0.3])
        rows.append((i, (v * rng.uniform(0.1, 9)).tolist(), int(rng.integers(2))))
    odd = [None, [], [0.0] * size, [float("nan")] * size, [1.0, None] * (size // 2), [float("inf")] + [1.0] * (size - 1)]
    rows += [(n + i, v, 1) for i, v in enumerate(odd)]
    rows += [(n + 10, rows[0][1], rows[0][2]), (n + 11, rows[0][1], None), (n + 12, rows[0][1], rows[0][2]), (n + 13, [1.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("tile", [16, 1024])
def test_embedding_links_equal_brute_force(spark, tile):
    rows = vectors(np.random.default_rng(3), 150)
    good = {i: np.array(v) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    lab = {i: x for i, _, x in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [
        (a, b) for a in unit for b in unit if a < b and lab[a] == lab[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    ]
    degree, want = Counter(x for e in links for x in e), linked([r[0] for r in rows], links)
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), tile=tile).vectors.collect()
    assert len(found) == len(rows)
    for r in found:
        k = r["vec_key"]
        assert (r["n_links"], r["component"], r["kept"]) == (degree[k], want[k], want[k] == k)


def test_embedding_dedup_of_unusable_vectors(spark):
    rows = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0)]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).vectors.collect()
    assert sorted((r["vec_key"], r["n_links"], r["component"], r["kept"]) for r in found) == [(i, 0, i, True) for i in (1, 2, 3)]


def test_embedding_dedup_of_nothing(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).vectors.count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 64)) + rng.normal(size=64) * 2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = embed_dedup.near_pairs(x, x, 0.8)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.8), strict=True)} <= found


def test_learned_partitions_reach_their_recall(spark):
    rows = vectors(np.random.default_rng(8), 1500)
    index = ann.fit_index(spark.createDataFrame(rows, VECTORS))
    found = ann.search(index, index.rows.filter("vec_key % 20 = 0")).collect()
    good = {i: np.array(v) for i, v, _ in rows if v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    by = defaultdict(list)
    for r in found:
        by[r["query_id"]].append(r)
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ good[q]
        order = [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        got = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(good[q] @ good[r["vec_id"]]) for r in got)
        assert got == sorted(got, key=lambda r: (-r["score"], r["vec_id"]))
        hit += len({r["vec_id"] for r in got} & set(order))
        total += 20
    assert hit / total >= 0.9


def test_few_vectors_are_all_found(spark):
    rows = [(i, [1.0, float(i % 3)], 0) for i in range(6)]
    index = ann.fit_index(spark.createDataFrame(rows, VECTORS))
    found = ann.search(index, index.rows.filter("vec_key = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [1, 2, 3, 4, 5]  # all score the same: smaller ids first
    assert ann.fit_index(spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], VECTORS)) is None


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(100, 8)) * 0.1 + 3 * np.eye(8)[i] for i in range(4)])
    graph = ann.neighbours(x, x, 5, np.arange(400))
    part = ann.balanced_parts(x, graph, 4)
    assert np.bincount(part).max() <= 106
    assert (part[graph] == part[:, None]).mean() > 0.95


def test_one_key_in_two_labels_is_two_vectors(spark):
    near, far = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    rows = [(1, near, 0), (2, [1.0, 0.01, 0.1], 0), (2, far, 1), (3, [0.0, 1.0, 0.01], 1), (4, far, 1), (None, far, 1), (5, far, None), (2, far, 1)]
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS))
    got = Counter((r["vec_key"], r["n_links"], r["component"], r["kept"]) for r in found.vectors.collect())
    assert got == Counter([(1, 1, 1, True), (2, 1, 1, False), *[(2, 3, 2, True)] * 2, (3, 3, 2, False), (4, 3, 2, False), (None, 0, None, True), (5, 0, 5, True)])
    assert {(r["a"], r["b"]) for r in found.links.collect()} <= {(1, 2), (2, 1), (2, 3), (3, 2)}


def test_a_key_of_minus_one_stays_a_key(spark):
    long = " ".join(str(i * 7919) for i in range(300))
    docs = spark.createDataFrame([(-1, long), (None, long), (-1, "x"), (None, "x"), (4, None)], DOCS)
    found = sorted((str(r["doc_key"]), r["n_bytes"], len(r["spans"])) for r in repeats.remove_repeats(docs).collect())
    assert found == sorted([("-1", len(long), 1), ("None", len(long), 1), ("-1", 1, 0), ("None", 1, 0), ("4", 0, 0)])


def test_anchors_of_long_texts_are_those_of_short_ones():
    numbers = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(3)
    numbers[100:160] = numbers[100]
    for width in (5, 60, 369):
        whole = repeats.anchors(numbers, width)
        top = numbers & ~repeats.PLACE
        assert whole.tolist() == [i + int(np.argmin(top[i : i + width])) for i in range(len(numbers) - width + 1)]
        for most in (width, width + 1, 700, 5000):
            assert (repeats.anchors(numbers, width, most) == whole).all()
    assert len(repeats.anchors(numbers[:3], 5)) == 0
