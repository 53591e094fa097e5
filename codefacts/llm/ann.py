"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into parts of nearly equal size
with few edges between them. A small classifier learns how a vector's nearest
neighbours are spread over the parts. It places every row of the table in a
part and sends a query to its most probable parts, as many as reach a share of
the expected neighbours that was calibrated on vectors kept out of training.
Rows of these parts are then ranked by exact inner products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import Scratch, bounded_sample, require
from codefacts.llm.embed_dedup import usable

#: Neighbours that a search returns.
NEAREST = 20
#: Graph, parts and classifier are learned from at most so many vectors, chosen by a hash.
MAX_FITTED = 12_000
#: Share of the sample that calibrates the routing and is kept out of training.
HELD_OUT = 0.15
#: Parts grow with the square root of the table; each part is cut into blocks of bounded size.
PARTS_PER_ROOT, MOST_PARTS = 1 / 14, 512
BLOCK, QUERY_CHUNK = 8192, 4096
#: Recall that routing aims at on the calibration vectors.
AIMED_RECALL = 0.97
HIDDEN, EPOCHS, BATCH, RATE = 128, 30, 256, 2e-3


def neighbours(x: np.ndarray, of: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Rows of ``x`` with the largest inner products with each row of ``of``; ``own`` names a row to leave out."""
    k = min(k, len(x) - (own is not None))
    out = np.zeros((len(of), max(k, 0)), np.int64)
    for at in range(0, len(of), 512):
        scores = of[at : at + 512] @ x.T
        if own is not None:
            scores[np.arange(len(scores)), own[at : at + 512]] = -np.inf
        if k > 0:
            out[at : at + 512] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rounds: int = 12, slack: float = 1.05) -> np.ndarray:
    """A part for each vertex: halves along principal axes at first, then moves that keep more edges inside parts.

    In each round vertices move to the part that holds most of their
    neighbours (edges count both ways), the largest gains first, as long as
    no part outgrows its share by more than ``slack`` nor loses as much.
    """
    part = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        part[rows] = first
        if count < 2 or len(rows) < 2:
            return
        inner = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(inner.T @ inner)[1][:, -1]
        left = count // 2
        cut = len(rows) * left // count
        order = np.argsort(inner @ axis, kind="stable")
        halve(rows[order[:cut]], first, left)
        halve(rows[order[cut:]], first + left, count - left)

    halve(np.arange(len(x)), 0, n_parts)
    most, least = int(np.ceil(slack * len(x) / n_parts)), int(len(x) / n_parts / slack)
    ends = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), n_parts), np.int32)
        np.add.at(votes, (ends[0], part[ends[1]]), 1)
        np.add.at(votes, (ends[1], part[ends[0]]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=n_parts), 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if size[best[v]] < most and size[part[v]] > least:
                size[best[v]] += 1
                size[part[v]] -= 1
                part[v] = best[v]
                moved += 1
        if moved < len(x) // 500:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network with one hidden layer; ``share`` is the expected share of neighbours to be covered."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    share: float

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Expected share of a vector's neighbours in each part."""
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        scores = hidden @ self.w2 + self.b2
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).argmax(1)

    def routes(self, x: np.ndarray, share: float | None = None) -> np.ndarray:
        """Which parts each query visits: its most probable ones up to the share."""
        p = self.shares(x)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, 1), 1) - np.take_along_axis(p, order, 1)
        visit = np.zeros(p.shape, bool)
        np.put_along_axis(visit, order, before < (self.share if share is None else share), 1)
        return visit


def train_router(x: np.ndarray, wanted: np.ndarray, seed: int = 3) -> Router:
    """Fit the network to the spread of each vector's neighbours over the parts, by Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, n_parts = (x - mean) / scale, wanted.shape[1]
    weights = [
        rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, n_parts)), np.zeros(n_parts),
    ]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS if n_parts > 1 else 0):
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // BATCH)):
            w1, b1, w2, b2 = weights
            hidden = np.maximum(z[rows] @ w1 + b1, 0)
            scores = hidden @ w2 + b2
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            slope = (p - wanted[rows]) / len(rows)
            back = (slope @ w2.T) * (hidden > 0)
            step += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(0), hidden.T @ slope, slope.sum(0))):
                g = g + 1e-4 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                weights[i] = weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *weights, share=1.0)


def _calibrated(router: Router, x: np.ndarray, near: np.ndarray, aimed: float) -> Router:
    """The smallest share with which the kept-out vectors find enough of their neighbours."""
    place = router.place(x[1])
    for share in np.linspace(0.05, 1.0, 39):
        visit = router.routes(x[0], share)
        found = np.take_along_axis(visit, place[near], 1).mean() if near.size else 1.0
        if found >= aimed:
            return Router(**{**router.__dict__, "share": float(share)})
    return Router(**{**router.__dict__, "share": 2.0})


@dataclass(frozen=True)
class Index:
    router: Router
    size: int  # components of a vector
    rows: DataFrame  # vec_key, vec, part


def fit_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", max_fitted: int = MAX_FITTED, nearest: int = NEAREST) -> Index | None:
    """Learn parts and router from a bounded sample, then place every usable row. None if there is no usable row.

    Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do rows without a key or of another length than most.
    """
    require(vectors, key, vector)
    scratch = Scratch(vectors.sparkSession, "ann")
    slim = vectors.select(F.col(key).cast("bigint").alias("vec_key"), F.col(vector).cast("array<double>").alias("vec"))
    slim = slim.filter("vec_key IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")

    def clean(frames):
        for frame in frames:
            frame = frame[usable(frame["vec"])]
            yield frame.assign(size=[len(v) for v in frame["vec"]])

    good = scratch.store(slim.mapInPandas(clean, "vec_key bigint, vec array<double>, size int"), "good")
    sizes = good.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    size, n = sizes["size"], sizes["count"]
    good = good.filter(F.col("size") == size).drop("size")
    sample = np.array(bounded_sample(good, "vec_key", max_fitted, 9).select("vec").toPandas()["vec"].tolist()).reshape(-1, size)
    n_parts = int(np.clip(round(np.sqrt(n) * PARTS_PER_ROOT), 1, min(MOST_PARTS, max(1, len(sample) // 8))))
    held = np.random.default_rng(1).random(len(sample)) < HELD_OUT
    train, test = sample[~held], sample[held]
    if not len(train):
        train = sample
    graph = neighbours(train, train, nearest, np.arange(len(train)))
    part = balanced_parts(train, graph, n_parts)
    wanted = np.zeros((len(train), n_parts))
    if graph.shape[1]:
        np.add.at(wanted, (np.repeat(np.arange(len(train)), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
    wanted[np.arange(len(train)), part] += 0.25  # a vector's own part counts a little, so that it is placed where it lies
    router = train_router(train, wanted / wanted.sum(1, keepdims=True))
    router = _calibrated(router, (test, train), neighbours(train, test, nearest), AIMED_RECALL)

    def place(frames):
        for frame in frames:
            yield frame.assign(part=router.place(np.array(frame["vec"].tolist())).astype(np.int32) if len(frame) else np.zeros(0, np.int32))

    rows = scratch.store(good.mapInPandas(place, "vec_key bigint, vec array<double>, part int"), "rows")
    return Index(router, size, rows)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids, in order."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search(index: Index, queries: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows found, its own row left out.

    ``queries`` has vec_key and vec, of the index's kind. A query and a row of
    the same key are the same vector. Equal scores go to the smaller key.
    """
    counts = {r["part"]: r["count"] for r in index.rows.groupBy("part").count().collect()}  # one row per part
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // QUERY_CHUNK))
    shards = {p: max(1, -(-n // BLOCK)) for p, n in counts.items()}
    spark = queries.sparkSession
    cut = spark.createDataFrame([(int(p), s) for p, s in shards.items()], "part int, shards int")
    router = index.router

    def routed(frames):
        for frame in frames:
            if not len(frame):
                continue
            q, p = np.nonzero(router.routes(np.array(frame["vec"].tolist())))
            yield pd.DataFrame({"q_key": frame["vec_key"].to_numpy()[q], "q_vec": frame["vec"].to_numpy()[q], "part": p.astype(np.int32)})

    asked = queries.select("vec_key", "vec").mapInPandas(routed, "q_key bigint, q_vec array<double>, part int")
    # one row per part: bounded by ``MOST_PARTS``
    asked = asked.join(F.broadcast(cut), "part").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    asked = asked.select("q_key", "q_vec", F.col("part").alias("q_part"), F.col("shard").alias("q_shard"), F.pmod(F.xxhash64("q_key"), F.lit(chunks)).cast("int").alias("q_chunk"))
    rows = index.rows.join(F.broadcast(cut), "part").withColumn("shard", F.pmod(F.xxhash64("vec_key"), F.col("shards")).cast("int"))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).drop("shards")

    def ranked(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"q_key": [], "v_key": [], "score": []}
        if len(a) and len(b):
            x, ids = np.array(b["vec"].tolist()), b["vec_key"].to_numpy()
            for at in range(0, len(a), 256):
                some = a.iloc[at : at + 256]
                scores = np.array(some["q_vec"].tolist()) @ x.T
                for q, line in zip(some["q_key"], scores, strict=True):
                    line = np.where(ids == q, -np.inf, line)
                    best = top_rows(line, ids, nearest)
                    best = best[line[best] > -np.inf]
                    out["q_key"].append(np.full(len(best), q))
                    out["v_key"].append(ids[best])
                    out["score"].append(line[best])
        kinds = {"q_key": np.int64, "v_key": np.int64, "score": float}
        return pd.DataFrame({k: np.concatenate(v).astype(kinds[k]) if v else np.zeros(0, kinds[k]) for k, v in out.items()})

    found = asked.groupBy("q_part", "q_shard", "q_chunk").cogroup(rows.groupBy("part", "shard", "chunk")).applyInPandas(ranked, "q_key bigint, v_key bigint, score double")
    best = Window.partitionBy("q_key").orderBy(F.desc("score"), "v_key")
    ranks = found.dropDuplicates(["q_key", "v_key"]).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest)
    return ranks.select(F.col("q_key").alias("query_id"), "rank", F.col("v_key").alias("vec_id"), "score")
