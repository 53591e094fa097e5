"""Exact integer k-means whose assignments are found by Orchard's search.

Every centroid has a list of the other centroids, nearest first. A vector starts
at some centroid and walks that centroid's list; when it meets a closer one it
jumps to that one's list. Centroids met before are marked and not measured
again. By the triangle inequality nothing nearer can follow once an entry lies
strictly beyond twice the present distance, so the walk stops there. All
distances are squared integers: the stop, ties and means are exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, require

#: Centroids, rounds, components of a vector, and units that a component of 1.0 counts.
CENTROIDS, ROUNDS, SIZE, SCALE = 8, 10, 64, 1024
#: Prefix of the names whose hashes choose the first centroids.
SALT = "3"


def largest_unit(size: int) -> int:
    """Components of smaller magnitude than this keep four times a squared distance within 64 bits."""
    return isqrt((1 << 63) // (16 * size)) - 1


def _quantised(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """vec_key and units (array<int>) of the rows that take part."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    most = largest_unit(size)

    def unit(x: Column) -> Column:
        scaled = F.floor(x * scale)
        return F.when(F.abs(x) < most / scale, scaled).otherwise(F.raise_error(F.lit(f"a component of {most // scale} or more is too large for exact distances"))).cast("int")

    slim = vectors.select(F.col(key).cast("bigint").alias("vec_key"), F.col(vector).cast("array<double>").alias("vec"))
    return slim.filter(vec.isNotNull() & (F.size("vec") == size)).filter(finite).select("vec_key", F.transform("vec", unit).alias("units"))


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances between centroids, and for each the others in ascending order of them."""
    k = len(centroids)
    gaps = np.array([((centroids - c) ** 2).sum(1) for c in centroids])
    order = np.argsort(gaps, axis=1, kind="stable")
    return gaps, order[order != np.arange(k)[:, None]].reshape(k, k - 1)


def search(units: np.ndarray, centroids: np.ndarray, gaps: np.ndarray, lists: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance; among equals the smaller number."""
    n, k = len(units), len(centroids)
    now = start.astype(np.int64)
    best = ((units - centroids[now]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), now] = True
    place = np.zeros(n, np.int64)
    walking = np.arange(n) if k > 1 else np.zeros(0, np.int64)
    while len(walking):
        here = lists[now[walking], place[walking]]
        within = gaps[now[walking], here] <= 4 * best[walking]
        walking, here = walking[within], here[within]
        place[walking] += 1
        fresh = ~seen[walking, here]
        rows, met = walking[fresh], here[fresh]
        seen[rows, met] = True
        distance = ((units[rows] - centroids[met]) ** 2).sum(1)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (met < now[rows]))
        rows = rows[closer]
        now[rows], best[rows], place[rows] = met[closer], distance[closer], 0
        walking = walking[place[walking] < k - 1]
    return now, best


def _rows(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


def _assigned(table: DataFrame, centroids: np.ndarray, keep_units: bool) -> DataFrame:
    """vec_key, cluster and distance of every row; with ``keep_units`` units too. A walk starts at the row's column ``cluster``, if it has one."""
    size = centroids.shape[1]
    schema = "vec_key bigint, cluster int, distance bigint" + (", units array<int>" if keep_units else "")

    def run(batches):
        gaps, lists = neighbour_lists(centroids)
        for batch in batches:
            known = batch.schema.get_field_index("cluster")
            start = batch.column(known).to_numpy() if known >= 0 else np.zeros(len(batch), np.int64)
            now, best = search(_rows(batch, "units", size), centroids, gaps, lists, start)
            columns = [batch.column(0), pa.array(now, pa.int32()), pa.array(best)]
            names = ["vec_key", "cluster", "distance"]
            if keep_units:
                columns, names = [*columns, batch.column(batch.schema.get_field_index("units"))], [*names, "units"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return table.mapInArrow(run, schema)


def _sums(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and sums of the rows nearest to each centroid: one row per task and cluster."""
    k, size = centroids.shape

    def run(batches):
        gaps, lists = neighbour_lists(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for batch in batches:
            units = _rows(batch, "units", size)
            now, _ = search(units, centroids, gaps, lists, batch.column(batch.schema.get_field_index("cluster")).to_numpy())
            order = np.argsort(now, kind="stable")
            found, first, many = np.unique(now[order], return_index=True, return_counts=True)
            if len(found):
                total[found] += np.add.reduceat(units[order], first, axis=0)
                count[found] += many
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
        )

    return table.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")


def _means(parts: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floors of the means; a centroid without rows stays. At most one row per component comes to the driver."""
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    after = before.copy()
    for r in flat.groupBy("cluster", "at").agg(exact("n"), exact("part")).collect():
        after[r["cluster"], r["at"]] = int(r["part"]) // int(r["n"])
    return after


def first_centroids(table: DataFrame, k: int, salt: str, scratch: Scratch) -> np.ndarray:
    """Units of the ``k`` rows whose names ``salt:key`` have the smallest hashes, in that order; rows without a key come last."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_key").cast("string")).cast("binary"), 256)
    chosen = table.select(name.alias("name"), "units").orderBy(F.col("name").asc_nulls_last(), "units").limit(k)
    # written by an executor, so that not every task sends its k rows to the driver
    rows = scratch.store(chosen, "seeds").collect()
    return np.array([r["units"] for r in sorted(rows, key=lambda r: (r["name"] is None, r["name"] or "", r["units"]))], np.int64)


@dataclass(frozen=True)
class Clustered:
    """``vectors``: vec_key, cluster, distance. ``clusters``: cluster, cluster_inertia, centroid_sha256 of clusters with vectors. ``centroids``: rows of integers."""

    vectors: DataFrame
    clusters: DataFrame
    centroids: np.ndarray
    inertia: int


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT
) -> Clustered:
    """k-means of all vectors of exactly ``size`` components, none of them null or not finite; others have no row in the result.

    Components count floor(scale * x) units. Every round sends one row of sums
    per task and cluster. Rows that share a key are vectors of their own, and
    so are rows without a key, which are taken as first centroids only when
    there are no others. Fewer vectors than ``k`` give fewer centroids, an
    empty table an empty result. Components whose squares would not fit 64
    bits (65,536 and more, with the default size and scale) raise.
    """
    require(vectors, key, vector)
    if k < 1 or rounds < 0 or size < 1 or scale < 1:
        raise ValueError("k, size and scale must be positive, rounds not negative")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "orchard")
    table = scratch.store(_quantised(vectors, key, vector, size, scale), "quantised")
    centroids = first_centroids(table, k, salt, scratch)
    if len(centroids):
        # later walks start where the first one ended
        table = scratch.store(_assigned(table, centroids, keep_units=True), "started")
        for _ in range(rounds):
            centroids = _means(_sums(table, centroids), centroids)
        found = _assigned(table, centroids, keep_units=False)
    else:
        found = spark.createDataFrame([], "vec_key bigint, cluster int, distance bigint")
    found = scratch.store(found, "assigned")
    scratch.drop("quantised", "seeds", "started")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = lambda c: sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    clusters = spark.createDataFrame([(c, s, digest(c)) for c, s in sums.items()], "cluster int, cluster_inertia bigint, centroid_sha256 string")
    return Clustered(found, clusters, centroids, sum(sums.values()))
