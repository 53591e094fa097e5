"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the principal axes of the
table, so that the leading coordinates hold most of what tells them apart.
Within a label they are sorted along the first axis and cut into tiles. Two
tiles are compared only if their ranges along that axis are near enough for any
pair to reach the threshold. In a pair of tiles the products of the leading
coordinates are added up block by block; what the remaining coordinates can
still add is bounded by the product of the two suffix norms, and pairs that can
no longer reach the threshold are left. What remains is decided by the exact
cosine of the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codefacts.llm.common import Scratch, bounded_sample, require
from codefacts.llm.components import components

#: Cosine of linked vectors.
THRESHOLD = 0.93
#: Vectors of a tile.
TILE = 1024
#: Coordinates after which a pair's bound is looked at again.
STEPS = (8, 16, 32)
#: The rotation is fitted on at most so many vectors, chosen by a hash; it sets the order only.
MAX_FITTED = 20_000
#: Allowance for rounding in the bounds.
SLACK = 1e-9


@dataclass(frozen=True)
class Rotation:
    axes: np.ndarray


def usable(vectors: pd.Series) -> np.ndarray:
    """Which vectors take part: not null, not empty, all components finite, not all zero."""

    def good(v) -> bool:
        if v is None or not len(v):
            return False
        v = np.array([np.nan if c is None else c for c in v], float)
        return bool(np.isfinite(v).all() and v.any())

    return np.fromiter((good(v) for v in vectors), bool, len(vectors))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows of length one in double precision, scaled first so that no square overflows."""
    x = np.array([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _prepared(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """vec_key, lab, size, vec (finite, not zero) and its digest of every row; the last three null where a row cannot link."""

    def run(frames):
        for frame in frames:
            good = usable(frame["vec"]) & frame["vec_key"].notna().to_numpy() & frame["lab"].notna().to_numpy()
            plain = [np.asarray(v, float) + 0.0 if ok else None for v, ok in zip(frame["vec"], good, strict=True)]  # minus zero becomes zero
            held = {
                "size": pd.array([None if v is None else len(v) for v in plain], "Int32"), "vec": pd.Series(plain, index=frame.index, dtype=object),
                "digest": pd.Series([None if v is None else sha256(v.tobytes()).digest() for v in plain], index=frame.index, dtype=object),
            }
            yield frame.assign(vec_key=frame["vec_key"].astype("Int64"), **held)[["vec_key", "lab", "size", "vec", "digest"]]

    slim = vectors.select(F.col(key).cast("bigint").alias("vec_key"), F.col(label).cast("string").alias("lab"), F.col(vector).cast("array<double>").alias("vec"))
    return slim.mapInPandas(run, "vec_key bigint, lab string, size int, vec array<double>, digest binary")


def fit_rotation(classes: DataFrame, max_fitted: int = MAX_FITTED) -> dict[int, Rotation]:
    """Principal axes per vector size, from a bounded sample of the distinct vectors."""
    sample = bounded_sample(classes, "vec_key", max_fitted, 5).select("size", "vec").toPandas()
    out = {}
    for size, rows in sample.groupby("size"):
        unit = unit_rows(rows["vec"])
        values, axes = np.linalg.eigh(unit.T @ unit)
        out[int(size)] = Rotation(axes[:, np.argsort(-values)])
    return out


def _turned(classes: DataFrame, rotations: dict[int, Rotation]) -> DataFrame:
    def run(frames):
        for frame in frames:
            for size, rows in frame.groupby("size"):
                unit = unit_rows(rows["vec"])
                turned = unit @ rotations[size].axes if size in rotations else unit
                yield rows.assign(unit=list(unit), first=turned[:, 0])[["vec_key", "lab", "size", "first", "unit"]]

    schema = "vec_key bigint, lab string, size int, first double, unit array<double>"
    return classes.mapInPandas(run, schema)


def _row_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, block: int = 100_000) -> np.ndarray:
    """Products of rows ``a[i]`` and ``b[j]``, some at a time."""
    parts = [np.einsum("ij,ij->i", a[i[k : k + block]], b[j[k : k + block]]) for k in range(0, len(i), block)]
    return np.concatenate(parts) if parts else np.zeros(0)


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two turned tiles whose product may reach the threshold, coordinates added up in steps."""
    cuts = [0, *[s for s in STEPS if s < a.shape[1]], a.shape[1]]
    tail = lambda x, at: np.sqrt(np.maximum((x[:, at:] ** 2).sum(1), 0))
    total = a[:, : cuts[1]] @ b[:, : cuts[1]].T
    bound = np.outer(tail(a, cuts[1]), tail(b, cuts[1]))
    bound += total
    i, j = np.nonzero(bound >= threshold - SLACK)
    total = total[i, j]
    for low, high in zip(cuts[1:-1], cuts[2:], strict=True):
        if not len(i):
            break
        total = total + _row_products(a[:, low:high], b[:, low:high], i, j)
        alive = total + tail(a, high)[i] * tail(b, high)[j] >= threshold - SLACK
        i, j, total = i[alive], j[alive], total[alive]
    return i, j


def _compared(a: pd.DataFrame, b: pd.DataFrame, axes: np.ndarray | None, same: bool, threshold: float) -> pd.DataFrame:
    found = {"a": [], "b": [], "cosine": []}
    ua, ub = np.array(a["unit"].tolist()), np.array(b["unit"].tolist())
    i, j = near_pairs(*((ua, ub) if axes is None else (ua @ axes, ub @ axes)), threshold)
    if same:
        i, j = i[i < j], j[i < j]
    for at in range(0, len(i), 200_000):
        x, y = i[at : at + 200_000], j[at : at + 200_000]
        cosine = np.einsum("ij,ij->i", ua[x], ub[y])
        hit = cosine >= threshold
        found["a"].append(a["vec_key"].to_numpy()[x[hit]])
        found["b"].append(b["vec_key"].to_numpy()[y[hit]])
        found["cosine"].append(cosine[hit])
    empty = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cosine": np.zeros(0)}
    return pd.DataFrame({k: np.concatenate(v) if v else empty[k] for k, v in found.items()})


def _tiles(turned: DataFrame, tile: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Vectors with their tile, and (lab, size, tile, low, high) of the tiles: runs along the first axis.

    Each label is cut into ranges of the first axis by its own histogram, and
    a range of more than ``tile`` vectors into several by a hash, so neither a
    window over a whole label nor a large tile arises.
    """
    step = 1 / 64
    binned = turned.withColumn("bin", F.floor(F.col("first") / step).cast("int"))
    counts = binned.groupBy("lab", "size", "bin").agg(F.count("*").alias("n"))
    cuts = counts.withColumn("cuts", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    over = Window.partitionBy("lab", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.withColumn("base", F.coalesce(F.sum("cuts").over(over), F.lit(0)))
    placed = binned.join(cuts, ["lab", "size", "bin"]).withColumn("tile", (F.col("base") + F.pmod(F.xxhash64("vec_key"), F.col("cuts"))).cast("int"))
    placed = scratch.store(placed.drop("bin", "cuts", "base"), "placed")
    return placed, placed.groupBy("lab", "size", "tile").agg(F.min("first").alias("low"), F.max("first").alias("high"))


def near_duplicate_links(classes: DataFrame, threshold: float, tile: int, scratch: Scratch) -> DataFrame:
    """(a, b, cosine) of distinct vectors of one label whose cosine reaches the threshold."""
    rotations = fit_rotation(classes)
    turned = _turned(classes, rotations)
    placed, tiles = _tiles(turned, tile, scratch)
    tiles = scratch.store(tiles, "tiles")
    # |x - y|^2 = 2 - 2 cos, and no coordinate differs by more than |x - y|
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + SLACK
    other = tiles.select("lab", "size", F.col("tile").alias("other"), F.col("low").alias("olow"), F.col("high").alias("ohigh"))
    near = (F.col("other") >= F.col("tile")) & (F.col("olow") - F.col("high") <= reach) & (F.col("low") - F.col("ohigh") <= reach)
    wanted = scratch.store(tiles.join(other, ["lab", "size"]).filter(near).select("lab", "size", "tile", "other"), "tile_pairs")
    columns = ["vec_key", "unit"]
    left = wanted.join(placed, ["lab", "size", "tile"]).select("lab", "size", "tile", "other", *columns)
    right = wanted.join(placed.withColumnRenamed("tile", "other"), ["lab", "size", "other"]).select("lab", "size", "tile", "other", *columns)

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        same = len(a) > 0 and a["tile"].iloc[0] == a["other"].iloc[0]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cosine": np.zeros(0)})
        rotation = rotations.get(int(a["size"].iloc[0]))
        b = b.rename(columns={"r_vec_key": "vec_key", "r_unit": "unit"})
        return _compared(a, b, rotation.axes if rotation else None, same, threshold)

    keys = ["lab", "size", "tile", "other"]
    right = right.toDF(*[f"r_{c}" for c in right.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"r_{k}" for k in keys])).applyInPandas(run, "a bigint, b bigint, cosine double")


@dataclass(frozen=True)
class Deduplicated:
    """``vectors``: vec_key, n_links, component, kept. ``links``: a, b, cosine between class representatives."""

    vectors: DataFrame
    links: DataFrame


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE
) -> Deduplicated:
    """Links of all vectors of equal label with a cosine of ``threshold`` or more, counted per vector, and components.

    Equal vectors of a label are one class: they link with each other and
    share the links of their representative, the smallest key. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without
    a label and vectors of another length link with nothing and are their own
    component. Every row has a result of its own, repeated rows as often as they
    occur; rows of one key count as different vectors, also in several labels.
    Rows without a key link with nothing. An empty table gives an empty result.
    """
    require(vectors, key, label, vector)
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    scratch = Scratch(vectors.sparkSession, "embed-dedup")
    hashed = scratch.store(_prepared(vectors, key, label, vector), "hashed")
    classes = hashed.filter("digest IS NOT NULL").groupBy("lab", "digest")
    classes = classes.agg(F.min("vec_key").alias("smallest"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("vec").alias("vec"))
    # a number of its own for each class: one key may stand in several labels
    classes = scratch.store(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    compared = classes.select(F.col("node").alias("vec_key"), "lab", "size", "vec")
    links = scratch.store(near_duplicate_links(compared, threshold, tile, scratch), "links")
    scratch.drop("placed")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("node").alias("b"), F.col("copies").alias("n"))
    outside = both.join(sizes, "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    grouped = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "linked").withColumnRenamed("component", "root")
    placed = classes.drop("vec").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = placed.groupBy("root").agg(F.min("smallest").alias("component"))
    found = placed.join(outside, "node", "left").join(roots, "root")
    found = found.select("lab", "digest", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), "component")
    # rows that cannot link have no digest and meet nothing
    able = hashed.filter("digest IS NOT NULL").select("vec_key", "lab", "digest").join(found, ["lab", "digest"]).select("vec_key", "n_links", "component")
    alone = hashed.filter("digest IS NULL").select("vec_key", F.lit(0).alias("n_links"), F.col("vec_key").alias("component"))
    out = able.unionByName(alone).select("vec_key", F.col("n_links").cast("bigint").alias("n_links"), "component")
    named = links
    for end in ("a", "b"):
        named = named.join(classes.select(F.col("node").alias(end), F.col("smallest").alias(f"key_{end}")), end)
    named = named.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "cosine")
    return Deduplicated(out.withColumn("kept", F.col("vec_key").eqNullSafe(F.col("component"))), named)
