"""Quality by hierarchical empirical Bayes over documents, hosts and paths.

A logistic model over byte statistics of the whole text gives each document its
own evidence. Hosts, and the paths below a host, get a posterior share of good
documents: a sparse host is shrunk to the global share and a sparse path to its
host, by strengths estimated from how much the groups really differ. The
document's log-odds are then moved from the global prior to that of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import SPACE, Scratch, bounded_sample, free_name, require, sums_per_row, text_bytes, with_fields
from codefacts.llm.logistic import Logistic, fit

#: The document model sees at most so many labelled rows, chosen by a hash of their id.
MAX_LABELLED = 20_000
#: A document is kept when its posterior probability of being good reaches this.
KEEP_FROM = 0.5
#: Bounds of the shrinkage strength, in documents.
STRENGTH = (2.0, 10_000.0)

FEATURES = (
    "upper", "digit", "symbol", "mark", "pipe", "newline", "non_ascii", "word_length", "long_word", "log_size",
    "symbol_end", "line_repeats",
)

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_HIGH = _CODES >= 128
_MARK = np.isin(_CODES, [33, 63])
_PIPE = _CODES == 124
_SYMBOL = (_CODES > 32) & (_CODES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~np.isin(_CODES, [33, 63, 124, 44, 46, 39, 34, 45])


def features_of(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text; a null or empty text has zeros."""
    data, starts = text_bytes(text)
    size = np.diff(starts).astype(float)
    per = lambda mask: sums_per_row(mask[data], starts)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    begins = ~space & (before | edge[:-1])
    after = np.concatenate((space[1:], [True])) if len(data) else space
    ends = ~space & (after | edge[1:])
    words = np.maximum(sums_per_row(begins, starts), 1)
    letters = np.maximum(per(_UPPER) + per(_LOWER) + per(_HIGH), 1)
    solid = np.maximum(sums_per_row(~space, starts), 1)
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    long_word = np.zeros(len(data), bool)
    long_word[first[last - first >= 14]] = True
    some = np.maximum(size, 1)
    repeats = np.zeros(len(size))
    lines = np.maximum(per(_CODES == 10), 0) + 1
    for i in np.flatnonzero(lines > 3):
        parts = data[starts[i] : starts[i + 1]].tobytes().split(b"\n")
        repeats[i] = 1 - len(set(parts)) / len(parts)
    return np.column_stack(
        [
            per(_UPPER) / letters, per(_DIGIT) / solid, per(_SYMBOL) / solid, per(_MARK) / solid, per(_PIPE) / solid,
            per(_CODES == 10) / some, per(_HIGH) / some, solid / words / 10, sums_per_row(long_word, starts) / words,
            np.log1p(size) / 10, sums_per_row(ends & (_SYMBOL | _MARK)[data], starts) / words, repeats,
        ]
    )


def _evidence(df: DataFrame, text: str, added: str, model: Logistic | None = None) -> DataFrame:
    """``df`` with the features of its text, or with the model's logit, in column ``added``."""
    schema = with_fields(df, **{added: "array<double>" if model is None else "double"})

    def run(batches):
        for batch in batches:
            found = features_of(batch.column(batch.schema.get_field_index(text)))
            new = pa.array(list(found), pa.list_(pa.float64())) if model is None else pa.array(model.logits(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, added])

    return df.mapInArrow(run, schema)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass(frozen=True)
class Prior:
    """Global share of good documents, and how many documents it weighs against a host's and a host's against a path's."""

    share: float
    host_strength: float
    path_strength: float


@dataclass(frozen=True)
class QualityModel:
    document: Logistic
    prior: Prior
    groups: DataFrame  # host, path (null-safe keys), posterior
    host: Column
    path: Column
    threshold: float = KEEP_FROM


def _strength(stats: DataFrame, share: float) -> float:
    """Method of moments: what a beta prior around ``share`` must weigh for the spread that the groups show."""
    usable = stats.filter("n >= 2")
    row = usable.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("m"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    low, high = STRENGTH
    if not row["k"] or row["k"] < 2:
        return high
    noise = max(share * (1 - share), 1e-6)
    size = row["n"] - row["nn"] / row["n"]
    between = (row["spread"] - (row["k"] - 1) * noise) / max(size, 1e-9)
    return float(np.clip(noise / between - 1, low, high)) if between > 0 else high


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    text: str = "text",
    key: str = "doc_id",
    label: str = "quality",
    max_labelled: int = MAX_LABELLED,
    threshold: float = KEEP_FROM,
) -> QualityModel:
    """Fit the document model and the posteriors of hosts and paths.

    ``host`` and ``path`` are columns of ``docs`` (default: ``source`` and
    ``lang``); null is a group of its own. Only rows of ``labels`` whose label
    is 0 or 1 count; a repeated key counts as often as it is listed. The
    document model is fitted on at most ``max_labelled`` of them; the groups'
    shares use every document. Without labels every posterior is one half, and
    with an empty table there are no groups.
    """
    require(docs, key, text)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select(F.col(key).alias("doc_key"), host.alias("host"), path.alias("path"), F.col(text).alias("body"))
    features = scratch.store(_evidence(slim, "body", "features").drop("body"), "features")
    marked = labels.select(F.col(key).alias("doc_key"), F.col(label).alias("label")).filter(F.col("label").isin(0, 1))
    known = scratch.store(features.select("doc_key", "features").join(marked, "doc_key"), "labelled")
    sample = bounded_sample(known, "doc_key", max_labelled, 7).toPandas()
    x = np.array(sample["features"].tolist()) if len(sample) else np.zeros((0, len(FEATURES)))
    model = fit(x, sample["label"].to_numpy(float))
    weights = model.weights / model.scale
    offset = model.bias - float(weights @ model.mean)
    terms = F.lit(offset)
    for i, w in enumerate(weights):
        terms = terms + F.col("features")[i] * F.lit(float(w))
    good = 1 / (1 + F.exp(-F.greatest(F.least(terms, F.lit(40.0)), F.lit(-40.0))))
    paths = scratch.store(features.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("s")), "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    share = float(np.clip((total["s"] + 0.5) / (total["n"] + 1), 1e-4, 1 - 1e-4)) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    host_strength = _strength(hosts.withColumn("m", F.lit(share)), share)
    shrunk = hosts.select(
        F.col("host").alias("of_host"), ((F.col("s") + host_strength * share) / (F.col("n") + host_strength)).alias("m")
    )
    joined = paths.join(shrunk, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    path_strength = _strength(joined, share)
    posterior = ((F.col("s") + path_strength * F.col("m")) / (F.col("n") + path_strength)).alias("posterior")
    groups = scratch.store(joined.select("host", "path", F.col("n").alias("n_docs"), F.col("m").alias("host_posterior"), posterior), "groups")
    return QualityModel(model, Prior(share, host_strength, path_strength), groups, host, path, threshold)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "quality_score", keep: str = "quality_keep") -> DataFrame:
    """``docs`` with the posterior probability of being good and the decision.

    Every row is returned once, repeated rows as often as they occur; null and
    empty texts are scored by their zero features. The text is read where it
    lies: only the groups' posteriors are joined to it.
    """
    own, host, path, prior = (free_name(docs.columns, n) for n in ("q_logit", "q_host", "q_path", "q_posterior"))
    placed = _evidence(docs, text, own, model.document).withColumns({host: model.host, path: model.path})
    groups = model.groups.select(F.col("host").alias(f"{host}_g"), F.col("path").alias(f"{path}_g"), F.col("posterior").alias(prior))
    same = F.col(host).eqNullSafe(F.col(f"{host}_g")) & F.col(path).eqNullSafe(F.col(f"{path}_g"))
    moved = F.col(own) + logit(F.coalesce(F.col(prior), F.lit(model.prior.share))) - logit(F.lit(model.prior.share))
    out = placed.join(groups, same, "left").withColumn(score, 1 / (1 + F.exp(-moved)))
    return out.withColumn(keep, F.col(score) >= model.threshold).drop(own, host, path, f"{host}_g", f"{path}_g", prior)


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with the columns of ``docs``."""
    score, keep = free_name(docs.columns, "quality_score"), free_name(docs.columns, "quality_keep")
    return score_quality(docs, model, text, score, keep).filter(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])
