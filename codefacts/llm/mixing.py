"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed once per cell (source x language x topic); raking then
works on the cell table alone. Each round scales the cells so that the source,
the language and the topic marginal in turn meet their targets. The fitted
cells give every document an inclusion probability, and a hash of its id
decides. Everything here is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch, free_name, require

#: Rounds of raking; each meets all three marginals once.
ROUNDS = 12
#: Share of all tokens that the sample is to hold.
KEEP_SHARE = 0.8
#: Without a stated target a marginal's share is its own share to this power: rare groups gain, common ones lose.
FLATTEN = 0.7
#: Topics are this many classes of documents by their key word.
TOPICS = 8
#: Multipliers tried for the sampling rate, twice, the second time between the best two.
GRID = 64

WORD_BREAK = "[ \\t\\n\\r]+"
KEY_LENGTH = 8


def words(text: Column) -> Column:
    """The words between blanks, tabs and line ends; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def key_word_topic(word_list: Column, topics: int = TOPICS) -> Column:
    """Class of a document by its key word, the first of its long words in order of code points.

    Documents that share most of their words mostly share the key word, so
    near copies fall into one topic. Texts without a long word are topic 0.
    """
    key = F.array_min(F.filter(word_list, lambda w: F.length(w) >= KEY_LENGTH))
    return F.when(key.isNull(), F.lit(0)).otherwise(F.pmod(hex_number(F.md5(key), 8), F.lit(topics))).cast("bigint")


def uniform(key: Column, seed: str) -> Column:
    """A repeatable number in [0, 1) for a key."""
    return hex_number(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))), 8) / F.lit(float(16**8))


def _targets(cells: DataFrame, name: str, wanted: Mapping[object, float] | None, flatten: float) -> DataFrame:
    """Target tokens of each value of a marginal; they add up to all tokens."""
    own = cells.groupBy(name).agg(F.sum("tokens").alias("own"))
    if wanted is None:
        weighed = own.select(name, "own", F.pow("own", flatten).alias("pull"))
    else:
        pulls = reduce(lambda c, kv: c.when(F.col(name).eqNullSafe(F.lit(kv[0])), F.lit(float(kv[1]))), wanted.items(), F)
        weighed = own.select(name, "own", (pulls.otherwise(0.0) if wanted else F.lit(0.0)).alias("pull"))
    total = weighed.agg(F.sum("own").alias("own"), F.sum("pull").alias("pull")).first()
    scale = total["own"] / total["pull"] if total["pull"] else 0.0
    return weighed.select(name, (F.col("pull") * F.lit(float(scale))).alias(f"target_{name}"))


def rake(cells: DataFrame, marginals: Sequence[str], targets: Mapping[str, Mapping[object, float] | None], rounds: int, flatten: float, scratch: Scratch) -> DataFrame:
    """``cells`` (marginals, tokens) with ``mass``, the fitted tokens of each cell.

    A marginal that the data cannot meet (all its cells empty) stays as it is;
    values without tokens have no mass. The lineage is cut after each round, so
    a plan never holds more than one.
    """
    fitted = cells.withColumn("mass", F.col("tokens").cast("double"))
    for name in marginals:
        fitted = fitted.join(_targets(cells, name, targets.get(name), flatten).withColumnRenamed(name, "value"), F.col(name).eqNullSafe(F.col("value")), "left").drop("value")
    fitted = scratch.store(fitted, "round_0")
    for i in range(1, rounds + 1):
        for name in marginals:
            sums = fitted.groupBy(F.col(name).alias("value")).agg(F.sum("mass").alias("now"))
            scaled = F.when(F.col("now") > 0, F.col("mass") * F.col(f"target_{name}") / F.col("now")).otherwise(0.0)
            fitted = fitted.join(sums, F.col(name).eqNullSafe(F.col("value")), "left").withColumn("mass", scaled).drop("value", "now")
        fitted = scratch.store(fitted, f"round_{i}")
        scratch.drop(f"round_{i - 1}")
    return fitted


def _rate(fitted: DataFrame, keep_share: float) -> float:
    """Largest tried multiplier with which the expected kept tokens stay within the budget.

    Two aggregations over the cells, each for a whole grid of multipliers; the
    second grid lies between the best two of the first.
    """
    grow = F.col("mass") / F.col("tokens")
    filled = fitted.filter("tokens > 0")
    edge = filled.agg(F.sum("tokens").alias("n"), F.min(F.when(grow > 0, grow)).alias("low"), F.max(grow).alias("high")).first()
    if not edge["n"] or not edge["high"]:
        return 0.0
    budget = keep_share * edge["n"]
    low, high = 0.0, 1.0 / edge["low"]
    steps = [high * 2.0 ** (-i / 2) for i in range(GRID)]
    for _ in range(2):
        row = filled.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), grow * F.lit(s))).alias(f"s{i}") for i, s in enumerate(steps)]).first()
        fits = [s for i, s in enumerate(steps) if row[f"s{i}"] <= budget * (1 + 1e-9)]
        low = max(fits, default=0.0)
        above = min((s for s in steps if s > low), default=low)
        steps = [low + (above - low) * i / GRID for i in range(GRID + 1)]
    return low


def mix(
    docs: DataFrame,
    marginals: Mapping[str, Column] | None = None,
    targets: Mapping[str, Mapping[object, float] | None] | None = None,
    text: str = "text",
    key: str = "doc_id",
    keep_share: float = KEEP_SHARE,
    rounds: int = ROUNDS,
    flatten: float = FLATTEN,
    seed: str = ":mix",
) -> DataFrame:
    """``docs`` with ``mix_<marginal>`` columns, ``n_tokens``, ``keep_probability`` and ``kept``.

    ``marginals`` names the columns to rake (default: source, lang and the key
    word topic); ``targets`` gives a share per value, values not listed get
    none; a marginal without a target is flattened. Null is a value of its own.
    Tokens are words. A document without words has probability 1 if its cell
    holds no token at all, else its cell's. Repeated ids share one decision.
    Probabilities end at 1 and are not raked again: where a cell's mass asks for
    more than its tokens, its marginals fall short of the targets.
    An empty table gives an empty result.
    """
    require(docs, key, text)
    scratch = Scratch(docs.sparkSession, "mixing")
    word_list = free_name(docs.columns, "mix_words")
    if marginals is None:
        marginals = {"source": F.col("source"), "lang": F.col("lang"), "topic": key_word_topic(F.col(word_list))}
    names = [f"mix_{n}" for n in marginals]
    taken = [c for c in docs.columns if c.lower() in {n.lower() for n in [*names, "n_tokens", "keep_probability", "kept"]}]
    if taken:
        raise ValueError(f"columns of these names exist already: {', '.join(taken)}")
    placed = docs.withColumn(word_list, words(F.col(text)))
    placed = placed.withColumns({f"mix_{n}": c for n, c in marginals.items()} | {"n_tokens": F.size(word_list).cast("bigint")}).drop(word_list)
    cells = scratch.store(placed.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = rake(cells, names, {f"mix_{k}": v for k, v in (targets or {}).items()}, rounds, flatten, scratch)
    rate = _rate(fitted, keep_share)
    calibrated = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("mass") / F.col("tokens") * F.lit(rate))).otherwise(1.0)
    cell_rates = scratch.store(fitted.select(*[F.col(n).alias(f"{n}_cell") for n in names], calibrated.alias("keep_probability")), "rates")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_cell")) for n in names])
    out = placed.join(cell_rates, same, "left").drop(*[f"{n}_cell" for n in names])
    return out.withColumn("kept", uniform(F.col(key), seed) < F.col("keep_probability"))


def sample_mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns of ``docs``, whatever their names."""
    own = {"n_tokens", "keep_probability", "kept"} | {f"mix_{n}" for n in options.get("marginals") or ("source", "lang", "topic")}
    aside = {c: f"_aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in {o.lower() for o in own}}
    kept = mix(docs.withColumnsRenamed(aside), **options).filter("kept")
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
