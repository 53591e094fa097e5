"""Connected components of an edge table, by spreading the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its smallest node.

    Each round a node takes the smallest label around it and then that label's
    own label, so long chains shrink by halves. It ends when no label moves.
    Only aggregates and joins on nodes are used: a node with very many edges is
    combined map-side or split by adaptive execution. No edges, no rows.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = scratch.store(both, f"{name}_edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label"))
    labels, before, turn = scratch.store(labels, f"{name}_0"), None, 0
    while True:
        # labels only ever fall, so an unchanged sum means that none did
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now is None or now == before:
            break
        before, turn = now, turn + 1
        around = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(around, labels["node"] == around["u"]).select("node", F.least("label", "near").alias("label"))
        lower = scratch.store(lower, f"{name}_{turn}_low")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = scratch.store(lower.join(jump, "label").select("node", F.col("next").alias("label")), f"{name}_{turn}")
        scratch.drop(f"{name}_{turn}_low", f"{name}_{turn - 1}")
    return labels.select("node", F.col("label").alias("component"))
