"""From raw documents to packed training sequences: five operators in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet in the shared scratch folder and hands the
stage after it what was read back. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import jaccard, mixing, packing, quality, secrets
from codefacts.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says they are good."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one with the smallest id."""
    return jaccard.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and ``n_chars`` counted again where a text changed."""
    clean = secrets.redact_secrets(docs, secrets.fit_formats(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample drawn towards the source, language and topic targets; cells kept whole fall short of them (see ``mixing.mix``)."""
    return mixing.sample_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of at most 1024 tokens."""
    packed = packing.pack(docs)
    return packed.placed_tokens().select(
        F.col("doc_key").alias("doc_id"), "piece", "start", "length", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scan", redact),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fitted models and byte-pair encoding have no SQL form; no test covers ``run`` as a whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        done = scratch.store(stage(spark, docs, sf_dir), f"stage_{number}")
        if number:
            scratch.drop(f"stage_{number - 1}")
        docs = done
    return docs
