"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import ann, embed_dedup, jaccard, minhash, mixing, orchard, packing, prefix_trie, quality, repeats, secrets, token_files, toxicity
from codefacts.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = ann.fit_index(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    return ann.search(index, index.rows.filter(F.col("vec_key") % 20 == 0))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"))
    sums = packed.tokens.select("row", "piece", F.crc32("ids").alias("ids_crc32"))
    return packed.pieces.join(sums, ["row", "piece"]).select(
        F.col("doc_key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select(
        "doc_id", F.col("mix_topic").alias("topic"), "n_tokens", F.round("keep_probability", 6).alias("keep_probability"), F.col("kept").cast("int").alias("kept")
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("doc_key").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.fit_toxicity(docs, labels.filter(fold != 0))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).vectors
    return found.select(F.col("vec_key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "quality_score", "quality_keep")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"))
    found = token_files.token_counts(files)
    return found.select(F.col("doc_key").alias("doc_id"), "start", "n_tokens")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_secrets(docs, secrets.fit_formats(docs)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"] != "format")

    def listed(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(parts, ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    digest = F.sha2(listed(base).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, listed(F.col("spans")).alias("spans"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_join(table(spark, sf_dir, "documents"))
    return joined.documents.select(F.col("doc_key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(prefix_trie.forked(prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))))


def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orchard.cluster(table(spark, sf_dir, "embeddings"))
    # as many rows as there are centroids
    return found.vectors.join(F.broadcast(found.clusters), "cluster").select(
        F.col("vec_key").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(found.inertia).cast("bigint").alias("inertia"), "centroid_sha256"
    )


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("doc_key", "doc_id")


QUERIES: dict[str, Query] = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_source_mixing": op3_source_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_orchard_clusters": op12_orchard_clusters,
    "op13_fingerprints": op13_fingerprints,
}
