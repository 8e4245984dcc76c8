"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (bpe, byte_network, centroids, compression, external_shuffle, filter_audit, gated_lm, jaccard, language,
                            string_kernel, templates, token_blocks, token_counts)
from panelspark.llm.common import bounded_sample, documents, held_out
from panelspark.llm.oracles import ORACLE_SQL


def op1_rans_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    path = token_blocks.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_tokens(spark, path, kind=dict(docs.dtypes)["doc_id"])


def op2_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return compression.compression_bands(documents(spark, folder))


def labelled(spark: SparkSession, folder: str, docs: DataFrame, per_class: int = 2000) -> DataFrame:
    """Texts with a toxicity label, of the rows that may be learned from; one label per id, the higher.

    At most ``per_class`` ids of each label are drawn by hash before any text is read, so the ids
    are a bounded table that is sent to the documents, and no text is shuffled.
    """
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.col("toxic").isNotNull() & ~held_out(3, 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = bounded_sample(labels, "toxic", per_class).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def op3_string_kernel_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = string_kernel.fit(labelled(spark, folder, docs))
    scored = string_kernel.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op4_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    _, rows = external_shuffle.external_shuffle(documents(spark, folder))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op5_language_families(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.fit(docs.where(~held_out(5, 0)))
    found = language.identify(docs, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op7_two_tier_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_columns(documents(spark, folder), ranks, public_tokenizers.PATTERN)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder))


def op6_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return templates.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op10_gated_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = gated_lm.language_model(documents(spark, folder), held_out(7, 2))
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_sample(spark: SparkSession, folder: str, docs: DataFrame, per_class: int = 1000) -> DataFrame:
    """(text, label) of rows whose quality label may be learned from: ``per_class`` ids of each label.

    Only ids with a document are drawn; an id with several labels counts as bad, one with several texts
    gives the first by hash. The ids are a bounded table, so no text moves before it is chosen.
    """
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(F.col("quality").isNotNull() & ~held_out(4, 2))
    labels = labels.groupBy("doc_id").agg(F.min("quality").alias("label"))
    present = labels.join(docs.select("doc_id"), "doc_id", "left_semi")
    drawn = bounded_sample(present, "label", per_class).select("doc_id", "label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "label")


def op11_byte_network_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    net = byte_network.fit(quality_sample(spark, folder, docs))
    scored = byte_network.score_quality(docs, net)
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows, fails = filter_audit.failing_relations(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return filter_audit.audit(rows, fails)


def op13_orchard_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (op1_rans_token_blocks, op2_compression_bands, op3_string_kernel_toxicity, op4_external_shuffle,
                                   op5_language_families, op6_template_decontamination, op7_two_tier_bpe, op8_token_counts, op9_jaccard_join,
                                   op10_gated_language_model, op11_byte_network_quality, op12_filter_audit, op13_orchard_clusters)}
