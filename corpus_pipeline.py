"""The corpus pipeline: from raw documents to token ids, a stage at a time.

Each stage takes (spark, docs, folder of the tables) and returns what it keeps; the caller writes
it as Parquet and reads it again as the next stage's documents. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import bpe, compression, jaccard, queries, string_kernel, templates
from panelspark.llm.common import documents, stored

#: Bitmaps of 4 kB that may be broadcast: 32 MB, some 130 GB of texts at 16 MB a stored part.
MAPS = 8192


def _row_numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows under a name of their own, which a repeated or missing id is not, fixed by storing them; and the
    column of that name, called as no column of the documents is."""
    row, taken = "_row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(rows: DataFrame, row: str, bad: DataFrame) -> DataFrame:
    """``rows`` without those whose number ``row`` is in ``bad``, and without that column. The numbers travel to the rows
    as bitmaps of 32768 numbers each, so no text is shuffled; where these are more than ``MAPS``, a join decides."""
    bad = stored(bad.select(row), "dropped")
    at = F.bitmap_bucket_number(row).alias("_map"), F.bitmap_bit_position(row).alias("_bit")
    maps = bad.select(*at).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    if bad.select(at[0]).distinct().count() > MAPS:
        return rows.join(bad, row, "left_anti").drop(row)
    columns = [c for c in rows.columns if c != row]
    docs = rows.select(*at, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("_doc"))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("_bit div 8 + 1").cast("int"), 1)), 16, 10).cast("int")
    hit = F.bit_get(byte, (F.col("_bit") % 8).cast("int")) == 1
    kept = docs.join(F.broadcast(maps), "_map", "left").where(F.col("_bits").isNull() | ~hit)
    return kept.select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(columns)])


def _judged(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows that ``judge`` (rows, key) returns. The whole row is the key, so no row is joined back and no text is shuffled."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = judge(docs.select(row.alias("_doc"), "text"), "_doc")
    return kept.select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the string kernel does not predict toxic. It learns from the labels of the tables."""
    model = string_kernel.fit(queries.labelled(spark, folder, docs))
    return _judged(docs, lambda rows, key: string_kernel.score_toxicity(rows, model, key).where("not predicted <=> 1"))


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the compression bands keep."""
    return _judged(docs, lambda rows, key: compression.compression_bands(rows, key).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near copies, the one with the least id (a missing one last); of rows equal in
    that, by a hash of the text, then by row. Texts without words are in no group and stay."""
    rows, row = _row_numbered(docs)
    groups = jaccard.jaccard_components(rows.select(F.col(row).alias("_row"), "text"), "_row").where("n_shingles > 0").select("_row", "component_id")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(row).alias("_row"))
    ranked = rows.select(F.col(row).alias("_row"), rank.alias("rank"))
    members = stored(groups.join(several, "component_id", "left_semi").join(ranked, "_row"), "members")
    first = members.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank._row")
    bad = members.select("_row").join(first, "_row", "left_anti").withColumnRenamed("_row", row)
    return _without(rows, row, bad)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item; each row has a verdict of its own."""
    rows, row = _row_numbered(docs)
    found = templates.contaminated(rows, spark.read.parquet(f"{folder}/benchmark.parquet"), row).select(row).distinct()
    return _without(rows, row, found)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, ids (packed)."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_columns(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES = [("toxicity", toxicity), ("quality_rules", quality), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("byte_bpe", encode)]

#: No stage's model, compression ratio, or merge order can be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
