"""Two-pass external shuffle.

Pass 1 scatters rows uniformly over memory-sized buckets by a seeded hash; pass 2 shuffles each
bucket in memory (Fisher-Yates) and writes it. Buckets follow each other, so the row at position
p of N belongs to shard floor(p * shards / N): counts differ by one at most (law ``rows``), and a
bucket touches one shard or two, which keeps the number of files near the number of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import new_path, stored

MOST_BUCKETS, STRETCH = 1 << 22, 4096


def scatter(docs: DataFrame, key: str, seed: int, bucket_bytes: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with their bucket, and the number of rows of each bucket.

    The counts are one number per bucket, at most ``MOST_BUCKETS`` of them: buckets grow beyond
    ``bucket_bytes`` before there are more. Equal keys are told apart by a hash of the text. Rows equal
    in both share a bucket while they fit in one; a larger group is kept as one row and its count and
    written out again under running numbers, which spread it over all buckets.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 8
    mark = F.xxhash64("text")
    groups = stored(docs.groupBy(F.col(key), mark.alias("_mark")).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_n")), "groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    n = int(min(MOST_BUCKETS, max(1, -(-total // bucket_bytes))))
    large = (F.col("_n") > 1) & (F.col("_bytes") > max(bucket_bytes, total // n))  # true of fewer than n groups

    def spot(*more):
        return F.pmod(F.xxhash64(F.lit(seed), F.col(key), *more), F.lit(n)).cast("int")

    rows = docs.select(F.col(key), "text", size.alias("size"), spot(mark).alias("_bucket"))
    dealt = groups.where(~large).select(spot(F.col("_mark")).alias("b"), "_n")
    many = groups.where(large).select(F.col(key).alias("_key"), F.col("_mark").alias("_large"))
    if not many.isEmpty():
        same, many = F.col(key).eqNullSafe(F.col("_key")) & (mark == F.col("_large")), F.broadcast(many)
        one = stored(docs.join(many, same, "left_semi").groupBy(F.col(key), "text").agg(F.count(F.lit(1)).alias("_n")), "copies")
        cut = one.withColumn("_at", F.explode(F.expr(f"sequence(0L, (_n - 1) div {STRETCH})"))).repartition(F.col(key), mark, F.col("_at"))
        copies = cut.withColumn("_i", F.explode(F.expr(f"sequence(_at * {STRETCH}, least(_n, (_at + 1) * {STRETCH}) - 1)")))
        copies = copies.withColumn("_bucket", spot(mark, F.col("_i")))
        rows = docs.join(many, same, "left_anti").select(F.col(key), "text", size.alias("size"), spot(mark).alias("_bucket")).unionByName(
            copies.select(F.col(key), "text", size.alias("size"), "_bucket"))
        dealt = dealt.unionByName(copies.select(F.col("_bucket").alias("b"), F.lit(1).cast("long").alias("_n")))
    counts = np.zeros(n, dtype=np.int64)
    for r in dealt.groupBy("b").agg(F.sum("_n").alias("n")).collect():
        counts[r["b"]] = r["n"]
    return rows, counts


def external_shuffle(docs: DataFrame, shards: int = 24, key: str = "doc_id", seed: int = 20240607,
                     bucket_bytes: int = 16 << 20) -> tuple[str, DataFrame]:
    """Write the shuffled rows as ``shard=k`` folders of the shared folder; their path and their rows.

    Columns: the key, text, size, text_crc32, slot (gapless from 0 in a shard), shard. A missing
    text is written as missing, with size 8 and crc 0. Repeated rows and rows without a key are kept.
    A bucket is put in a fixed order before it is shuffled, so a repeated task gives the same rows.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    rows, counts = scatter(docs, key, seed, bucket_bytes)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    total = int(offsets[-1])
    starts = np.array([-(-k * total // shards) for k in range(shards + 1)], dtype=np.int64)

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        bucket = TaskContext.get().partitionId()
        order = pc.sort_indices(table, sort_keys=[(key, "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        spin = np.random.Generator(np.random.PCG64([seed, bucket]))
        order = spin.permutation(order.to_numpy())  # Fisher-Yates
        place = np.arange(len(order), dtype=np.int64) + offsets[bucket]
        shard = np.searchsorted(starts, place, side="right") - 1
        for at in range(0, len(order), 4096):
            part = table.take(pa.array(order[at:at + 4096])).drop_columns(["_bucket"]).combine_chunks()
            part = part.append_column("slot", pa.array(place[at:at + 4096] - starts[shard[at:at + 4096]]))
            part = part.append_column("shard", pa.array(shard[at:at + 4096].astype(np.int32)))
            yield from part.to_batches()

    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    dealt = rows.select(key, "text", "size", crc, "_bucket").repartitionById(len(counts), F.col("_bucket"))
    out = dealt.mapInArrow(shuffle, f"`{key}` {kind}, text string, size long, text_crc32 long, slot long, shard int")
    path = new_path(spark, "shuffled")
    out.write.partitionBy("shard").parquet(path)
    schema = f"`{key}` {kind}, text string, size long, text_crc32 long, slot long, shard int"
    return path, spark.read.schema(schema).parquet(path)
