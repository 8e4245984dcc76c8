"""Incremental news ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from panelspark.operators.articles import STRICT_KEY


def news_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def dedup_stream(articles: DataFrame, event_time: str = "event_time", delay: str = "7 days",
                 salts: int = 8) -> DataFrame:
    """Strict dedup that remembers keys for ``delay`` only.

    Equals the batch dedup's key set when copies of a story arrive within the delay;
    state is bounded by the stories of that span. Copies are first dropped under a random
    salt, so one story copied through a whole batch is handled by several tasks, and then
    under the key alone. The salt only spreads work: the outcome does not depend on it.
    """
    salted = articles.withWatermark(event_time, delay).withColumn("_salt", F.floor(F.rand() * salts))
    first = salted.dropDuplicatesWithinWatermark([*STRICT_KEY, "_salt"]).drop("_salt")
    return first.dropDuplicatesWithinWatermark(list(STRICT_KEY))


def daily_counts(articles: DataFrame, event_time: str = "event_time", delay: str = "7 days") -> DataFrame:
    """Articles per symbol and day, emitted once a day is final.

    The partial aggregate of each micro-batch already reduces a dominant symbol to one
    row per task and day.
    """
    return (articles.withWatermark(event_time, delay)
            .groupBy(F.window(event_time, "1 day"), "symbol").agg(F.count(F.lit(1)).alias("n"))
            .select("symbol", F.to_date("window.start").alias("day"), "n"))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet until everything available has been read."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
