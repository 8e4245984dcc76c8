"""The daily sentiment table kept up to date from a stream of scored news.

Two stored tables make the state. ``moments`` holds the mergeable moments of every batch per (symbol, stated
day), in a folder of the batch's number, so a batch that is run again replaces itself. ``daily`` holds one row
per (symbol, session), partitioned by shard of the symbol and year. A batch recomputes the symbols it touches, and
replaces the partitions of their shards from the first session that can change; the rows of other
symbols in these partitions are carried over. What a batch costs follows from the symbols it touches and
the calendar, not from the news stored before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from panelspark import params
from panelspark.operators.alignment import calendar_of, daily_from_calendar, news_days
from panelspark.session import durable

PLACE = ("shard", "year")


def _placed(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(F.col("symbol").cast("string")), F.lit(shards)).cast("int"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _replace(rows: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Overwrite only the partitions that ``rows`` has; each becomes few files."""
    (rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy(*by).parquet(path))


def _calendar(sessions: DataFrame) -> DataFrame:
    return sessions if "dates" in sessions.columns else calendar_of(sessions)


def start_table(sessions: DataFrame, root: str, shards: int = 64) -> None:
    """A table of quiet sessions, unless there is one. ``_SUCCESS`` tells a finished table from a torn one.

    Here and below ``sessions`` is (symbol, date), or the calendar that :func:`calendar_of` makes of it.
    """
    spark = sessions.sparkSession
    if not _exists(spark, f"{root}/daily/_SUCCESS"):
        quiet = _placed(daily_from_calendar(None, _calendar(sessions)), shards).withColumn("year", F.year("date"))
        (quiet.hint("rebalance", *PLACE).write.mode("overwrite").option("partitionOverwriteMode", "static")
         .option("compression", "zstd").partitionBy(*PLACE).parquet(f"{root}/daily"))


def apply_batch(batch: DataFrame, number: int, sessions: DataFrame, root: str, shards: int = 64,
                half_life: float = params.SENTIMENT_HALF_LIFE, score: str = "sent_signed") -> None:
    """Fold one batch of news into the tables. Running it twice, or after a stop at any point, gives the same tables.

    News without a date count nowhere; news after a symbol's last session are kept in ``moments`` only. A batch
    may hold days of any age.
    """
    spark = batch.sparkSession
    days = _placed(news_days(batch, score), shards).withColumn("batch", F.lit(int(number)))
    _replace(days, f"{root}/moments", ("shard", "batch"))
    moments = spark.read.parquet(f"{root}/moments")
    first = moments.where(F.col("batch") == int(number)).groupBy("symbol").agg(F.min("date").alias("first"))
    changed = F.array_min(F.filter("dates", lambda d: d > F.col("first")))
    touched = _calendar(sessions).join(first, "symbol").withColumn("since", changed).where(F.col("since").isNotNull())
    touched = durable(_placed(touched, shards).select("shard", "symbol", "since", "dates"))  # a row a symbol
    since = touched.groupBy("shard").agg(F.year(F.min("since")).alias("since")).collect()  # at most one row a shard
    if not since:
        return
    # literal filters on the partition columns: other shards and earlier years are not even listed
    hit = [r["shard"] for r in since]
    open_place = F.lit(False)
    for r in since:
        open_place = open_place | ((F.col("shard") == r["shard"]) & (F.col("year") >= r["since"]))
    names = touched.select("symbol")
    known = moments.where(F.col("shard").isin(*hit)).join(names, "symbol", "left_semi")
    fresh = daily_from_calendar(known, touched.select("symbol", "dates"), half_life)
    fresh = _placed(fresh, shards).withColumn("year", F.year("date")).where(open_place)
    stored = spark.read.parquet(f"{root}/daily").where(open_place)
    if not stored.select("symbol").distinct().join(names, "symbol", "left_anti").isEmpty():
        # what is written over is read before, in full: the rows of other symbols are stored first
        fresh = fresh.unionByName(durable(stored.join(names, "symbol", "left_anti").select(fresh.columns)))
    _replace(fresh, f"{root}/daily", PLACE)


def maintain(news: DataFrame, sessions: DataFrame, root: str, shards: int = 64, half_life: float = params.SENTIMENT_HALF_LIFE) -> StreamingQuery:
    """Apply a stream of (symbol, date, sent_signed) until all that is available has been read.

    ``root`` also holds the stream's checkpoint: a new start goes on after the last finished batch.
    """
    calendar = sessions if "dates" in sessions.columns else durable(calendar_of(sessions))
    start_table(calendar, root, shards)

    def fold(batch: DataFrame, number: int) -> None:
        apply_batch(batch, number, calendar, root, shards, half_life)

    return news.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()


def read(spark: SparkSession, root: str) -> DataFrame:
    """The daily table, as :func:`panelspark.operators.alignment.sentiment_daily` gives it."""
    return spark.read.parquet(f"{root}/daily").drop(*PLACE)
