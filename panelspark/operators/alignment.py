"""Point-in-time alignment of dated news to trading sessions, and its decay.

News are reduced to one row per (symbol, stated date) first, by an aggregation with
map-side combine. After that a symbol has at most two rows per calendar day, whatever
its share of all articles, and the windows below are safe. Everything after the first
aggregation runs on a single exchange by symbol.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions.rolling import before, series, so_far
from panelspark.session import shipped


def news_days(news: DataFrame, score: str = "sent_signed") -> DataFrame:
    """Mergeable moments of the score per (symbol, stated date)."""
    s = F.col(score)
    return news.where(F.col("date").isNotNull()).groupBy("symbol", "date").agg(
        F.count(s).alias("n"), F.sum(s).alias("total"),
        (F.var_pop(s) * F.count(s)).alias("spread"))


def next_session(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add ``eff``: the symbol's first session strictly after ``date``.

    Reads the union of days and sessions from the latest to the earliest date with
    days ahead of an equal session, so the last session seen is the next one. That is
    one sort and one running value instead of a range join. ``eff`` is NULL after the
    last session.
    """
    calendar = sessions.select("symbol", "date").distinct()
    both = (days.withColumn("_session", F.lit(0))
            .unionByName(calendar.withColumn("_session", F.lit(1)), allowMissingColumns=True))
    backwards = series("symbol").orderBy(F.col("date").desc(), F.col("_session"))
    later = F.last(F.when(F.col("_session") == 1, F.col("date")), ignorenulls=True)
    return both.withColumn("eff", later.over(before(backwards)))


def align(days: DataFrame, sessions: DataFrame) -> DataFrame:
    """News days with their effective session; days after the last session drop out."""
    return (next_session(days, sessions)
            .where((F.col("_session") == 0) & F.col("eff").isNotNull()).drop("_session"))


def align_articles(news: DataFrame, sessions: DataFrame, salts: int = 8) -> DataFrame:
    """Every article with its effective session, through the per-day mapping.

    Articles are dealt by (symbol, date, salt), whatever partitioning the mapping has and
    whatever the session allows to be reused: a symbol with a third of all articles, or a
    day of it, is many tasks. The salt is a hash of the article.
    """
    days = news.select("symbol", "date").distinct()
    keys = ["symbol", "date", "_salt"]
    mapping = align(days, sessions).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).repartition(*keys)
    salted = news.withColumn("_salt", F.pmod(F.xxhash64(*news.columns), F.lit(salts)).cast("int")).repartition(*keys)
    return salted.join(mapping, keys).drop("_salt")


def _merged() -> list:
    """Count, mean and sample deviation of several days' moments."""
    n, total = F.sum("n"), F.sum("total")
    between = F.sum(F.try_divide(F.col("total") * F.col("total"), F.col("n"))) - F.try_divide(total * total, n)
    spread = F.sum("spread") + F.greatest(between, F.lit(0.0))
    return [F.coalesce(n, F.lit(0)).alias("n"), F.try_divide(total, n).alias("mean"),
            F.when(n > 0, F.coalesce(F.sqrt(F.try_divide(spread, n - 1)), F.lit(0.0))).alias("sd")]


def session_sentiment(news: DataFrame, sessions: DataFrame, score: str = "sent_signed") -> DataFrame:
    """Mean, count and deviation per (symbol, session); a single article has sd 0."""
    aligned = align(news_days(news, score), sessions)
    return (aligned.groupBy("symbol", F.col("eff").alias("date")).agg(*_merged())
            .select("symbol", "date", "mean", "n", "sd"))


def sentiment_daily(news: DataFrame, sessions: DataFrame, half_life: float = params.SENTIMENT_HALF_LIFE,
                    score: str = "sent_signed") -> DataFrame:
    """One row per session: last news value halved every ``half_life`` sessions."""
    return daily_from_days(news_days(news, score), sessions, half_life)


def daily_from_days(days: DataFrame, sessions: DataFrame, half_life: float = params.SENTIMENT_HALF_LIFE) -> DataFrame:
    """:func:`sentiment_daily` from moments as :func:`news_days` gives them; a day may have several rows to merge.

    Sessions travel through the alignment as empty rows, so the per-session aggregate
    yields quiet sessions too and no join back to the calendar is needed.
    """
    aligned = next_session(days, sessions)
    landing = F.when(F.col("_session") == 1, F.col("date")).otherwise(F.col("eff"))
    per_session = (aligned.withColumn("date", landing).where(F.col("date").isNotNull())
                   .groupBy("symbol", "date").agg(*_merged()))
    spec = series("symbol")
    has_news = F.col("n") > 0
    indexed = per_session.withColumn("_i", F.row_number().over(spec))
    run = so_far(spec)
    staged = indexed.select(
        "*", F.last("mean", ignorenulls=True).over(run).alias("_last"),
        F.last(F.when(has_news, F.col("_i")), ignorenulls=True).over(run).alias("_at"))
    gap = F.col("_i") - F.col("_at")
    return staged.select(
        "symbol", "date",
        F.coalesce(F.col("_last") * F.pow(F.lit(0.5), gap / F.lit(float(half_life))),
                   F.lit(0.0)).alias("sent_decay"),
        F.col("mean").alias("sent_raw"), F.col("n").cast("int").alias("news_intensity"),
        F.when(has_news, F.col("sd")).alias("sent_dispersion"),
        F.coalesce(gap, F.lit(-1)).cast("long").alias("days_since_news"),
        has_news.alias("has_news"))


#: Symbols whose sessions are worked out at once.
SYMBOLS = 256


def calendar_of(sessions: DataFrame) -> DataFrame:
    """(symbol, dates): a symbol's sessions as one sorted array, which the calendar bounds."""
    return sessions.groupBy("symbol").agg(F.sort_array(F.collect_set("date")).alias("dates"))


def daily_from_calendar(days: DataFrame | None, calendar: DataFrame, half_life: float = params.SENTIMENT_HALF_LIFE) -> DataFrame:
    """:func:`daily_from_days` for a calendar of :func:`calendar_of`: no row per session is shuffled or sorted."""
    shipped(calendar.sparkSession)
    moments = "array<struct<date:date,n:bigint,total:double,spread:double>>"
    if days is None:
        rows = calendar.select("symbol", "dates", F.lit(None).cast(moments).alias("days"))
    else:
        one = F.struct("date", F.col("n").cast("long").alias("n"), F.col("total").cast("double").alias("total"), F.col("spread").cast("double").alias("spread"))
        held = days.groupBy("symbol").agg(F.collect_list(one).alias("days"))
        rows = calendar.join(held, "symbol", "left").select("symbol", "dates", F.col("days").cast(moments).alias("days"))
    shape = (f"symbol {dict(calendar.dtypes)['symbol']}, date date, sent_decay double, sent_raw double, news_intensity int, "
             "sent_dispersion double, days_since_news long, has_news boolean")
    return rows.mapInArrow(partial(_daily, half_life=float(half_life)), shape)


def _daily(batches: Iterator[pa.RecordBatch], half_life: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, SYMBOLS):
            yield _daily_of(batch.slice(first, SYMBOLS), half_life)


def _placed(dates: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Dates behind the number of their symbol: one order over all symbols."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    return (owner << 33) + dates.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 32)


def _daily_of(batch: pa.RecordBatch, half_life: float) -> pa.RecordBatch:
    sizes, counts = (pc.fill_null(pc.list_value_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
    dates, news = batch.column(1).flatten(), batch.column(2).flatten()
    ends = np.cumsum(sizes)
    begins, rows = np.repeat(ends - sizes, sizes), len(dates)
    day, n, total, spread = (pc.struct_field(news, i) for i in range(4))
    # the first session of the symbol strictly after the stated day; there may be none
    land = np.searchsorted(_placed(dates, sizes), _placed(day, counts), side="right")
    good = land < np.repeat(ends, counts)
    land = land[good]
    n, total, spread = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(float)[good] for x in (n, total, spread))
    some = np.maximum(n, 1)

    def summed(x: np.ndarray) -> np.ndarray:
        return np.bincount(land, weights=x, minlength=rows)

    number, whole = summed(n), summed(total)
    has = number > 0
    least = np.maximum(number, 1)
    mean = whole / least
    within = summed(spread) + np.maximum(summed(total * total / some) - whole * whole / least, 0.0)
    sd = np.sqrt(np.where(number > 1, within / np.maximum(number - 1, 1), 0.0))
    here = np.arange(rows)
    at = np.maximum.accumulate(np.where(has, here, -1)) if rows else here
    known = at >= begins
    gap = np.where(known, here - at, -1)
    decay = np.where(known, mean[at] * np.power(0.5, np.maximum(gap, 0) / half_life), 0.0) if rows else mean
    symbols = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
    return pa.RecordBatch.from_arrays(
        [symbols, dates, pa.array(decay), pa.array(mean, mask=~has), pa.array(number.astype(np.int32)), pa.array(sd, mask=~has),
         pa.array(gap.astype(np.int64)), pa.array(has)],
        names=["symbol", "date", "sent_decay", "sent_raw", "news_intensity", "sent_dispersion", "days_since_news", "has_news"])
