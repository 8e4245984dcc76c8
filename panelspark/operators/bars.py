"""Bars: from ticks or price rows to one adjusted bar per (symbol, date)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.params import Splits


def daily_bars(ticks: DataFrame, tick_order: Sequence[str]) -> DataFrame:
    """Ticks (symbol, date, px, qty, ...) to open/high/low/close/volume per day.

    One aggregation with map-side combine: a symbol that carries a large share of all
    ticks is already reduced to its days before the shuffle.
    """
    at = F.struct(*tick_order) if "px" in tick_order else F.struct(*tick_order, "px")
    return ticks.groupBy("symbol", "date").agg(
        F.min(at)["px"].alias("open"), F.max("px").alias("high"),
        F.min("px").alias("low"), F.max(at)["px"].alias("close"),
        F.sum("qty").alias("volume"))


def parse_dates(rows: DataFrame, column: str = "date") -> DataFrame:
    """Text dates to DATE; rows whose date cannot be read are dropped."""
    return rows.withColumn(column, F.col(column).try_cast("date")).where(F.col(column).isNotNull())


def one_row_per_day(bars: DataFrame, tie_break: Sequence[str] = ("close", "volume", "open")) -> DataFrame:
    """Keep one row per (symbol, date), the lowest by ``tie_break``.

    An aggregate, not a window: copies of a day collapse before they are shuffled.
    """
    payload = [c for c in bars.columns if c not in ("symbol", "date")]
    order = F.struct(*[F.col(c) for c in tie_break if c in payload],
                     *[F.col(c) for c in payload if c not in tie_break])
    return (bars.groupBy("symbol", "date")
            .agg(F.min_by(F.struct(*payload), order).alias("_row"))
            .select("symbol", "date", "_row.*"))


def in_window(bars: DataFrame, splits: Splits) -> DataFrame:
    return bars.where(F.col("date").between(F.lit(splits.start), F.lit(splits.end)))


def adjust(bars: DataFrame) -> DataFrame:
    """Split- and dividend-consistent o, h, l, c, v; a non-positive close is NULL."""
    factor = F.col("adj_close") / F.when(F.col("close").isNotNull(),
                                         F.greatest(F.col("close"), F.lit(params.EPS)))
    return bars.select(
        "symbol", "date",
        (F.col("open") * factor).alias("o"), (F.col("high") * factor).alias("h"),
        (F.col("low") * factor).alias("l"),
        F.when(F.col("adj_close") > 0, F.col("adj_close").cast("double")).alias("c"),
        F.col("volume").cast("double").alias("v"))


def with_history(bars: DataFrame, min_rows: int = params.MIN_HISTORY_ROWS) -> DataFrame:
    """Only symbols with at least ``min_rows`` days; shares the symbol exchange."""
    spec = Window.partitionBy("symbol")
    return (bars.withColumn("_days", F.count(F.lit(1)).over(spec))
            .where(F.col("_days") >= min_rows).drop("_days"))


def tag_split(df: DataFrame, splits: Splits) -> DataFrame:
    tag = F.lit("warmup")
    for name in ("test", "val", "train"):
        lo, hi = getattr(splits, name)
        tag = F.when(F.col("date").between(F.lit(lo), F.lit(hi)), F.lit(name)).otherwise(tag)
    return df.withColumn("split", tag)
