"""Repeatable samples and blocks; hashes of the key stand in for a random generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import ranking
from panelspark.functions.rolling import series


def mixed(key: str, seed: int) -> Column:
    """A pseudo-random order of keys that any engine with md5 reproduces."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_keys(keys: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct keys in hash order: a top-k, not a sort."""
    return (keys.select(key).distinct()
            .orderBy(mixed(key, seed), key).limit(count))


def first_rows(rows: DataFrame, count: int, key: str, seed: int = 0) -> DataFrame:
    """A bounded probe of the data; file order does not exist, so hash order is used."""
    return rows.orderBy(mixed(key, seed), key).limit(count)


def cap_per_date(rows: DataFrame, cap: int, seed: int = 0, by: Sequence[str] = ("date",),
                 key: str = "symbol", direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """At most ``cap`` names per date, chosen by hash."""
    shuffled = rows.withColumn("_order", mixed(key, seed))
    return (ranking.positions(shuffled, by, [F.col("_order"), F.col(key)], "_pos", "_n", direct_rows)
            .where(F.col("_pos") <= cap).drop("_order", "_pos", "_n"))


def numbered_dates(dates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct dates of each set with index ``i`` from 0 and date count ``n``.

    One row per day and set, so the window behind it is bounded by the calendar.
    """
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return dates.select(*by, "date").distinct().select(
        *by, "date", (F.row_number().over(spec.orderBy("date")).cast("long") - 1).alias("i"),
        F.count(F.lit(1)).over(spec).alias("n"))


def evenly_spaced(dates: DataFrame, count: int, skip_head: int = 0, skip_tail: int = 0) -> DataFrame:
    """``count`` dates at equal index steps between the two skipped ends."""
    step = (F.col("n") - skip_tail - skip_head) / F.lit(float(max(count - 1, 1)))
    k = F.greatest(F.ceil((F.col("i") - skip_head) / step), F.lit(0))
    return (numbered_dates(dates)
            .where((k <= count - 1) & (F.floor(skip_head + k * step) == F.col("i")))
            .select("date", "i"))


def date_blocks(dates: DataFrame, size: int = params.BLOCK_DATES, seed: int | None = None) -> DataFrame:
    """Consecutive blocks of ``size`` dates, the incomplete tail dropped.

    With a seed, ``turn`` gives the blocks a shuffled order; dates inside stay in order.
    """
    blocks = (numbered_dates(dates).withColumn("block", F.floor(F.col("i") / size))
              .where((F.col("block") + 1) * size <= F.col("n")).select("block", "date"))
    if seed is None:
        return blocks
    order = (blocks.select("block").distinct().withColumn("_all", F.lit(0))
             .withColumn("_mix", mixed("block", seed)))
    turn = order.withColumn("turn", F.row_number().over(series("_all", order="_mix")) - 1)
    return blocks.join(turn.select("block", "turn"), "block")
