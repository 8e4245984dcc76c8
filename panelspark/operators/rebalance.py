"""Eligible rows, rebalance dates, codes and look-back windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import ranking
from panelspark.functions.rolling import series, so_far
from panelspark.operators.sampling import numbered_dates


def eligible(panel: DataFrame, features: Sequence[str], label: str, splits: Sequence[str] | None = None,
             lookback: int = params.LOOKBACK_ROWS) -> DataFrame:
    """Rows with a label and ``lookback`` complete rows of features behind them.

    A running maximum remembers the last incomplete row, so the cost does not depend on
    the length of the look-back.
    """
    bad = F.lit(False)
    for f in features:
        bad = bad | F.col(f).isNull()
    spec = series("symbol")
    numbered = panel.withColumn("_row", F.row_number().over(spec))
    staged = numbered.withColumn("_last_bad", F.max(F.when(bad, F.col("_row"))).over(so_far(spec)))
    clean_rows = F.col("_row") - F.coalesce("_last_bad", F.lit(0))
    keep = (clean_rows >= lookback) & F.col(label).isNotNull()
    if splits is not None:
        keep = keep & F.col("split").isin(*splits)
    return staged.where(keep).drop("_last_bad", "_row")


def rebalance_dates(rows: DataFrame, spacing: int) -> DataFrame:
    """Every ``spacing``-th date with the first and last ``spacing`` dates left out.

    With at most twice ``spacing`` dates nothing is left out. Adds the date code ``t``.
    """
    indexed = numbered_dates(rows)
    i, n = F.col("i"), F.col("n")
    trimmed = (i >= spacing) & (i < n - spacing) & ((i - spacing) % spacing == 0)
    kept = indexed.where(F.when(n > 2 * spacing, trimmed).otherwise(i % spacing == 0))
    return numbered_dates(kept).select(F.col("i").alias("t"), "date")


def on_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of the listed dates; one row per day is what bounds the broadcast."""
    return rows.join(F.broadcast(dates), "date")


def symbol_codes(rows: DataFrame) -> DataFrame:
    """Dense codes from 0 in symbol order, for any number of symbols."""
    names = rows.select("symbol").distinct()
    coded = ranking.positions(names, [], [F.col("symbol")], "_pos", "_n")
    return coded.select("symbol", (F.col("_pos") - 1).alias("sym_id"))


def row_gaps(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Smallest distance in own rows between consecutive rebalance rows per symbol."""
    spec = series("symbol")
    numbered = panel.select("symbol", "date", F.row_number().over(spec).alias("_row"))
    hit = on_dates(numbered, dates.select("date"))
    return (hit.withColumn("_gap", F.col("_row") - F.lag("_row").over(spec))
            .groupBy("symbol").agg(F.min("_gap").cast("long").alias("min_gap")))


def sequence_windows(panel: DataFrame, chosen: DataFrame, features: Sequence[str],
                     length: int = params.LOOKBACK_ROWS) -> DataFrame:
    """The last ``length`` feature rows of each chosen (symbol, date), as an array.

    A symbol's rows are packed once into blocks of ``length``; a window then lies in its
    own block and the one before. Windows are built for chosen rows only, an array never
    exceeds two blocks, and there is one join on (symbol, block).
    """
    spec = series("symbol")
    numbered = panel.select("symbol", "date", F.struct(*features).alias("_x"),
                            (F.row_number().over(spec) - 1).alias("_row"))
    numbered = numbered.withColumn("_block", F.floor(F.col("_row") / length))
    packed = numbered.groupBy("symbol", "_block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_row", "_x"))), lambda r: r["_x"]).alias("_rows"))
    paired = packed.withColumn(
        "_rows", F.concat(F.coalesce(F.lag("_rows").over(series("symbol", order="_block")),
                                     F.slice("_rows", 1, 0)), F.col("_rows")))
    wanted = (numbered.join(chosen.select("symbol", "date"), ["symbol", "date"], "left_semi")
              .where(F.col("_row") >= length - 1).select("symbol", "date", "_row", "_block"))
    start = F.col("_row") - length + 2 - F.greatest(F.col("_block") - 1, F.lit(0)) * length
    return (wanted.join(paired, ["symbol", "_block"])
            .select("symbol", "date", F.slice("_rows", start.cast("int"), length).alias("window")))
