"""Combinatorial purged cross-validation, nested splits and the work grid.

The date table has one row per rebalance date, so it is bounded by the calendar. Fold
combinations are literals exploded next to each date; stock-level rows are joined to
roles only where an operator needs them and never multiplied by train folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelspark import params
from panelspark.functions.rolling import series
from panelspark.operators.sampling import numbered_dates


def purged_folds(dates: DataFrame, groups: int = params.CPCV_GROUPS,
                 test_groups: int = params.CPCV_TEST_GROUPS, purge: int = params.CPCV_PURGE,
                 by: Sequence[str] = ()) -> DataFrame:
    """Rows (fold, i, date, role) for every combination of test blocks.

    Dates are cut into near-equal contiguous blocks whose edges are the truncated points
    of an even grid over the n dates: index i lies in block floor(((i + 1) * groups - 1) / n).
    role is 'test', 'train', or 'purged' for dates within ``purge`` steps of a test date.
    """
    combos = [list(c) for c in combinations(range(groups), test_groups)]
    block = F.floor(((F.col("i") + 1) * groups - 1) / F.col("n")).cast("int")
    spread = numbered_dates(dates, by).select(
        *by, "i", "date", block.alias("block"), F.posexplode(F.lit(combos)).alias("fold", "combo"))
    spread = spread.withColumn("_test", F.array_contains("combo", F.col("block")).cast("int"))
    near = F.max("_test").over(series(*by, "fold", order="i").rowsBetween(-purge, purge))
    role = F.when(F.col("_test") == 1, "test").when(near == 1, "purged").otherwise("train")
    return spread.select(*by, "fold", "i", "date", role.alias("role"))


def symmetric_folds(dates: DataFrame, groups: int = params.CSCV_GROUPS, purge: int = 0,
                    by: Sequence[str] = ()) -> DataFrame:
    """Half of the blocks in, half out, in all combinations."""
    return purged_folds(dates, groups, groups // 2, purge, by)


def nested_inner(folds: DataFrame, groups: int = 5, val_groups: int = 1, purge: int = 1) -> DataFrame:
    """Inner split of each fold's train dates: the last block validates."""
    spec = series("fold", order="i")
    train = (folds.where(F.col("role") == "train")
             .withColumn("j", F.row_number().over(spec).cast("long") - 1)
             .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("fold"))))
    cut = F.floor(F.col("_n") * (groups - val_groups) / groups)
    inner = (F.when(F.col("j") >= cut, "val").when(F.col("j") < cut - purge, "train")
             .otherwise("purged"))
    return train.select("fold", "j", "date", inner.alias("role"))


def fold_gates(folds: DataFrame, purge: int = params.CPCV_PURGE) -> DataFrame:
    """Per fold: sizes, train/test overlap and the smallest train-test step distance."""
    back = series("fold", order="i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("fold").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    test_i = F.when(F.col("role") == "test", F.col("i"))
    train = F.col("role") == "train"
    marked = folds.select("*", F.max(test_i).over(back).alias("_prev"), F.min(test_i).over(ahead).alias("_next"))
    gap = F.when(train, F.least(F.col("i") - F.col("_prev"), F.col("_next") - F.col("i")))
    return marked.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test"),
        F.count_if(train & (F.col("role") == "test")).alias("overlap"),
        F.min(gap).cast("long").alias("min_gap")).withColumn("passed", F.col("min_gap") > purge)


def coverage(folds: DataFrame) -> DataFrame:
    """In how many folds each date is tested."""
    return folds.groupBy("date").agg(F.count_if(F.col("role") == "test").alias("paths"))


def work_grid(spark, models: Sequence[str], arms: Sequence[str], seeds: int, folds: int,
              extra: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Cells (cell, model, arm, seed, fold): model-major, with extra model/arm pairs last."""
    pairs = [(m, a) for m in models for a in arms] + list(extra)
    cells = spark.range(len(pairs) * seeds * folds).withColumnRenamed("id", "cell")
    pair = F.element_at(F.lit([list(p) for p in pairs]),
                        (F.floor(F.col("cell") / (seeds * folds)) + 1).cast("int"))
    return cells.select(
        "cell", pair[0].alias("model"), pair[1].alias("arm"),
        (F.floor(F.col("cell") / folds) % seeds).cast("int").alias("seed"),
        (F.col("cell") % folds).cast("int").alias("fold"))


def pending_cells(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells without stored scores."""
    keys = ["model", "arm", "seed", "fold"]
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")
