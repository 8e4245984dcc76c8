"""Operators on one time series: forecast windows, decomposition, normalisation, patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.rolling import series, whole


def forecast_windows(rows: DataFrame, value: str, seq: int = 96, pred: int = 96,
                     keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """Input and target arrays starting at each row that has seq + pred rows ahead."""
    spec = series(*keys, order=order)
    x = F.collect_list(value).over(spec.rowsBetween(0, seq - 1))
    y = F.collect_list(value).over(spec.rowsBetween(seq, seq + pred - 1))
    staged = rows.select(*keys, order, x.alias("x"), y.alias("y"))
    return staged.where((F.size("x") == seq) & (F.size("y") == pred))


def persistence_errors(rows: DataFrame, value: str, seq: int = 96, pred: int = 96,
                       keys: Sequence[str] = ("symbol",), order: str = "date") -> DataFrame:
    """MSE and MAE of repeating the last input value over the target window."""
    last = F.element_at("x", -1)
    full = forecast_windows(rows, value, seq, pred, keys, order).select(
        F.transform("y", lambda t: t - last).alias("_gaps"))
    squares = F.aggregate("_gaps", F.lit(0.0), lambda acc, g: acc + g * g)
    sizes = F.aggregate("_gaps", F.lit(0.0), lambda acc, g: acc + F.abs(g))
    cells = F.sum(F.size("_gaps"))
    return full.agg((F.sum(squares) / cells).alias("mse"), (F.sum(sizes) / cells).alias("mae"),
                    F.count(F.lit(1)).alias("windows"))


def border_standardise(rows: DataFrame, value: str, train: Column, keys: Sequence[str] = ("symbol",),
                       eps: float = 1e-8) -> DataFrame:
    """Standardise by mean and population deviation of the training span of each series."""
    spec = Window.partitionBy(*keys)
    known = F.when(train, F.col(value))
    staged = rows.withColumn("_mu", F.avg(known).over(spec)).withColumn("_sd", F.stddev_pop(known).over(spec))
    return (staged.withColumn(value, (F.col(value) - F.col("_mu")) / (F.col("_sd") + eps))
            .drop("_mu", "_sd"))


def trend_seasonal(rows: DataFrame, value: str, width: int = 25, keys: Sequence[str] = ("symbol",),
                   order: str = "date") -> DataFrame:
    """Centred moving average with the end values repeated, and what it leaves over."""
    back = (width - 1) // 2
    ahead = width - 1 - back
    spec = series(*keys, order=order)
    i = F.row_number().over(spec)
    n = F.count(F.lit(1)).over(whole(spec))
    frame = spec.rowsBetween(-back, ahead)
    staged = rows.select("*", i.alias("_i"), n.alias("_n"), F.sum(value).over(frame).alias("_sum"),
                         F.first(value).over(whole(spec)).alias("_first"),
                         F.last(value).over(whole(spec)).alias("_last"))
    short_front = F.greatest(back + 1 - F.col("_i"), F.lit(0))
    short_back = F.greatest(F.col("_i") + ahead - F.col("_n"), F.lit(0))
    trend = (F.col("_sum") + short_front * F.col("_first") + short_back * F.col("_last")) / width
    return (staged.withColumn("trend", trend).withColumn("seasonal", F.col(value) - F.col("trend"))
            .drop("_i", "_n", "_sum", "_first", "_last"))


def instance_norm(window: Column, eps: float = 1e-5) -> Column:
    """Struct (z, mean, sd) of an array, sample deviation; :func:`restore` inverts it.

    Two passes over plain sums, mean then squares about it: no struct is built per value. Binding the moments
    through a one-element array keeps them from being evaluated again for every element.
    """
    n = F.size(window).cast("double")
    total = F.aggregate(window, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n == 0, F.lit(0.0)).otherwise(total / F.nullif(n, F.lit(0.0)))

    def spread(m: Column) -> Column:
        square = F.aggregate(window, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
        sd = F.sqrt(square / F.nullif(n - 1, F.lit(0.0))) + F.lit(eps)
        return F.struct(m.alias("mean"), sd.alias("sd"))

    def apply(m: Column) -> Column:
        return F.struct(F.transform(window, lambda x: (x - m["mean"]) / m["sd"]).alias("z"),
                        m["mean"].alias("mean"), m["sd"].alias("sd"))

    return F.transform(F.transform(F.array(mean), spread), apply)[0]


def restore(normed: Column) -> Column:
    return F.transform(F.array(normed), lambda s: F.transform(
        s["z"], lambda z: z * s["sd"] + s["mean"]))[0]


def patches(window: Column, length: int, patch: int = 16, stride: int = 8) -> Column:
    """Overlapping patches of an array of ``length`` values, the end padded with its last one."""
    short = (stride - (length - patch) % stride) % stride
    count = max((length + short - patch) // stride + 1, 1)
    need = max(patch + (count - 1) * stride - length, 0)
    padded = F.concat(window, F.array_repeat(F.element_at(window, -1), need)) if need else window
    starts = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(starts, lambda k: F.slice(padded, k * stride + 1, patch))
