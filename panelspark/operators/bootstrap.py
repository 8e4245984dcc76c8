"""Stationary block bootstrap of return series, and the smallest effect a series can show.

A replicate is a chain of blocks: each starts anywhere on a circle of dates and has a geometric length.
No return is copied into a replicate. A block's sum and sum of squares are differences of prefix sums,
so a replicate costs one row per block: at most as many as dates, about dates / mean length of use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions.normal import normal_quantile
from panelspark.session import durable

HEX_DIGITS = 13
RANGE = 1 << 4 * HEX_DIGITS


def _draw(part: int, seed: str) -> Column:
    """A whole number below 16 ** 13 for each (replicate, draw), from an md5 any engine can repeat."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("replicate"), F.col("draw")).cast("binary"))
    return F.conv(F.substring(digest, 1 + part * HEX_DIGITS, HEX_DIGITS), 16, 10).cast("long")


def prefix_sums(returns: DataFrame, value: str, by: Sequence[str], date: str) -> DataFrame:
    """(by, end, n, centre, s1, s2): sums of the first ``end`` centred values and of their squares, from 0 to n.

    One row per set and date comes in; values are centred by the set's mean, so that sums of squares do not
    cancel. Missing values are left out before anything is counted.
    """
    keys = list(by)
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    rows = returns.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rows = rows.select(*keys, F.col(date).alias("_date"), F.col(value).cast("double").alias("_x"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("centre", F.avg("_x").over(whole))
    ordered = whole.orderBy("_date").rowsBetween(Window.unboundedPreceding, 0)
    off = F.col("_x") - F.col("centre")
    ends = rows.select(*keys, F.count(F.lit(1)).over(ordered).alias("end"), "n", "centre",
                       F.sum(off).over(ordered).alias("s1"), F.sum(off * off).over(ordered).alias("s2"))
    zero = ends.where("end = 1").select(*keys, F.lit(0).cast("long").alias("end"), "n", "centre",
                                        F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))
    return ends.unionByName(zero)


def block_chains(sizes: DataFrame, by: Sequence[str], mean_block: float | str, replicates: int, seed: str) -> DataFrame:
    """(by, replicate, draw, start, used): the blocks of every replicate, the last one cut so that lengths sum to n.

    ``sizes`` has one row per set with its n. ``mean_block`` is a number or a column of ``sizes``; 1 gives the
    plain bootstrap. Replicates are dealt over the cluster before their draws are unfolded, so no draw moves.
    """
    keys = list(by)
    mean = F.col(mean_block) if isinstance(mean_block, str) else F.lit(float(mean_block))
    each = sizes.select(*keys, "n", mean.cast("double").alias("_mean"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    draws = each.repartition(*keys, "replicate").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("draw"))
    u = (_draw(1, seed) + 1) / F.lit(float(RANGE))
    length = F.when(F.col("_mean") > 1, 1 + F.floor(F.ln(u) / F.ln(1 - 1 / F.col("_mean")))).otherwise(1)
    chain = Window.partitionBy(*keys, "replicate").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    placed = (draws.withColumn("_len", F.least(length, F.col("n")).cast("long"))
              .withColumn("_before", F.sum("_len").over(chain) - F.col("_len")).where("_before < n"))
    return placed.select(*keys, "n", "replicate", "draw", F.pmod(_draw(0, seed), F.col("n")).alias("start"),
                         F.least(F.col("_len"), F.col("n") - F.col("_before")).alias("used"))


def replicate_statistics(returns: DataFrame, value: str, by: Sequence[str] = (), date: str = "date", mean_block: float | str = 5.0,
                         replicates: int = 1000, spacing: int | str = 5, seed: str = "bootstrap") -> DataFrame:
    """(by, replicate, mean, sharpe) of each replicate; ``spacing`` is the days between two values.

    ``mean_block`` and ``spacing`` may name columns of ``returns`` that are constant in a set. A set of one value has
    no Sharpe ratio; a set without values has no rows.
    """
    keys = list(by)
    on = list(dict.fromkeys([*keys, *[c for c in (mean_block, spacing) if isinstance(c, str)]]))
    sums = durable(prefix_sums(returns, value, on, date))
    chains = block_chains(sums.where("end = 0").select(*on, "n"), on, mean_block, replicates, seed)
    # two prefix sums a block; the tables have one row per set and calendar day, which bounds their broadcast
    left = F.broadcast(sums.select(*on, F.col("end").alias("start"), F.col("s1").alias("a1"), F.col("s2").alias("a2")))
    stop = F.col("start") + F.col("used")
    wrapped = stop > F.col("n")
    right = F.broadcast(sums.select(*on, F.col("end").alias("_end"), F.col("s1").alias("b1"), F.col("s2").alias("b2")))
    total = F.broadcast(sums.where("end = n").select(*on, "centre", F.col("s1").alias("t1"), F.col("s2").alias("t2")))
    blocks = (chains.withColumn("_end", F.when(wrapped, stop - F.col("n")).otherwise(stop)).withColumn("_wrapped", wrapped)
              .join(left, [*on, "start"]).join(right, [*on, "_end"]).join(total, on))
    gain = lambda k: F.col(f"b{k}") - F.col(f"a{k}") + F.when(F.col("_wrapped"), F.col(f"t{k}")).otherwise(0.0)
    each = blocks.groupBy(*on, "replicate").agg(F.max("n").alias("n"), F.max("centre").alias("centre"),
                                                F.sum(gain(1)).alias("s1"), F.sum(gain(2)).alias("s2"))
    n = F.col("n")
    spread = F.sqrt(F.greatest(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / n, n - 1), F.lit(0.0)))
    days = F.col(spacing) if isinstance(spacing, str) else F.lit(float(spacing))
    out = each.withColumn("mean", F.col("centre") + F.col("s1") / n).withColumn("_sd", F.when(n > 1, spread))
    return out.select(*keys, "replicate", "n", "mean", (F.col("mean") / (F.col("_sd") + F.lit(params.EPS))
                                                        * F.sqrt(F.lit(float(params.PERIODS_PER_YEAR)) / days)).alias("sharpe"))


def intervals(statistics: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Percentile intervals and standard errors of the replicates of :func:`replicate_statistics`."""
    ends = [(1 - level) / 2, (1 + level) / 2]
    parts = []
    for c in ("mean", "sharpe"):
        both = F.percentile(c, F.array(*[F.lit(e) for e in ends]))
        parts += [both[0].alias(f"{c}_low"), both[1].alias(f"{c}_high"), F.stddev_samp(c).alias(f"{c}_se")]
    return statistics.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), F.max("n").alias("n"), *parts)


def effective_size(returns: DataFrame, value: str, lags: int | str, by: Sequence[str] = (), date: str = "date", most: int = 252) -> DataFrame:
    """(by, n, mean, sd, n_eff): the number of independent values an autocorrelated series is worth.

    ``n_eff = n / (1 + 2 sum_k (1 - k / (lags + 1)) rho_k)`` over ``lags`` autocorrelations, a number or a column
    that is constant in a set, at most ``most``. Lagged products come from one window over a row per set and
    date; the lags of a row are an array, so the plan does not grow with them. A constant series has no n_eff.
    """
    keys = list(by)
    spec = Window.partitionBy(*(keys or [F.lit(0)]))
    rows = returns.where(F.col(value).isNotNull())
    lag = F.col(lags) if isinstance(lags, str) else F.lit(lags)
    rows = rows.select(*keys, F.col(date).alias("_date"), F.col(value).cast("double").alias("_x"), lag.cast("int").alias("_lags"))
    off = rows.withColumn("_e", F.col("_x") - F.avg("_x").over(spec))
    past = F.collect_list("_e").over(spec.orderBy("_date").rowsBetween(-most, -1))
    weighted = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_lags"), F.size("_past"))), F.lit(0.0), lambda acc, k: acc + F.when(
        F.size("_past") >= 1, (1 - k / (F.col("_lags") + 1)) * F.element_at("_past", -k)).otherwise(0.0))
    inner = F.when((F.col("_lags") > 0) & (F.size("_past") > 0), F.col("_e") * weighted).otherwise(0.0)
    sums = off.withColumn("_past", past).select(*keys, "_x", "_e", inner.alias("_c")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"),
        F.sum(F.col("_e") * F.col("_e")).alias("_v"), F.sum("_c").alias("_w"))
    inflation = F.lit(1.0) + 2 * F.try_divide("_w", "_v")
    # strongly alternating series would give more than n: they count as n
    return sums.select(*keys, "n", "mean", "sd", (F.col("n") / F.greatest(F.lit(1.0), inflation)).alias("n_eff"))


def detectable_effect(sizes: DataFrame, spacing: str | int, alpha: float = 0.05, power: float = 0.80) -> DataFrame:
    """Adds sharpe, n_floor and the smallest annualised Sharpe difference a two-sided test detects, by both sample sizes.

    The standard error of a Sharpe ratio per period is sqrt((1 + SR^2 / 2) / n). ``n_floor`` counts
    non-overlapping periods of ``spacing`` days, for a series with one value a day.
    """
    days = F.col(spacing) if isinstance(spacing, str) else F.lit(spacing)
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    year = F.sqrt(F.lit(float(params.PERIODS_PER_YEAR)) / days)
    per_period = F.col("mean") / (F.col("sd") + F.lit(params.EPS))
    effect = lambda n: F.lit(z) * F.sqrt((1 + per_period * per_period / 2) / n) * year
    floor = F.floor(F.col("n") / days)
    return (sizes.withColumn("n_floor", floor).withColumn("sharpe", per_period * year)
            .withColumn("mde_floor", F.when(F.col("n_floor") > 0, effect(F.col("n_floor")))).withColumn("mde_eff", effect(F.col("n_eff"))))
