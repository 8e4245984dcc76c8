"""Top-decile portfolios per date, their turnover, net returns and Sharpe ratios.

``by`` names the columns that tell score sets apart (model, arm, seed, cost, ...). Every
set is evaluated in the same job. A date's cross-section is the market, so selection
goes through the splitting rank operators; everything after the first aggregate is one
row per date and set.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import ranking


def top_fraction(scores: DataFrame, by: Sequence[str] = (), fraction: float = params.TOP_FRACTION,
                 date: str = "t", symbol: str = "symbol", score: str = "score",
                 direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """The best ceil(fraction * n) names per date, at least one, equally weighted in ``w``.

    Equal scores are ordered by symbol so that the pick is repeatable.
    """
    placed = ranking.positions(scores, [*by, date], [F.col(score).desc(), F.col(symbol)],
                               "_pos", "_n", direct_rows)
    k = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_n")))
    return (placed.where(F.col("_pos") <= k).withColumn("w", F.lit(1.0) / k).drop("_pos", "_n"))


def soft_weights(scores: DataFrame, tau: float, by: Sequence[str] = (),
                 fraction: float = params.TOP_FRACTION, date: str = "t", score: str = "score",
                 direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Sigmoid weights around the decile cut-off, summing to one per date.

    Cut-off, spread and total are windows over the date while the largest cross-section
    is measured to fit a task. Otherwise they are one aggregated row per date and set,
    joined back without a hint, so adaptive execution decides by measured size.
    """
    keys = [*by, date]
    eps = F.lit(params.WEIGHT_EPS)
    if ranking.group_sizes(scores, keys)[1] <= direct_rows:
        spec = Window.partitionBy(*keys)
        placed = scores.select(
            "*", F.percentile(score, F.lit(1.0 - fraction)).over(spec).alias("_q"),
            (F.stddev_pop(score).over(spec) + eps).alias("_sd"), F.count(F.lit(1)).over(spec).alias("_n"))
        raw = placed.withColumn("_w", _sigmoid(score, tau))
        summed = raw.withColumn("_sum", F.sum("_w").over(spec) + eps)
    else:
        cut = ranking.quantiles(scores, keys, score, [1.0 - fraction], "_cut")
        spread = scores.groupBy(*keys).agg((F.stddev_pop(score) + eps).alias("_sd"),
                                           F.count(F.lit(1)).alias("_n"))
        cut = ranking.join_null_safe(spread, cut, keys, "left").withColumn("_q", F.col("_cut")[0]).drop("_cut")
        raw = ranking.join_null_safe(scores, cut, keys).withColumn("_w", _sigmoid(score, tau))
        summed = ranking.join_null_safe(raw, raw.groupBy(*keys).agg((F.sum("_w") + eps).alias("_sum")), keys)
    weight = F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_w") / F.col("_sum"))
    return summed.withColumn("w", weight).drop("_q", "_sd", "_n", "_w", "_sum")


def _sigmoid(score: str, tau: float) -> Column:
    z = (F.col(score) - F.col("_q")) / (F.lit(tau) * F.col("_sd"))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))


def net_returns(weights: DataFrame, cost: float | Column = params.ONE_WAY_COST, by: Sequence[str] = (),
                date: str = "t", symbol: str = "symbol", y: str = "y") -> DataFrame:
    """gross, one-way turnover and net per date; the first rebalance is not charged.

    Each weight is stated on its own date and, negated, on the next one: the sums per
    name are the changes, names entered and left included, and the weighted returns add
    up alongside. One reading of the weights and two combining aggregations, no join.
    ``date`` must be a consecutive integer code.
    """
    keys = [*by, date]
    cost = F.lit(cost) if not isinstance(cost, Column) else cost
    own = F.struct(F.col(date).cast("long").alias(date), F.col("w").alias("_w"),
                   (F.col("w") * F.col(y)).alias("_wy"), F.lit(1).alias("_own"))
    gone = F.struct((F.col(date) + 1).cast("long").alias(date), (-F.col("w")).alias("_w"),
                    F.lit(None).cast("double").alias("_wy"), F.lit(0).alias("_own"))
    stated = weights.select(*by, symbol, F.explode(F.array(own, gone)).alias("_s")).select(*by, symbol, "_s.*")
    change = stated.groupBy(*keys, symbol).agg(F.sum("_w").alias("_w"), F.sum("_wy").alias("_wy"),
                                               F.max("_own").alias("_own"))
    per_date = change.groupBy(*keys).agg(
        F.sum("_wy").alias("gross"), (F.sum(F.abs("_w")) * F.lit(0.5)).alias("_moved"),
        F.max("_own").alias("_own")).where(F.col("_own") == 1)
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    first = F.col(date) == F.min(date).over(spec)
    return (per_date.withColumn("turnover", F.when(first, F.lit(0.0)).otherwise(F.col("_moved")))
            .withColumn("net", F.col("gross") - cost * F.col("turnover"))
            .select(*keys, "gross", "turnover", "net"))


def buy_and_hold(scores: DataFrame, by: Sequence[str] = (), date: str = "t", y: str = "y") -> DataFrame:
    """Equally weighted return of every name on each date, the passive baseline."""
    return scores.groupBy(*by, date).agg(F.avg(y).alias("gross"), F.count(F.lit(1)).alias("names"))


def dense_time(scores: DataFrame, by: Sequence[str] = (), date: str = "t") -> DataFrame:
    """Re-number the dates of each score set from 0 without gaps.

    Needed before :func:`net_returns` when a set covers a subset of the dates. The lookup
    has one row per date and set.
    """
    keys = [*by, date]
    spec = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(date)
    codes = scores.select(*keys).distinct().withColumn("_t", F.row_number().over(spec) - 1)
    return scores.join(codes, keys).withColumn(date, F.col("_t").cast("long")).drop("_t")


def hard_portfolio(scores: DataFrame, by: Sequence[str] = (), cost: float = params.ONE_WAY_COST,
                   fraction: float = params.TOP_FRACTION, date: str = "t", symbol: str = "symbol",
                   direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Net return per date of the equally weighted top fraction."""
    picked = top_fraction(scores, by, fraction, date, symbol, direct_rows=direct_rows)
    return net_returns(picked, cost, by, date, symbol)


def sharpe(value: Column | str, spacing: int = 5) -> Column:
    """Annualised Sharpe ratio as an aggregate over non-overlapping ``spacing``-day returns."""
    scale = math.sqrt(params.PERIODS_PER_YEAR / spacing)
    return F.avg(value) / (F.stddev_samp(value) + F.lit(params.EPS)) * F.lit(scale)


def cost_grid(net: DataFrame, costs_bps: Sequence[float], by: Sequence[str] = (), spacing: int = 5) -> DataFrame:
    """Sharpe at several cost levels from one set of gross returns and turnovers."""
    one = net.groupBy(*by).agg(*[
        sharpe(F.col("gross") - F.lit(c / 10_000.0) * F.col("turnover"), spacing).alias(f"s{i}")
        for i, c in enumerate(costs_bps)])
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cost_bps"), F.col(f"s{i}").alias("sharpe"))
                     for i, c in enumerate(costs_bps)])
    return one.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def performance(returns: DataFrame, by: Sequence[str] = (), value: str = "net", date: str = "t",
                spacing: int = 5, tail: float = 0.05) -> DataFrame:
    """Sharpe, Sortino, largest drawdown, Calmar and expected tail loss of a return series.

    One row per date and set comes in, so the running windows are short.
    """
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = spec.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.exp(F.sum(F.ln(F.lit(1.0) + F.col(value))).over(run))
    staged = returns.withColumn("_wealth", wealth)
    staged = staged.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(run)))
    staged = staged.withColumn("_cut", F.percentile(value, F.lit(tail)).over(spec))
    year = params.PERIODS_PER_YEAR / spacing
    down = F.sqrt(F.avg(F.pow(F.least(F.col(value), F.lit(0.0)), 2)))
    out = staged.groupBy(*by).agg(
        sharpe(value, spacing).alias("sharpe"),
        F.try_divide(F.avg(value), down).alias("_sortino"),
        F.max(1 - F.col("_wealth") / F.col("_peak")).alias("max_drawdown"),
        F.avg(value).alias("_mean"),
        F.avg(F.when(F.col(value) <= F.col("_cut"), F.col(value))).alias("cvar"))
    return out.select(
        *by, "sharpe", (F.col("_sortino") * math.sqrt(year)).alias("sortino"), "max_drawdown",
        F.try_divide(F.col("_mean") * year, F.col("max_drawdown")).alias("calmar"), "cvar")
