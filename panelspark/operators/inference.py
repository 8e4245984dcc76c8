"""Rank correlations, decile curves, Deflated Sharpe, overfitting probability, accept rule."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import ranking
from panelspark.functions.normal import normal_cdf, normal_quantile
from panelspark.operators import portfolio
from panelspark.operators.folds import symmetric_folds
from panelspark.params import AcceptRule
from panelspark.session import durable


def pooled_ic(rows: DataFrame, x: str, y: str, by: Sequence[str] = (),
              direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """One Spearman correlation over all rows of a set."""
    return ranking.rank_correlation(rows, by, x, y, "ic", direct_rows).drop("distinct_x")


def daily_ic(rows: DataFrame, x: str, y: str, by: Sequence[str] = (), date: str = "date",
             min_distinct: int = 4, direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Cross-sectional Spearman per date, for dates with enough distinct x."""
    per_date = ranking.rank_correlation(rows, [*by, date], x, y, "ic", direct_rows)
    return (per_date.where((F.col("distinct_x") > min_distinct) & F.col("ic").isNotNull())
            .drop("distinct_x"))


def ic_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean daily IC with its naive t statistic."""
    mean, days = F.avg("ic"), F.count(F.lit(1))
    return daily.groupBy(*by).agg(
        mean.alias("mean_ic"), days.alias("days"),
        F.when(days > 2, mean / (F.stddev_samp("ic") / F.sqrt(days))).alias("t"))


def matched_signal(signal: DataFrame, bars: DataFrame, labels: Sequence[str], min_rows: int = 30) -> DataFrame:
    """Signal rows with forward returns on the same (symbol, date), for symbols with
    at least ``min_rows`` matches. Both sides are unique per (symbol, date)."""
    joined = signal.join(bars.select("symbol", "date", *labels), ["symbol", "date"])
    joined = joined.where(F.col(labels[0]).isNotNull())
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    return joined.withColumn("_n", size).where(F.col("_n") >= min_rows).drop("_n")


def unit_ic(scored: DataFrame, bars: DataFrame, units: Sequence[str], label: str, min_rows: int = 10) -> DataFrame:
    """Spearman correlation of each text unit's score with the return after its day, over single articles.

    A symbol has many articles a day and all of them count; symbols with fewer than ``min_rows`` matched
    articles do not. The number of articles of a symbol is one aggregate joined back, so a symbol with a third of
    all articles is in no window. One row per unit: unit, ic, n.
    """
    joined = durable(scored.select("symbol", "date", *units).join(bars.select("symbol", "date", label), ["symbol", "date"])
                     .where(F.col(label).isNotNull()))
    enough = joined.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    kept = joined.join(enough.select("symbol"), "symbol", "left_semi")
    tall = kept.select(label, F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("double").alias("score"))
                                                  for u in units])).alias("_u")).select(label, "_u.*")
    return pooled_ic(tall.where(F.col("score").isNotNull()), "score", label, ["unit"]).select("unit", "ic", "n")


def decile_of(position: Column, n: Column, bins: int = 10) -> Column:
    """0-based bin of a 1-based position when n positions are cut at even quantiles."""
    return F.greatest(F.lit(1), F.ceil((position - 1) * bins / (n - 1))) - 1


def decile_curve(rows: DataFrame, signal: str, outcome: str, tie_break: Sequence[str],
                 bins: int = 10, direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Mean outcome per signal bin over the whole table. The rows are stored: they are counted before they are put in order."""
    rows = durable(rows.select(*dict.fromkeys([signal, outcome, *tie_break])))
    order = [F.col(signal), *[F.col(c) for c in tie_break]]
    placed = ranking.positions(rows, [], order, "_pos", "_n", direct_rows)
    binned = placed.withColumn("decile", decile_of(F.col("_pos"), F.col("_n"), bins).cast("int"))
    return binned.groupBy("decile").agg(F.avg(outcome).alias("mean_fwd"), F.count(F.lit(1)).alias("n"))


def monotonicity(curve: DataFrame) -> DataFrame:
    """Correlation of bin index with bin mean, and the top minus bottom spread."""
    x, y = F.col("decile").cast("double"), F.col("mean_fwd")
    return curve.agg(
        F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("mono"),
        (F.max_by(y, x) - F.min_by(y, x)).alias("spread"))


def average_scores(cells: DataFrame, by: Sequence[str] = ("model", "arm"), date: str = "date_id",
                   symbol: str = "sym_id") -> DataFrame:
    """Out-of-sample ensemble: mean score per (date, symbol) over seeds and folds.

    The label is the same in every cell of a key, so its maximum stands for the first.
    """
    return cells.groupBy(*by, date, symbol).agg(F.max("y").alias("y"), F.avg("score").alias("score"))


def pair_arms(scores: DataFrame, arms: Sequence[str] = ("risk", "mse"), shared: str = "ridge",
              date: str = "date_id", symbol: str = "sym_id") -> DataFrame:
    """Scores of every model's arms side by side with the shared comparator.

    Arms are turned into columns by one conditional aggregation; rows that lack an arm
    drop out, as in an inner join. The comparator belongs to no model and is joined once.
    """
    own = (scores.where(F.col("arm").isin(*arms)).groupBy("model", date, symbol)
           .agg(F.max("y").alias("y"),
                *[F.max(F.when(F.col("arm") == a, F.col("score"))).alias(f"s_{a}") for a in arms]))
    for a in arms:
        own = own.where(F.col(f"s_{a}").isNotNull())
    common = scores.where(F.col("arm") == shared).select(date, symbol, F.col("score").alias(f"s_{shared}"))
    return own.join(common, [date, symbol])


def expected_max_sharpe(trials: int) -> float:
    """Mean of the largest of ``trials`` unit-variance Sharpe ratios with no skill."""
    g = params.EULER_GAMMA
    return ((1 - g) * normal_quantile(1 - 1.0 / trials) + g * normal_quantile(1 - 1.0 / (trials * math.e)))


def deflated_sharpe(returns: DataFrame, value: str, by: Sequence[str] = (), spacing: int = 5,
                    trials: int = params.DSR_TRIALS, tag: str = "") -> DataFrame:
    """Annualised Sharpe of a difference series, its moments, the deflated z and p.

    Moments are population moments about the mean with the guard of the defining
    formula.
    """
    eps = F.lit(params.EPS)
    base = returns.groupBy(*by).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"),
        F.stddev_samp(value).alias("_s1"), F.stddev_pop(value).alias("_s0"),
        F.coalesce(F.skewness(value), F.lit(0.0)).alias("_sk"),
        F.coalesce(F.kurtosis(value), F.lit(-3.0)).alias("_ku"))
    n, s0 = F.col("_n"), F.col("_s0")
    g3 = F.col("_sk") * F.pow(s0, 3) / (F.pow(s0, 3) + eps)
    g4 = (F.col("_ku") + 3) * F.pow(s0, 4) / (F.pow(s0, 4) + eps)
    steps = F.greatest(n - 1, F.lit(1))
    staged = base.select(*by, n.alias("_n"), (F.col("_m") / (F.col("_s1") + eps)).alias("_sr"),
                         g3.alias("g3"), g4.alias("g4"), steps.alias("_k"))
    sr = F.col("_sr")
    hurdle = F.sqrt(F.lit(1.0) / F.col("_k")) * F.lit(expected_max_sharpe(trials))
    spread = F.sqrt(F.greatest(1 - F.col("g3") * sr + (F.col("g4") - 1) / 4 * sr * sr, F.lit(1e-9)))
    z = (sr - hurdle) * F.sqrt(F.col("_k")) / spread
    scored = staged.withColumn("_z", z).withColumn("_dsr", normal_cdf(F.col("_z")))
    return scored.select(
        *by, F.col("_n").alias(f"n{tag}"),
        (sr * math.sqrt(params.PERIODS_PER_YEAR / spacing)).alias(f"sr{tag}"),
        F.col("g3").alias(f"g3{tag}"), F.col("g4").alias(f"g4{tag}"), F.col("_z").alias(f"z{tag}"),
        F.col("_dsr").alias(f"dsr{tag}"), (1 - F.col("_dsr")).alias(f"p{tag}"))


def overfitting_probability(performance: DataFrame, by: Sequence[str] = (), date: str = "t",
                            groups: int = params.CSCV_GROUPS) -> DataFrame:
    """Share of symmetric splits whose in-sample best is at or below the median outside.

    ``performance`` is one row per (set, date, config, config order, value): a table with
    dates times configurations rows. Fold roles are per date, so the 252 splits multiply
    that small table only.
    """
    keys = list(by)
    dates = performance.select(*keys, F.col(date).alias("date"))
    roles = symmetric_folds(dates, groups, by=keys).select(
        *keys, "fold", F.col("date").alias(date), "role")
    inside = F.col("role") == "train"
    means = (performance.join(roles, [*keys, date]).groupBy(*keys, "fold", "config")
             .agg(F.avg(F.when(inside, F.col("value"))).alias("is_mean"),
                  F.avg(F.when(~inside, F.col("value"))).alias("oos_mean"))
             .where(F.col("is_mean").isNotNull() & F.col("oos_mean").isNotNull()))
    spec = Window.partitionBy(*keys, "fold")
    ranked = means.select(
        "*", F.row_number().over(spec.orderBy(F.col("is_mean").desc(), "config")).alias("_best"),
        F.row_number().over(spec.orderBy("oos_mean", "config")).alias("_rank"),
        F.count(F.lit(1)).over(spec).alias("_n"))
    share = F.col("_rank") / (F.col("_n") + 1)
    share = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), share))
    logits = ranked.where(F.col("_best") == 1).withColumn("logit", F.ln(share / (1 - share)))
    return logits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_splits"),
        F.avg((F.col("logit") <= 0).cast("int")).alias("pbo"))


def arm_returns(paired: DataFrame, arms: Sequence[str], by: Sequence[str] = ("model",),
                cost: float = params.ONE_WAY_COST, date: str = "date_id", symbol: str = "sym_id",
                direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """gross/net per (set, arm, date) for the arms of :func:`pair_arms`, in one job."""
    tall = paired.select(*by, date, symbol, "y", F.explode(F.array(*[
        F.struct(F.lit(a).alias("arm"), F.col(f"s_{a}").alias("score")) for a in arms])).alias("_a"))
    tall = tall.select(*by, date, symbol, "y", "_a.*")
    tall = portfolio.dense_time(tall, [*by, "arm"], date)
    return portfolio.hard_portfolio(tall, [*by, "arm"], cost, date=date, symbol=symbol,
                                    direct_rows=direct_rows)


def contrast(paired: DataFrame, by: Sequence[str] = ("model",), spacing: int = 5,
             rule: AcceptRule = AcceptRule(), trials: int = params.DSR_TRIALS,
             cost: float = params.ONE_WAY_COST, date: str = "date_id", symbol: str = "sym_id",
             min_rows: int = 50) -> DataFrame:
    """The paired contrast of the risk arm with the mse and ridge arms, one row per set."""
    keys = list(by)
    arms = ("risk", "mse", "ridge")
    enough = paired.join(paired.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
                         .where(F.col("_n") >= min_rows).select(*keys), keys, "left_semi")
    returns = durable(arm_returns(enough, arms, keys, cost, date, symbol))
    wide = returns.groupBy(*keys, date).agg(*[
        F.max(F.when(F.col("arm") == a, F.col("net"))).alias(a) for a in arms])
    wide = wide.withColumn("d_mse", F.col("risk") - F.col("mse")).withColumn("d_ridge", F.col("risk") - F.col("ridge"))
    out = wide.groupBy(*keys).agg(*[portfolio.sharpe(a, spacing).alias(f"sharpe_{a}") for a in arms])
    for other in ("mse", "ridge"):
        d = deflated_sharpe(wide, f"d_{other}", keys, spacing, trials)
        out = out.join(d.select(*keys, F.col("sr").alias(f"dSharpe_vs_{other}"),
                                F.col("dsr").alias(f"DSR_vs_{other}"), F.col("p").alias(f"p_vs_{other}")), keys, "left")
    ic = (pooled_ic(enough, "s_risk", "y", keys).select(*keys, F.col("ic").alias("_ic_risk"))
          .join(pooled_ic(enough, "s_mse", "y", keys).select(*keys, F.col("ic").alias("_ic_mse")), keys))
    config = F.array_position(F.lit(list(arms)), F.col("arm"))
    performance = returns.select(*keys, date, config.alias("config"), F.col("gross").alias("value"))
    pbo = overfitting_probability(performance, keys, date).select(*keys, F.col("pbo").alias("PBO"))
    # a set without a valid split or rank correlation stays, with NULL, and is not accepted
    out = (out.join(ic, keys, "left").withColumn("dRankIC_vs_mse", F.col("_ic_risk") - F.col("_ic_mse"))
           .drop("_ic_risk", "_ic_mse").join(pbo, keys, "left"))
    return out.withColumn("H1_ACCEPT", accept(rule))


def accept(rule: AcceptRule) -> Column:
    test = (F.col("dRankIC_vs_mse") >= rule.min_rank_ic_gain) & (F.col("PBO") <= rule.max_pbo)
    for other in ("mse", "ridge"):
        test = (test & (F.col(f"dSharpe_vs_{other}") >= rule.min_sharpe_gain)
                & (F.col(f"p_vs_{other}") < rule.max_p))
    return F.coalesce(test, F.lit(False))


def verdict(contrasts: DataFrame) -> DataFrame:
    """True when any set was accepted."""
    return contrasts.agg(F.coalesce(F.bool_or("H1_ACCEPT"), F.lit(False)).alias("any_accept"),
                         F.count(F.lit(1)).alias("sets"))


def seed_dispersion(cells: DataFrame, test_dates: DataFrame, arm: str = "risk", spacing: int = 5,
                    date: str = "date_id", symbol: str = "sym_id") -> DataFrame:
    """Net Sharpe per seed; descriptive only."""
    kept = cells.where(F.col("arm") == arm).join(F.broadcast(test_dates.select(date)), date, "left_semi")
    per_seed = durable(average_scores(kept, ["model", "seed"], date, symbol))
    dense = portfolio.dense_time(per_seed, ["model", "seed"], date)
    net = portfolio.hard_portfolio(dense, ["model", "seed"], date=date, symbol=symbol)
    return (net.groupBy("model", "seed").agg(portfolio.sharpe("net", spacing).alias("sharpe"),
                                             F.count(F.lit(1)).alias("periods"))
            .where(F.col("periods") > 1))


def quicklook(cells: DataFrame, test_dates: DataFrame, spacing: int = 5, min_rows: int = 20,
              date: str = "date_id", symbol: str = "sym_id") -> DataFrame:
    """Cells, rows, Sharpe and rank IC per (model, arm); short groups have NULL results."""
    keys = ["model", "arm"]
    files = cells.groupBy(*keys, "seed", "fold").agg(F.lit(1).alias("_one")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"))
    scores = durable(average_scores(cells, keys, date, symbol).join(
        F.broadcast(test_dates.select(date)), date, "left_semi"))
    size = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    net = portfolio.hard_portfolio(portfolio.dense_time(scores, keys, date), keys, date=date, symbol=symbol)
    perf = net.groupBy(*keys).agg(portfolio.sharpe("net", spacing).alias("sharpe"))
    ic = pooled_ic(scores, "score", "y", keys).select(*keys, "ic")
    out = files.join(size, keys, "left").fillna(0, ["rows"]).join(perf, keys, "left").join(ic, keys, "left")
    enough = F.col("rows") >= min_rows
    return out.select(*keys, "cells", "rows", F.when(enough, F.col("sharpe")).alias("sharpe"),
                      F.when(enough, F.col("ic")).alias("ic"))


def arm_gain(look: DataFrame) -> DataFrame:
    """Risk minus mse per model, from :func:`quicklook`."""
    parts = [F.max(F.when(F.col("arm") == a, F.col(m))).alias(f"_{m}_{a}")
             for a in ("risk", "mse") for m in ("sharpe", "ic")]
    return look.groupBy("model").agg(*parts).select(
        "model", (F.col("_sharpe_risk") - F.col("_sharpe_mse")).alias("dsharpe"),
        (F.coalesce("_ic_risk", F.lit(0.0)) - F.coalesce("_ic_mse", F.lit(0.0))).alias("drankic")).where(
        F.col("dsharpe").isNotNull())


def objective(scores: DataFrame, tau: float, cost: float = params.ONE_WAY_COST, weights=(0.7, 0.5, 0.5),
              date: str = "t", symbol: str = "symbol") -> DataFrame:
    """Composite objective of a scored table: -Sharpe of the soft portfolio, MSE, Gaussian NLL.

    ``scores`` has score (mu), logvar and y. An evaluation metric; nothing is trained.
    """
    a, g, b = weights
    soft = portfolio.soft_weights(scores, tau, date=date)
    net = portfolio.net_returns(soft, cost, date=date, symbol=symbol)
    l_sr = net.agg((-F.avg("net") / (F.stddev_samp("net") + F.lit(params.WEIGHT_EPS)))).scalar()
    err = F.col("y") - F.col("score")
    nll = 0.5 * (F.col("logvar") + err * err / (F.exp("logvar") + F.lit(params.WEIGHT_EPS)))
    rows = scores.agg(F.avg(err * err).alias("l_anchor"), F.avg(nll).alias("l_nll"))
    return rows.select(l_sr.alias("l_sr"), "l_anchor", "l_nll").withColumn(
        "total", F.lit(a) * F.col("l_sr") + F.lit(g) * F.col("l_anchor") + F.lit(b) * F.col("l_nll"))


def selection_metric(scores: DataFrame, arm: str, spacing: int = 5, date: str = "t",
                     symbol: str = "symbol") -> DataFrame:
    """Validation metric: zero-cost hard Sharpe for the risk arm, -MSE for the mse arm."""
    if arm == "mse":
        return scores.agg((-F.avg(F.pow(F.col("score") - F.col("y"), 2))).alias("metric"))
    net = portfolio.hard_portfolio(scores, cost=0.0, date=date, symbol=symbol)
    return net.agg(portfolio.sharpe("net", spacing).alias("metric"))


def newey_west(returns: DataFrame, value: str, lags: int, by: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Mean of an overlapping return series with its Newey-West standard error.

    Bartlett weights on ``lags`` autocovariances, which are lagged products of the
    centred series: one row per date and set, one window stage.
    """
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    centred = returns.withColumn("_e", F.col(value) - F.avg(value).over(spec))
    lagged = centred.select("*", *[F.lag("_e", k).over(spec.orderBy(date)).alias(f"_e{k}")
                                   for k in range(1, lags + 1)])
    total = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        total = total + F.lit(2 * (1 - k / (lags + 1))) * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    n = F.count(F.lit(1))
    out = lagged.groupBy(*by).agg(F.avg(value).alias("mean"), (F.sqrt(F.greatest(total, F.lit(0.0))) / n).alias("se"),
                                  n.alias("n"))
    return out.withColumn("t", F.try_divide("mean", "se"))


def false_discovery(tests: DataFrame, p: str = "p", level: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg: adds rank, adjusted p and rejection. One row per test comes in.

    Equal p values are ranked by the other columns; their adjusted values are the same.
    """
    spec = Window.partitionBy(F.lit(0))
    m = F.count(F.lit(1)).over(spec)
    ranked = tests.withColumn("bh_rank", F.row_number().over(spec.orderBy(p, *[c for c in tests.columns if c != p]))).withColumn("_m", m)
    raw = F.col(p) * F.col("_m") / F.col("bh_rank")
    adjusted = F.min(raw).over(spec.orderBy(F.col("bh_rank").desc()).rowsBetween(Window.unboundedPreceding, 0))
    out = ranked.withColumn("p_adjusted", F.least(F.lit(1.0), adjusted))
    return out.withColumn("rejected", F.col("p_adjusted") <= level).drop("_m")
