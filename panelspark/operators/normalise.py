"""Per-symbol normalisation fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions.blocks import Block, functions, series_of


def clip(z: Column, limit: float = params.Z_LIMIT, f=F) -> Column:
    """Winsorise, keeping NULL (``least`` and ``greatest`` would skip it)."""
    return f.when(z.isNotNull(), f.greatest(f.lit(-limit), f.least(f.lit(limit), z)))


def train_stats(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and sample deviation per symbol over train rows, one pass for all features."""
    moments = []
    for f in features:
        moments.append(F.avg(f).alias(f"{f}__mu"))
        moments.append(F.nullif(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}__sd"))
    return panel.where(F.col("split") == "train").groupBy("symbol").agg(*moments)


def apply_stats(panel: DataFrame, stats: DataFrame, features: Sequence[str],
                limit: float = params.Z_LIMIT) -> DataFrame:
    """z-score a stored panel with stored statistics.

    One statistics row per symbol grows with the market, so the join carries no
    broadcast hint: adaptive execution broadcasts it when it measures small.
    """
    z = {f: clip((F.col(f) - F.col(f"{f}__mu")) / F.col(f"{f}__sd"), limit) for f in features}
    joined = panel.join(stats, "symbol", "left")
    return joined.select(*[z[c].alias(c) if c in z else F.col(c) for c in panel.columns])


def fit_apply(panel: DataFrame, features: Sequence[str],
              limit: float = params.Z_LIMIT) -> DataFrame:
    """Fit and apply in one pass over the symbol partitions.

    Same values as ``apply_stats(panel, train_stats(panel))``, without evaluating the
    panel twice: the moments are window aggregates that read train rows only.
    """
    spec, f = series_of(panel, "symbol", order=None), functions(panel)
    train = f.col("split") == "train"
    moments = []
    if isinstance(panel, Block):
        for c, mean, deviation in zip(features, *panel.moments(features, train.true())):
            moments += [mean.alias(f"{c}__mu"), f.nullif(deviation, f.lit(0.0)).alias(f"{c}__sd")]
    else:
        for c in features:
            value = f.when(train, f.col(c))
            moments.append(f.avg(value).over(spec).alias(f"{c}__mu"))
            moments.append(f.nullif(f.stddev_samp(value).over(spec), f.lit(0.0)).alias(f"{c}__sd"))
    staged = panel.select("*", *moments)
    f = functions(staged)
    z = {c: clip((f.col(c) - f.col(f"{c}__mu")) / f.col(f"{c}__sd"), limit, f) for c in features}
    return staged.select(*[z[c].alias(c) if c in z else f.col(c) for c in panel.columns])
