"""Causal features and forward labels of the panel.

All price windows share one partitioning and one ordering, so the whole family runs on
a single exchange and a single sort. Window statistics come first, wide ones merged from
narrow ones; the ratios built from them are plain projections. Operators of one symbol's
history take rows as a DataFrame or as a :class:`~panelspark.functions.blocks.Block`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions import ranking, rolling
from panelspark.functions.blocks import functions, series_of
from panelspark.functions.rolling import whole

KEYS = ("symbol", "date", "split")
LABEL_PREFIXES = ("fwd_ret_", "fwd_vol_")


def feature_columns(columns: Sequence[str]) -> list[str]:
    """Every column that is neither a key nor a forward label."""
    return [c for c in columns if c not in KEYS and not c.startswith(LABEL_PREFIXES)]


def _nonzero(x: Column, f=F) -> Column:
    return f.nullif(x, f.lit(0.0))


def kline_shape(f=F) -> dict[str, Column]:
    """Candle shape of one bar, relative to its open and to its range."""
    o, h, l, c = (f.col(k) for k in "ohlc")
    top = f.when(o.isNotNull() & c.isNotNull(), f.greatest(o, c))
    bottom = f.when(o.isNotNull() & c.isNotNull(), f.least(o, c))
    spread = _nonzero(h - l, f) + f.lit(params.EPS)
    balance = c * 2 - h - l
    return {
        "KMID": (c - o) / _nonzero(o, f), "KLEN": (h - l) / _nonzero(o, f),
        "KMID2": f.try_divide(c - o, spread), "KUP": (h - top) / _nonzero(o, f),
        "KLOW": (bottom - l) / _nonzero(o, f), "KSFT": balance / _nonzero(o, f),
        "KSFT2": f.try_divide(balance, spread),
    }


def _log_pair(bars: DataFrame) -> DataFrame:
    """Log close and log volume, each NULL unless both are there."""
    f = functions(bars)
    both = f.col("c").isNotNull() & f.col("v").isNotNull()
    return (bars
            .withColumn("lc", f.when(both, f.ln(f.greatest(f.col("c"), f.lit(params.EPS)))))
            .withColumn("lv", f.when(both, f.ln(f.greatest(f.col("v"), f.lit(1.0)) + 1))))


def price_features(bars: DataFrame, lags: Sequence[int] = params.RETURN_LAGS,
                   windows: Sequence[int] = params.ROLL_WINDOWS,
                   correlations: Sequence[int] = params.CORR_WINDOWS,
                   momenta: Sequence[int] = params.MOMENTUM_WINDOWS,
                   keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Candle, return, rolling, correlation and momentum features of adjusted bars.

    ``keys`` may add columns to the series key (a scenario tag, for example); they are
    kept in the result.
    """
    spec, f = series_of(bars, *keys), functions(bars)
    shifted = [f.lag("c", k).over(spec).alias(f"_lag{k}") for k in sorted({*lags, *momenta})]
    staged = bars.select("*", *shifted)
    staged = rolling.add_windows(staged, spec, windows, moments="cv", highs="h", lows="l")
    if correlations:
        staged = rolling.add_windows(_log_pair(staged), spec, correlations, moments=("lc", "lv"),
                                     pairs=[("lc", "lv")])

    f = functions(staged)
    c, v = f.col("c"), f.col("v") + f.lit(params.EPS)
    out = kline_shape(f)
    for k in lags:
        out[f"RET_{k}"] = f.ln(c / f.col(f"_lag{k}"))
    for w in windows:
        high, low = f.col(rolling.high_of("h", w)), f.col(rolling.low_of("l", w))
        out[f"MA_{w}"] = f.col(rolling.mean_of("c", w)) / c
        out[f"STD_{w}"] = rolling.deviation("c", w, f) / c
        out[f"MAX_{w}"], out[f"MIN_{w}"] = high / c, low / c
        out[f"RSV_{w}"] = f.try_divide(c - low, high - low + f.lit(params.EPS))
        out[f"VMA_{w}"] = f.try_divide(f.col(rolling.mean_of("v", w)), v)
        out[f"VSTD_{w}"] = f.try_divide(rolling.deviation("v", w, f), v)
    for w in correlations:
        out[f"CORR_{w}"] = rolling.correlation("lc", "lv", w, f)
    for w in momenta:
        out[f"MOM_{w}"] = c / f.col(f"_lag{w}") - 1
    kept = [k for k in bars.columns if k not in out]
    return staged.select(*kept, *[column.alias(name) for name, column in out.items()])


def forward_labels(bars: DataFrame, horizons: Sequence[int] = params.HORIZONS) -> DataFrame:
    """Forward log return, and sample deviation of the next H one-day log returns."""
    spec, f = series_of(bars, "symbol"), functions(bars)
    stepped = bars.select("*", f.ln(f.col("c") / f.lag("c", 1).over(spec)).alias("r1"),
                          *[f.lead("c", h).over(spec).alias(f"_lead{h}") for h in horizons])
    staged = rolling.add_windows(stepped, spec, horizons, moments=["r1"], ahead=True)
    f = functions(staged)
    labels = []
    for h in horizons:
        labels.append(f.ln(f.col(f"_lead{h}") / f.col("c")).alias(f"fwd_ret_{h}"))
        labels.append(rolling.deviation("r1", h, f).alias(f"fwd_vol_{h}"))
    return staged.select(*bars.columns, *labels)


def join_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Left join of daily sentiment; both sides are unique per (symbol, date)."""
    return bars.join(sentiment.withColumn("_matched", F.lit(1)), ["symbol", "date"], "left")


def sentiment_features(joined: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Sentiment columns of the panel from rows made by :func:`join_sentiment`.

    A symbol without any sentiment row has NULLs throughout; a day without one has
    zero news, zero dispersion and no news flag.
    """
    spec, f = series_of(joined, *keys), functions(joined)
    s = f.col("sent_decay")
    staged = joined.select("*", f.lag(s, 1).over(spec).alias("_before"),
                           f.max("_matched").over(whole(spec)).alias("_any"))
    staged = rolling.add_windows(staged, spec, (5, 20), moments=["sent_decay"])
    f = functions(staged)
    s, covered = f.col("sent_decay"), f.col("_any") == 1
    out = {
        "SENT": s, "SENT_DELTA": s - f.col("_before"),
        "SENT_MA_5": f.col(rolling.mean_of("sent_decay", 5)),
        "SENT_MA_20": f.col(rolling.mean_of("sent_decay", 20)),
        "SENT_STD_20": rolling.deviation("sent_decay", 20, f),
        "DSN": f.col("days_since_news"),
        "NEWS_INT": f.when(covered, f.log1p(f.coalesce(f.col("news_intensity"), f.lit(0)))),
        "SENT_DISP": f.when(covered, f.coalesce(f.col("sent_dispersion"), f.lit(0.0))),
        "HAS_NEWS": f.when(covered, f.coalesce(f.col("has_news"), f.lit(False)).cast("byte")),
    }
    source = ("sent_decay", "sent_raw", "news_intensity", "sent_dispersion",
              "days_since_news", "has_news", "_matched")
    kept = [c for c in joined.columns if c not in source]
    return staged.select(*kept, *[column.alias(name) for name, column in out.items()])


def cross_sectional_ranks(panel: DataFrame, sources: Sequence[str] = params.XS_SOURCES,
                          by: Sequence[str] = ("date",),
                          direct_rows: int = ranking.DIRECT_ROWS,
                          sizes: tuple[int, int] | None = None) -> DataFrame:
    """Percentile rank of raw feature values among the names of the same date.

    Ranks come before normalisation and use the day's values only. The date group is
    as large as the market, so ranking splits it when it outgrows one task. ``sizes`` is a result
    of ``ranking.group_sizes`` for these rows, where it is known.
    """
    sizes = sizes or ranking.group_sizes(panel, by)
    for name in sources:
        panel = (ranking.average_rank(panel, by, name, "_rank", "_ranked", direct_rows, sizes)
                 .withColumn(f"XS_{name}", F.col("_rank") / F.col("_ranked"))
                 .drop("_rank", "_ranked"))
    return panel


def to_storage_types(panel: DataFrame) -> DataFrame:
    """Single precision features and labels, HAS_NEWS as a byte."""
    f = functions(panel)
    return panel.select(*[
        f.col(c) if c in KEYS else
        f.col(c).cast("byte").alias(c) if c == "HAS_NEWS" else f.col(c).cast("float").alias(c)
        for c in panel.columns])
