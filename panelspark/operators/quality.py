"""Quality gates: proofs that the panel and the sentiment table do not look ahead."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import ranking
from panelspark.functions.rolling import series
from panelspark.operators import features as X
from panelspark.operators.alignment import align
from panelspark.operators.sampling import evenly_spaced
from panelspark.operators.universe import gate_rows

CAUSAL_FEATURES = ("RET_20", "MA_20", "KMID", "CORR_20", "RSV_20", "VMA_20", "VSTD_20",
                   "MOM_20", "SENT_MA_20")


def _differs(a: Column, b: Column, tolerance: float) -> Column:
    """NULL must meet NULL; numbers must agree within the tolerance."""
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def _causal_block(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The audited features of bars (with daily sentiment columns joined on)."""
    price = X.price_features(rows, lags=(20,), windows=(20,), correlations=(20,), momenta=(20,), keys=keys)
    return X.sentiment_features(price, keys)


def truncation(rows: DataFrame, at: float = 0.7, features: Sequence[str] = CAUSAL_FEATURES,
               tolerance: float = 1e-9) -> DataFrame:
    """Per feature, values checked and values that move when the future is deleted.

    Each symbol is cut after the given fraction of its history and recomputed without
    the later rows. Both versions run in one job as two scenarios of the same rows.
    """
    spec = Window.partitionBy("symbol")
    placed = rows.select("*", F.row_number().over(spec.orderBy("date")).alias("_i"),
                         F.count(F.lit(1)).over(spec).alias("_n"))
    kept = F.col("_i") <= F.floor(F.col("_n") * at) + 1
    versions = F.when(kept, F.array(F.lit("full"), F.lit("cut"))).otherwise(F.array(F.lit("full")))
    both = placed.select(*rows.columns, kept.alias("_kept"), F.explode(versions).alias("version"))
    block = _causal_block(both, ["version", "symbol"]).where(F.col("_kept"))
    sides = block.groupBy("symbol", "date").agg(*[
        F.max(F.when(F.col("version") == v, F.col(f))).alias(f"{f}_{v}")
        for f in features for v in ("full", "cut")])
    checks = []
    for f in features:
        a, b = F.col(f"{f}_full"), F.col(f"{f}_cut")
        checks += [F.count_if(a.isNotNull() | b.isNotNull()).alias(f"n_{f}"),
                   F.count_if(_differs(a, b, tolerance)).alias(f"bad_{f}")]
    one = sides.agg(*checks)
    out = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n_{f}").alias("checked"),
                             F.col(f"bad_{f}").alias("bad")) for f in features])
    return one.select(F.explode(out).alias("r")).select("r.*")


def rank_truncation(rows: DataFrame, cuts: int = 40, skip: int = 60, min_names: int = 20, reach: int = 21,
                    sources: Sequence[str] = ("RET_20", "MOM_20", "MA_20"),
                    tolerance: float = 1e-9) -> DataFrame:
    """Cross-sectional ranks at sampled dates, with and without the rows after the date.

    The truncated side is recomputed from slices: each symbol's last ``reach`` rows up to a sampled date, which
    is all that the audited features look back on. A row joins the slices of the sampled dates among its
    symbol's next rows, found in one window, so at most cuts x reach x symbols rows are recomputed.
    """
    dates = evenly_spaced(rows, cuts, skip, skip).select(F.col("date").alias("cut"))
    ends = dates.agg(F.array_sort(F.collect_list("cut"))).scalar()
    tagged = rows.withColumn("_ends", ends)
    sampled = F.array_contains("_ends", F.col("date"))
    ahead = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, reach - 1)
    slices = (tagged.withColumn("_cuts", F.collect_list(F.when(sampled, F.col("date"))).over(ahead))
              .select(*rows.columns, F.explode("_cuts").alias("cut")))

    def featured(df: DataFrame, *more: str) -> DataFrame:
        return X.price_features(df, lags=(20,), windows=(20,), correlations=(), momenta=(20,), keys=[*more, "symbol"])

    cut = featured(slices, "cut").where(F.col("cut") == F.col("date")).select("symbol", "date", F.lit(False).alias("whole"), *sources)
    whole = featured(tagged).where(sampled).select("symbol", "date", F.lit(True).alias("whole"), *sources)
    at_cut = whole.unionByName(cut)
    ranked = X.cross_sectional_ranks(at_cut, sources, by=["whole", "date"])
    checks = []
    for s in sources:
        for side, flag in (("full", F.col("whole")), ("cut", ~F.col("whole"))):
            checks.append(F.max(F.when(flag, F.col(f"XS_{s}"))).alias(f"{s}_{side}"))
    pairs = ranked.groupBy("symbol", "date").agg(*checks)
    per_date = pairs.groupBy("date").agg(*[c for s in sources for c in (
        F.count_if(F.col(f"{s}_full").isNotNull() & F.col(f"{s}_cut").isNotNull()).alias(f"n_{s}"),
        F.count_if(_differs(F.col(f"{s}_full"), F.col(f"{s}_cut"), tolerance)).alias(f"bad_{s}"))])
    out = F.array(*[F.struct(F.lit(f"XS_{s}").alias("feature"), F.col(f"n_{s}").alias("names"),
                             F.col(f"bad_{s}").alias("bad")) for s in sources])
    return (per_date.select("date", F.explode(out).alias("r")).select("date", "r.*")
            .where(F.col("names") >= min_names))


def moment_gates(raw: DataFrame, stats: DataFrame, features: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Stored statistics equal the train moments, and are not the moments of all rows."""
    train = F.col("split") == "train"
    moments = raw.groupBy("symbol").agg(*[c for f in features for c in (
        F.avg(F.when(train, F.col(f))).alias(f"{f}_train"), F.avg(f).alias(f"{f}_all"))])
    joined = moments.join(stats, "symbol")
    off, leak = F.lit(0), F.lit(0)
    for f in features:
        own, everything, stored = F.col(f"{f}_train"), F.col(f"{f}_all"), F.col(f"{f}__mu")
        off = off + F.coalesce((F.abs(stored - own) > tolerance * (1 + F.abs(own))).cast("int"), F.lit(0))
        leak = leak + F.coalesce(((F.abs(own - everything) > 1e-9) & (F.abs(stored - everything) < 1e-9)).cast("int"),
                                 F.lit(0))
    one = joined.agg(F.sum(off).alias("off"), F.sum(leak).alias("leak"))
    return gate_rows(one, [("stats_not_train_moments", F.col("off"), 0.0, False),
                           ("stats_of_all_rows", F.col("leak"), 0.0, False)])


def unit_gates(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """Normalised train rows have mean near 0 and deviation near 1, averaged over symbols."""
    per_symbol = panel.where(F.col("split") == "train").groupBy("symbol").agg(*[c for f in features for c in (
        F.avg(f).alias(f"{f}_m"), F.stddev_samp(f).alias(f"{f}_s"))])
    one = per_symbol.agg(*[c for f in features for c in (
        F.avg(F.abs(f"{f}_m")).alias(f"{f}_m"), F.avg(f"{f}_s").alias(f"{f}_s"))])
    gates = []
    for f in features:
        gates += [(f"{f}_train_mean", F.col(f"{f}_m"), 0.05, False),
                  (f"{f}_train_sd_low", F.col(f"{f}_s"), 0.8, True),
                  (f"{f}_train_sd_high", F.col(f"{f}_s"), 1.2, False)]
    return gate_rows(one, gates)


def label_gate(panel: DataFrame, bars: DataFrame, horizon: int = 5, tolerance: float = 1e-4) -> DataFrame:
    """Forward labels against the close found ``horizon`` rows later by row number."""
    numbered = bars.select("symbol", "date", "c", F.row_number().over(series("symbol")).alias("_i"))
    later = numbered.select("symbol", (F.col("_i") - horizon).alias("_i"), F.col("c").alias("_later"))
    own = numbered.join(later, ["symbol", "_i"], "left")
    expected = own.select("symbol", "date", F.ln(F.col("_later") / F.col("c")).alias("_expected"))
    gap = F.abs(F.col(f"fwd_ret_{horizon}") - F.col("_expected"))
    one = (panel.select("symbol", "date", f"fwd_ret_{horizon}").join(expected, ["symbol", "date"], "left")
           .agg(F.count_if(gap > tolerance).alias("bad")))
    return gate_rows(one, [("labels_off", F.col("bad"), 0.0, False)])


def sentiment_join_gates(panel: DataFrame, sentiment: DataFrame, stats: DataFrame,
                         limit: float = 7.999) -> DataFrame:
    """Un-normalised SENT equals the stored sentiment wherever it was not clipped."""
    joined = (panel.select("symbol", "date", "SENT").join(sentiment.select("symbol", "date", "sent_decay"),
                                                          ["symbol", "date"])
              .join(stats.select("symbol", "SENT__mu", "SENT__sd"), "symbol")
              .where(F.col("SENT").isNotNull() & F.col("SENT__sd").isNotNull()))
    free = F.abs("SENT") < limit
    error = F.abs(F.col("SENT") * F.col("SENT__sd") + F.col("SENT__mu") - F.col("sent_decay"))
    one = joined.agg(F.max(F.when(free, error)).alias("error"), F.avg((~free).cast("int")).alias("clipped"),
                     F.try_divide(F.covar_samp("SENT", "sent_decay"),
                                  F.stddev_samp("SENT") * F.stddev_samp("sent_decay")).alias("pearson"))
    return gate_rows(one, [("sentiment_rebuild_error", F.col("error"), 1e-4, False),
                           ("sentiment_clipped_share", F.col("clipped"), 1.0, False),
                           ("sentiment_pearson", F.col("pearson"), -1.0, True)])


def split_gates(panel: DataFrame) -> DataFrame:
    """Splits follow each other without overlap, and no (symbol, date) repeats."""
    span = {s: (F.min(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_lo"),
                F.max(F.when(F.col("split") == s, F.col("date"))).alias(f"{s}_hi"))
            for s in ("train", "val", "test")}
    one = panel.agg(*[c for pair in span.values() for c in pair])
    ordered = ((F.col("train_hi") < F.col("val_lo")) & (F.col("val_hi") < F.col("test_lo")))
    repeats = panel.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    return (gate_rows(one, [("splits_ordered", F.coalesce(ordered, F.lit(False)).cast("int"), 1.0, True)])
            .unionByName(gate_rows(repeats, [("repeated_rows", F.col("repeats"), 0.0, False)])))


def yearly_coverage(sentiment: DataFrame) -> DataFrame:
    return sentiment.groupBy(F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), (F.avg(F.col("has_news").cast("int")) * 100).alias("news_pct"),
        F.avg("news_intensity").alias("mean_intensity"))


def monthly_sentiment(sentiment: DataFrame) -> DataFrame:
    return (sentiment.where("has_news").groupBy(F.trunc("date", "month").alias("month"))
            .agg(F.avg("sent_raw").alias("mean"), F.count(F.lit(1)).alias("n")))


def month_dip(sentiment: DataFrame, month: date) -> DataFrame:
    """Mean of one month and mean of the three monthly means before it."""
    monthly = monthly_sentiment(sentiment)
    away = F.months_between(F.lit(month), "month")
    return monthly.agg(F.max(F.when(away == 0, F.col("mean"))).alias("month_mean"),
                       F.avg(F.when(away.between(1, 3), F.col("mean"))).alias("base_mean"))


def independent_sessions(news: DataFrame, sessions: DataFrame) -> DataFrame:
    """News sessions found another way: by months, joined on (symbol, month).

    A symbol's sessions of a month are the bits of one integer, next to the first session of its later months.
    The session after a day is the lowest bit above it, or that later session. Work and rows are linear in news
    days plus sessions; a month without sessions is a row of its own with no bits.
    """
    month = F.trunc("date", "month").alias("month")
    stated = news.select("symbol", "date", month).distinct()
    held = sessions.select("symbol", month, F.dayofmonth("date").alias("_day"), "date")
    bits = held.groupBy("symbol", "month").agg(F.bit_or(F.expr("shiftleft(1L, _day - 1)")).alias("_bits"), F.min("date").alias("_first"))
    empty = stated.select("symbol", "month", F.lit(0).cast("long").alias("_bits"), F.lit(None).cast("date").alias("_first"))
    months = bits.unionByName(empty).groupBy("symbol", "month").agg(F.max("_bits").alias("_bits"), F.min("_first").alias("_first"))
    later = Window.partitionBy("symbol").orderBy("month").rowsBetween(1, Window.unboundedFollowing)
    months = months.select("symbol", "month", "_bits", F.min("_first").over(later).alias("_later"))
    above = F.expr("shiftright(_bits, dayofmonth(date))")
    lowest = F.bit_count(above.bitwiseAND(-above) - 1)
    found = stated.join(months, ["symbol", "month"]).select(
        "symbol", F.when(above != 0, F.date_add("date", lowest + 1)).otherwise(F.col("_later")).alias("date"))
    return found.where(F.col("date").isNotNull()).distinct()


def key_mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return (left.join(right, list(keys), "full_outer")
            .where(F.col("_a").isNull() | F.col("_b").isNull()).select(*keys))


def sentiment_gates(sentiment: DataFrame, news: DataFrame, sessions: DataFrame, dip_month: date) -> DataFrame:
    """Gate rows of the sentiment table."""
    per_day = news.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"))
    look_ahead = align(per_day, sessions).agg(
        F.coalesce(F.sum(F.when(F.col("eff") <= F.col("date"), F.col("n"))), F.lit(0)).alias("v"))
    years = yearly_coverage(sentiment).agg(F.min("news_pct").alias("v"))
    spec = series("symbol")
    marked = sentiment.withColumn("_before", F.lag(F.abs("sent_decay")).over(spec))
    on, off = F.col("has_news"), ~F.col("has_news") & F.col("_before").isNotNull()
    exact = marked.agg(
        F.count_if(on & (F.col("days_since_news") != 0)).alias("age"),
        F.count_if(on & (F.abs(F.col("sent_decay") - F.col("sent_raw")) > 1e-5)).alias("raw"),
        F.count_if(off & (F.abs("sent_decay") > F.col("_before") + 1e-6)).alias("rise"),
        F.count_if(~F.col("sent_decay").between(-1, 1)).alias("range"),
        F.stddev_samp("sent_decay").alias("sd"))
    dip = month_dip(sentiment, dip_month)
    other = key_mismatches(sentiment.where("has_news"), independent_sessions(news, sessions),
                           ["symbol", "date"]).select("symbol").distinct().agg(F.count(F.lit(1)).alias("v"))
    return (gate_rows(look_ahead, [("look_ahead", F.col("v"), 0.0, False)])
            .unionByName(gate_rows(years, [("least_news_year_pct", F.col("v"), 1e-9, True)]))
            .unionByName(gate_rows(exact, [
                ("news_day_age_not_zero", F.col("age"), 0.0, False),
                ("news_day_decay_not_raw", F.col("raw"), 0.0, False),
                ("quiet_day_decay_rises", F.col("rise"), 0.0, False),
                ("outside_unit_range", F.col("range"), 0.0, False),
                ("deviation", F.col("sd"), 1e-12, True)]))
            .unionByName(gate_rows(dip, [("month_minus_base", F.col("month_mean") - F.col("base_mean"), 0.0, False)]))
            .unionByName(gate_rows(other, [("symbols_off", F.col("v"), 0.0, False)])))
