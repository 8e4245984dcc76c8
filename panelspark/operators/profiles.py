"""Profiles of price and news coverage per ticker, and their distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import ranking
from panelspark.functions import text as T

RECENT_ROWS = 252
NEWS_YEARS = tuple(range(2009, 2026))


def price_profile(prices: DataFrame, recent: int = RECENT_ROWS,
                  direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Rows, span, largest gap and exact median traded dollars per ticker.

    ``prices`` has ticker, date, close, volume with readable dates; repeated days count
    as rows. Daily files hold a few thousand rows per ticker, which one aggregation
    buffer takes. When a ticker is measured to hold more than ``direct_rows`` the medians
    come from the splitting rank operators instead.
    """
    dollars = F.col("close").cast("double") * F.col("volume").cast("double")
    traded = prices.select("ticker", "date", dollars.alias("_dv"))
    first, last = F.min("date"), F.max("date")
    span = [F.count(F.lit(1)).alias("n_rows"), first.alias("first_date"), last.alias("last_date"),
            F.round(F.date_diff(last, first) / F.lit(365.25), 2).alias("n_years")]
    newest = [F.col("date").desc(), F.col("_dv").desc()]
    widest = F.coalesce(F.max("_gap"), F.lit(0)).cast("int").alias("max_gap_days")
    spec = Window.partitionBy("ticker")
    gap = F.date_diff("date", F.lag("date").over(spec.orderBy("date"))).alias("_gap")
    columns = ["ticker", "n_rows", "first_date", "last_date", "n_years",
               "med_dollar_vol_recent252", "med_dollar_vol_full", "max_gap_days"]
    if ranking.group_sizes(traded, ["ticker"])[1] <= direct_rows:
        staged = traded.select("*", gap, F.row_number().over(spec.orderBy(*newest)).alias("_age"))
        return staged.groupBy("ticker").agg(
            *span, widest, F.median("_dv").alias("med_dollar_vol_full"),
            F.median(F.when(F.col("_age") <= recent, F.col("_dv"))).alias("med_dollar_vol_recent252"),
        ).select(*columns)
    gaps = traded.select("ticker", "date").distinct().select("ticker", gap)
    tail = ranking.positions(traded, ["ticker"], newest, "_age", "_n", direct_rows)
    full = ranking.quantiles(traded, ["ticker"], "_dv", [0.5], "_full")
    out = traded.groupBy("ticker").agg(*span)
    for part in (gaps.groupBy("ticker").agg(widest),
                 full.select("ticker", F.col("_full")[0].alias("med_dollar_vol_full")),
                 tail.where(F.col("_age") <= recent).groupBy("ticker").agg(
                     F.median("_dv").alias("med_dollar_vol_recent252"))):
        out = ranking.join_null_safe(out, part, ["ticker"], "left")
    return out.select(*columns)


def with_failures(profile: DataFrame, files: DataFrame) -> DataFrame:
    """One profile row per file, also for files without a usable row.

    ``files`` has ticker, lines (data lines, readable or not) and problem (text or NULL).
    """
    joined = files.join(profile, "ticker", "left")
    error = (F.when(F.col("problem").isNotNull(), F.col("problem"))
             .when(F.col("lines") == 0, "empty")
             .when(F.col("n_rows").isNull(), "no_valid_dates").otherwise(""))
    missing = {"n_rows": 0, "n_years": 0.0, "med_dollar_vol_recent252": 0.0,
               "med_dollar_vol_full": 0.0, "max_gap_days": -1}
    return (joined.withColumn("error", error).fillna(missing)
            .select("ticker", *[c for c in profile.columns if c != "ticker"], "error"))


def valid_news(news: DataFrame) -> DataFrame:
    """Rows with a symbol and a plausible stated date; adds ticker, d10 and year."""
    d10 = T.stated_date_text(F.col("ts"))
    return (news.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
            .select(T.symbol_of(F.col("symbol")).alias("ticker"), d10.alias("d10"), "src")
            .where(F.col("d10").isNotNull() & T.plausible_year(F.col("d10")))
            .withColumn("year", F.substring("d10", 1, 4).cast("int")))


def news_profile(news: DataFrame, sources: Sequence[str],
                 years: Sequence[int] = NEWS_YEARS) -> DataFrame:
    """Article counts, per source and year, and the news span of each ticker.

    Only the named columns of one conditional aggregation: partial counts are formed
    where the articles are read, so a dominant ticker shuffles as one row per task.
    """
    per_source = [F.count_if(F.col("src") == s).alias(f"{s}_count") for s in sources]
    per_year = [F.count_if(F.col("year") == y).alias(f"y{y}") for y in years]
    return valid_news(news).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("total"), *per_source,
        F.min("d10").alias("first_news"), F.max("d10").alias("last_news"), *per_year)


def with_news(prices: DataFrame, news: DataFrame) -> DataFrame:
    """Price profile with news counts; a ticker without news has zeros."""
    counts = [c for c, t in news.dtypes if t in ("bigint", "int")]
    return prices.join(news, "ticker", "left").fillna(0, counts)


def years_with_news(years: Sequence[int]) -> Column:
    present = [F.when(F.col(f"y{y}") > 0, 1).otherwise(0) for y in years]
    total = F.lit(0)
    for flag in present:
        total = total + flag
    return total


def yearly_news(profile: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per year: articles, symbols that had any, and the median among those.

    The wide profile is turned long; the exact median may need more than one task per
    year, since every ticker of the market contributes one value.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"y{y}").alias("articles"))
                                for y in years])).alias("p")
    tall = profile.select(pairs).select("p.*")
    totals = tall.groupBy("year").agg(F.sum("articles").alias("articles"),
                                      F.count_if(F.col("articles") > 0).alias("symbols"))
    medians = ranking.quantiles(tall.where(F.col("articles") > 0), ["year"], "articles", [0.5])
    return (totals.join(medians, "year", "left")
            .select("year", "articles", "symbols", F.col("q")[0].alias("median_pos")))


def last_news_years(profile: DataFrame) -> DataFrame:
    return (profile.groupBy(F.substring("last_news", 1, 4).cast("int").alias("year"))
            .agg(F.count(F.lit(1)).alias("symbols")))


def percentile_table(profile: DataFrame, metric: str, percents: Sequence[int],
                     drop_zero: bool = False) -> DataFrame:
    """Rows (metric, p, value): exact percentiles of one profile column."""
    present = profile.where(F.col(metric) != 0) if drop_zero else profile
    q = ranking.quantiles(present, [], metric, [p / 100.0 for p in percents])
    return q.select(F.posexplode("q").alias("_i", "value")).select(
        F.lit(metric).alias("metric"),
        F.element_at(F.lit([int(p) for p in percents]), F.col("_i") + 1).alias("p"), "value")


def cutoff_counts(profile: DataFrame, ends: Sequence[str], starts: Sequence[str]) -> DataFrame:
    """Tickers still trading at each end cut, and already trading at each start cut."""
    marks = [(f"last_date>={d}", F.col("last_date") >= F.lit(d).cast("date")) for d in ends]
    marks += [(f"first_date<={d}", F.col("first_date") <= F.lit(d).cast("date")) for d in starts]
    one = profile.agg(*[F.count_if(test).alias(f"c{i}") for i, (_, test) in enumerate(marks)])
    rows = F.array(*[F.struct(F.lit(name).alias("cut"), F.col(f"c{i}").alias("n"))
                     for i, (name, _) in enumerate(marks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def floor_position(pool: DataFrame, metric: str, floor: float, drop_zero: bool = False) -> DataFrame:
    """Percent of the pool below a floor: where the floor sits in the distribution."""
    present = pool.where(F.col(metric) != 0) if drop_zero else pool
    return present.agg(F.lit(metric).alias("metric"), F.lit(float(floor)).alias("floor"),
                       (F.avg(F.when(F.col(metric) < floor, 1.0).otherwise(0.0)) * 100).alias("pct_below"))
