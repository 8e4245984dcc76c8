"""Universe screen, its sensitivity, tiers and audit."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark import params
from panelspark.functions.rolling import series
from panelspark.operators.profiles import years_with_news
from panelspark.params import Floors, Splits

# Reasons in the order in which the screen tests them.
REASONS = (
    "history_starts_too_late",
    "price_ends_before_test_end(2020_freeze_or_delist)",
    "too_few_price_rows",
    "price_gap_too_large",
    "illiquid",
    "too_few_news_articles",
    "sparse_news_in_train",
    "sparse_news_in_test",
    "etf_or_fund_or_leveraged",
)
PASS = "PASS"


def leveraged(ticker: Column) -> Column:
    return ticker.rlike(params.LEVERAGED_PATTERN)


def mark_funds(candidates: DataFrame, blocklist: DataFrame | None) -> DataFrame:
    """Add ``is_fund`` from a one-column ticker list or the leveraged-name pattern."""
    if blocklist is None:
        return candidates.withColumn("is_fund", leveraged(F.col("ticker")))
    listed = blocklist.select("ticker").distinct().withColumn("_listed", F.lit(True))
    return (candidates.join(listed, "ticker", "left")
            .withColumn("is_fund", F.coalesce("_listed", F.lit(False)) | leveraged(F.col("ticker")))
            .drop("_listed"))


def _failures(f: Floors) -> list[Column]:
    """One test per reason, true when the ticker fails it; NULL dates fail."""
    gap, traded = F.col("max_gap_days"), F.col("med_dollar_vol_recent252")
    return [
        F.col("first_date").isNull() | (F.col("first_date") > F.lit(f.first_date_max)),
        F.col("last_date").isNull() | (F.col("last_date") < F.lit(f.last_date_min)),
        F.col("n_rows") < f.n_rows_min,
        (gap > f.max_gap_days) | (gap < 0),
        traded < f.dollar_vol_min,
        F.col("total") < f.news_total_min,
        years_with_news(f.train_years) < f.train_years_min,
        years_with_news(f.test_years) < f.test_years_min,
        F.col("is_fund"),
    ]


def exclusion_reason(floors: Floors) -> Column:
    reason = F.lit(PASS)
    for name, failed in reversed(list(zip(REASONS, _failures(floors)))):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def is_member(floors: Floors) -> Column:
    """The screen as one predicate; equals ``exclusion_reason == 'PASS'``."""
    ok = F.lit(True)
    for failed in _failures(floors):
        ok = ok & ~F.coalesce(failed, F.lit(False))
    return ok


def screen(candidates: DataFrame, floors: Floors) -> DataFrame:
    in_window = F.lit(0)
    for y in floors.window_years:
        in_window = in_window + F.col(f"y{y}")
    return (candidates.withColumn("exclusion_reason", exclusion_reason(floors))
            .withColumn("news_window", in_window.cast("long")))


def reason_counts(screened: DataFrame) -> DataFrame:
    return screened.groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def tiers(screened: DataFrame, dense: int = 150) -> DataFrame:
    """Tier 1 is every passing ticker; tier 2 the ``dense`` with most in-window news.

    Both as rows with their sort keys. Tier 2 is a top-k, so Spark keeps k rows per
    task instead of sorting the market.
    """
    passed = screened.where(F.col("exclusion_reason") == PASS)
    keep = ["ticker", "med_dollar_vol_recent252", "news_window"]
    first = passed.select(F.lit(1).alias("tier"), *keep)
    second = (passed.orderBy(F.desc("news_window"), F.desc("med_dollar_vol_recent252"), "ticker")
              .limit(dense).select(F.lit(2).alias("tier"), *keep))
    return first.unionByName(second)


def threshold_grid(base: Floors, axes: Mapping[str, Iterable], joint: Mapping[str, Iterable] | None = None
                   ) -> list[tuple[str, Floors]]:
    """One-at-a-time variations of ``axes`` followed by the product of ``joint``."""
    grid = [(f"{name}={value}", replace(base, **{name: value}))
            for name, values in axes.items() for value in values]
    if joint:
        for combo in itertools.product(*joint.values()):
            chosen = dict(zip(joint, combo))
            grid.append((",".join(f"{k}={v}" for k, v in chosen.items()), replace(base, **chosen)))
    return grid


def sensitivity(candidates: DataFrame, base: Floors, grid: list[tuple[str, Floors]]) -> DataFrame:
    """Members per grid point and Jaccard overlap with the base universe.

    Every grid point is two conditional counts in one aggregation, so tickers are
    read once and never multiplied by the grid.
    """
    marked = candidates.select(is_member(base).alias("base"),
                               *[is_member(floors).alias(f"m{i}") for i, (_, floors) in enumerate(grid)])
    counts = [F.count_if("base").alias("base")]
    for i in range(len(grid)):
        counts += [F.count_if(f"m{i}").alias(f"n{i}"), F.count_if(F.col(f"m{i}") & F.col("base")).alias(f"both{i}")]
    one = marked.agg(*counts)
    either = [F.col(f"n{i}") + F.col("base") - F.col(f"both{i}") for i in range(len(grid))]
    rows = F.array(*[F.struct(
        F.lit(name).alias("point"), F.col(f"n{i}").alias("n"),
        F.coalesce(F.round(F.try_divide(F.col(f"both{i}"), either[i]), 3), F.lit(1.0)).alias("jaccard"))
        for i, (name, _) in enumerate(grid)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def joint_screen(candidates: DataFrame, starts: Iterable[date], end: date, dollar_floors: Iterable[float],
                 news_floors: Iterable[int]) -> DataFrame:
    """Counts over start x liquidity x news, the coarse sweep made before the screen."""
    points = list(itertools.product(starts, dollar_floors, news_floors))
    one = candidates.agg(*[F.count_if(
        (F.col("first_date") <= F.lit(s)) & (F.col("last_date") >= F.lit(end))
        & (F.col("med_dollar_vol_recent252") >= d) & (F.col("total") >= n)).alias(f"n{i}")
        for i, (s, d, n) in enumerate(points)])
    rows = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(float(d)).alias("dollar_floor"),
                              F.lit(n).alias("news_floor"), F.col(f"n{i}").alias("n"))
                     for i, (s, d, n) in enumerate(points)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def reference_calendar(prices: DataFrame, members: DataFrame, count: int = 40) -> DataFrame:
    """Days on which any of the most liquid members traded.

    The names are a top-k of fixed size, which is what allows broadcasting them.
    """
    names = (members.orderBy(F.desc("med_dollar_vol_recent252"), "ticker").limit(count)
             .select("ticker"))
    return prices.join(F.broadcast(names), "ticker", "left_semi").select("date").distinct()


def audit(prices: DataFrame, members: DataFrame, calendar: DataFrame, max_gap: int = 10,
          min_coverage: float = 0.97, max_bad: int = 3) -> DataFrame:
    """Coverage, gaps, duplicate days and bad prints per member, recomputed from prices.

    ``prices`` may repeat a day; repeats are counted per (ticker, date) first, so the
    per-ticker window afterwards is bounded by the calendar. The calendar itself is one
    row per day and is broadcast for that reason.
    """
    bad = F.col("close").isNull() | (F.col("close") <= 0)
    bad_volume = F.col("volume").isNull() | (F.col("volume") < 0)
    days = (prices.groupBy("ticker", "date").agg(
                F.count(F.lit(1)).alias("copies"), F.count_if(bad).alias("bad_px"),
                F.count_if(bad_volume).alias("bad_vol"))
            .join(members.select("ticker"), "ticker", "left_semi"))
    marked = days.join(F.broadcast(calendar.withColumn("_open", F.lit(1))), "date", "left")
    gap = F.date_diff("date", F.lag("date").over(series("ticker")))
    expected = calendar.agg(F.count(F.lit(1))).scalar()
    rows = marked.withColumn("_gap", gap).groupBy("ticker").agg(
        F.count("_open").alias("_have"), F.max("_gap").alias("_gap"),
        F.sum(F.col("copies") - 1).alias("dup_dates"), F.sum("bad_px").alias("bad_px"),
        F.sum("bad_vol").alias("bad_vol"))
    full = F.col("_have") / expected
    widest = F.coalesce(F.col("_gap"), F.lit(9999))
    ok = ((full >= min_coverage) & (widest <= max_gap) & (F.col("dup_dates") == 0)
          & (F.col("bad_px") <= max_bad))
    return rows.select(
        "ticker", F.round(full, 4).alias("coverage"), widest.cast("int").alias("max_gap_days"),
        "dup_dates", "bad_px", "bad_vol", F.col("bad_px").between(1, max_bad).alias("repairable"),
        ok.alias("ok"))


def survivorship(screened: DataFrame, floors: Floors, months: int = 6) -> DataFrame:
    """Last-trade months of names dropped only for ending early; the largest months."""
    cohort = screened.where(
        (F.col("exclusion_reason") == REASONS[1])
        & (F.col("med_dollar_vol_recent252") >= floors.dollar_vol_min)
        & (F.col("total") >= floors.news_total_min))
    return (cohort.groupBy(F.date_format("last_date", "yyyy-MM").alias("month"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "month").limit(months))


def split_days(calendar: DataFrame, splits: Splits) -> DataFrame:
    counts = [F.count_if(F.col("date").between(F.lit(lo), F.lit(hi))).alias(name)
              for name in ("train", "val", "test") for lo, hi in [getattr(splits, name)]]
    return calendar.agg(*counts)


def universe_gates(members: DataFrame, audited: DataFrame, calendar: DataFrame, floors: Floors,
                   splits: Splits, min_size: int = 500, min_train_days: int = 1200,
                   min_test_days: int = 500) -> DataFrame:
    """Gate rows (gate, value, threshold, passed) for the whole universe."""
    size = members.agg(
        F.count(F.lit(1)).alias("size"),
        F.avg((years_with_news(floors.train_years) >= floors.train_years_min).cast("int")).alias("train_news"),
        F.avg((years_with_news(floors.test_years) >= floors.test_years_min).cast("int")).alias("test_news"))
    quality = audited.agg(F.avg(F.col("ok").cast("int")).alias("complete"),
                          F.count_if(F.col("bad_px") > 3).alias("unrepairable"))
    days = split_days(calendar, splits)
    return (gate_rows(size, [("size", F.col("size"), float(min_size), True),
                             ("news_in_train_years", F.col("train_news"), 0.90, True),
                             ("news_in_test_years", F.col("test_news"), 0.80, True)])
            .unionByName(gate_rows(quality, [("price_complete", F.col("complete"), 0.99, True),
                                             ("unrepairable_names", F.col("unrepairable"), 0.0, False)]))
            .unionByName(gate_rows(days, [("train_days", F.col("train"), float(min_train_days), True),
                                          ("test_days", F.col("test"), float(min_test_days), True)])))


def gate_rows(one_row: DataFrame, gates: list[tuple[str, Column, float, bool]]) -> DataFrame:
    """Turn one row of measurements into (gate, value, threshold, passed) rows.

    ``True`` means the value must reach the threshold, ``False`` that it may not exceed it.
    """
    rows = F.array(*[F.struct(
        F.lit(name).alias("gate"), value.cast("double").alias("value"),
        F.lit(float(bound)).alias("threshold"),
        F.coalesce(value >= bound if at_least else value <= bound, F.lit(False)).alias("passed"))
        for name, value, bound, at_least in gates])
    return one_row.select(F.explode(rows).alias("g")).select("g.*")
