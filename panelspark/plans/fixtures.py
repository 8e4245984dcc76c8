"""The given tables in the shapes the operators take: bars, news, articles, scores.

The thresholds are the ones the sparse test bars call for; see FIXTURES.md.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators import bars as B
from panelspark.operators import features as X
from panelspark.operators import folds as C
from panelspark.operators import rebalance as R
from panelspark.params import Floors, PanelSpec, Splits
from panelspark.session import durable
from panelspark.sources.tables import table

SPLITS = Splits(start=date(1995, 1, 1), train=(date(1996, 1, 1), date(1998, 12, 31)),
                val=(date(1999, 1, 1), date(1999, 12, 31)), test=(date(2000, 1, 1), date(2001, 12, 31)))
FLOORS = Floors(first_date_max=date(1995, 1, 20), last_date_min=date(2001, 7, 20), n_rows_min=515,
                max_gap_days=30, dollar_vol_min=30_000.0, news_total_min=120,
                train_years=(1996, 1997, 1998), test_years=(2000, 2001), train_years_min=3,
                test_years_min=2, window_years=tuple(range(1995, 2002)))
SPEC = PanelSpec(splits=SPLITS, floors=FLOORS, lookback=60, min_history=300, horizon=5)
NEWS_YEARS = tuple(range(1995, 2002))
SOURCES = ("allext", "nasdaq")
SPLIT_DAY = date(1998, 6, 1)
MODEL_FEATURES = ("KMID", "KLEN", "RET_5", "MOM_20", "STD_20", "RSV_5", "MA_20", "VMA_20")
MODELS, ARMS, SEEDS = ("m0", "m1"), ("risk", "mse", "ridge"), 2


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                 "l_quantity", "l_extendedprice", "l_shipdate")
    return rows.select(
        F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
        "l_orderkey", "l_linenumber", "l_partkey")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with an adjusted close: odd symbols split two for one."""
    raw = B.daily_bars(ticks(spark, folder), ("l_orderkey", "l_linenumber", "l_partkey", "px", "qty"))
    halved = (F.col("symbol") % 2 == 1) & (F.col("date") < F.lit(SPLIT_DAY))
    return raw.withColumn("adj_close", F.when(halved, F.col("close") * 0.5).otherwise(F.col("close")))


def adjusted(spark: SparkSession, folder: str) -> DataFrame:
    inside = B.in_window(bars(spark, folder), SPLITS)
    return B.with_history(B.adjust(inside), SPEC.min_history)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Trading days per symbol, from the two key columns only."""
    return (table(spark, folder, "lineitem", "l_suppkey", "l_shipdate")
            .select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("date"))
            .where(F.col("date").between(F.lit(SPLITS.start), F.lit(SPLITS.end))).distinct())


def _suppliers(spark: SparkSession, folder: str) -> Column:
    return table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()


def news(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as scored news: symbol, ts, date, src, sent_signed."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    day = F.to_date("o_orderdate")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.select(
        (F.col("o_custkey") % _suppliers(spark, folder)).alias("symbol"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 10 == 0, " 13:45:00 UTC")
                 .otherwise(" 00:00:00 UTC")).alias("ts"),
        day.alias("date"), F.when(F.year(day) < 2000, SOURCES[0]).otherwise(SOURCES[1]).alias("src"),
        ((level - 3) / F.lit(2.0)).alias("sent_signed"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as raw articles; copies share text and therefore symbol and date."""
    docs = table(spark, folder, "documents", "doc_id", "text", "source", "n_chars")
    urls = table(spark, folder, "pages", "page_id", "url")
    day = F.date_add(F.lit(date(1995, 1, 1)), (F.col("n_chars") % 2000).cast("int"))
    number = F.substring("source", 4, 4).cast("int")
    rows = docs.select(
        "doc_id", (F.col("n_chars") % _suppliers(spark, folder)).cast("string").alias("symbol"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00 UTC")).alias("ts"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"),
        F.when(number < 10, SOURCES[0]).otherwise(SOURCES[1]).alias("src"))
    return rows.join(urls, F.col("doc_id") == F.col("page_id"), "left").drop("page_id")


def model_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Panel with the handful of features the score fixtures use, and 5-day labels."""
    base = adjusted(spark, folder)
    wide = X.price_features(base, lags=(5,), windows=(5, 20), correlations=(), momenta=(20,))
    labelled = X.forward_labels(wide, (SPEC.horizon,))
    return B.tag_split(labelled, SPLITS).select("symbol", "date", "split", *MODEL_FEATURES,
                                                "fwd_ret_5", "fwd_vol_5")


def rebalance_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows on rebalance dates with t and y, the rebalance dates).

    Eligible rows are stored once: both results, and the size checks of the operators
    that follow, read the stored table.
    """
    rows = durable(R.eligible(model_panel(spark, folder), MODEL_FEATURES, "fwd_ret_5", lookback=SPEC.lookback))
    dates = R.rebalance_dates(rows, SPEC.horizon)
    return R.on_dates(rows, dates).withColumn("y", F.col("fwd_ret_5")), dates


def score_cells(spark: SparkSession, folder: str, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """(score rows per model, arm, seed and fold; rebalance dates with split).

    Scores are simple signals with small additions that differ by model, seed and fold. ``split`` adds the
    split of the date to the score rows; a filter on it reaches the rows before they are multiplied.
    """
    rows, dates = rebalance_rows(spark, folder)
    tested = C.purged_folds(dates).where(F.col("role") == "test").select("fold", "date")
    base = {"risk": F.col("MOM_20"), "mse": -F.col("RET_5"),
            "ridge": F.col("MA_20") * 0.5 - F.col("STD_20") * 0.5}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(a).alias("arm"), F.lit(s).alias("seed"))
                                for i in range(len(MODELS)) for a in ARMS for s in range(SEEDS)])).alias("_c")
    spread = (rows.join(F.broadcast(tested), "date")
              .select("t", "date", "split", "symbol", "y", "fold", *MODEL_FEATURES, cells)
              .select("*", "_c.*"))
    signal = F.when(F.col("arm") == "risk", base["risk"]).when(F.col("arm") == "mse", base["mse"]) \
        .otherwise(base["ridge"])
    score = (signal + F.col("m") * 0.02 * F.col("KMID") + F.col("seed") * 0.01 * F.col("RSV_5")
             + F.col("fold") * 0.001 * F.col("KLEN"))
    out = spread.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "arm", "seed", "fold",
                        F.col("t").alias("date_id"), F.col("symbol").alias("sym_id"), "y", score.alias("score"), *(["split"] if split else []))
    in_split = B.tag_split(dates, SPLITS).select(F.col("t").alias("date_id"), "date", "split")
    return out, in_split
