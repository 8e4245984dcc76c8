"""Results do not depend on the size of a table: NULL groups, NULL values, -0.0 and all-NULL groups on both paths."""

import pytest
from pyspark.sql import functions as F

from panelspark.functions import ranking, text
from panelspark.operators import alignment, portfolio, profiles
from panelspark.sources import files

DIRECT, SPLIT = 10_000_000, 25


@pytest.fixture(scope="module")
def frame(spark):
    rows = []
    for i in range(300):
        g = None if i % 3 == 0 else f"g{i % 5}"
        x = None if i % 7 == 0 or g == "g4" else -0.0 if i % 11 == 0 else 0.0 if i % 11 == 1 else float(i % 13)
        rows.append((g, i, x, None if i % 17 == 0 else float((i * 37) % 29)))
    return spark.createDataFrame(rows, "g string, id long, x double, y double").cache()


def both(make):
    out = [sorted(map(repr, (tuple(r) for r in make(limit).collect()))) for limit in (DIRECT, SPLIT)]
    assert out[0] and out[0] == out[1]


def test_positions(frame):
    both(lambda n: ranking.positions(frame, ["g"], [F.col("y").desc(), F.col("id")], direct_rows=n).select("g", "id", "position", "group_rows"))


def test_average_rank(frame):
    both(lambda n: ranking.average_rank(frame, ["g"], "x", direct_rows=n).select("g", "id", "rank", "ranked_rows"))


def test_quantiles(frame):
    exact, rough = (sorted(map(tuple, ranking.quantiles(frame, ["g"], "x", [0.1, 0.5, 0.9], accuracy=a).collect()), key=str) for a in (10_000, 15))
    assert exact == rough


def test_rank_correlation(frame):
    both(lambda n: ranking.rank_correlation(frame, ["g"], "x", "y", direct_rows=n).select("g", F.round("ic", 9).alias("ic"), "n", "distinct_x"))


def test_soft_weights(frame):
    scores = frame.select(F.col("g").alias("t"), "id", F.col("x").alias("score"))
    both(lambda n: portfolio.soft_weights(scores, 0.1, direct_rows=n).select("t", "id", F.round("w", 9).alias("w")))


def test_price_profile(spark, frame):
    prices = frame.select(F.col("g").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                          F.col("y").alias("close"), F.lit(2.0).alias("volume"))
    both(lambda n: profiles.price_profile(prices, 20, direct_rows=n))


def test_split_ranks_read_their_input_once(frame):
    plan = ranking.average_rank(frame, ["g"], "x", direct_rows=SPLIT)._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan  # the stored rows stand in for the input


def test_prices_by_name(spark, tmp_path):
    (tmp_path / "AA.csv").write_text("date,volume,open,high,low,close,adj close\n2020-01-02,10,1,2,0.5,1.5,1.4\n")
    (tmp_path / "BB.csv").write_text("Date,open,high,low,close,adj close,volume,extra\n2020-01-02,1,2,0.5,1.5,1.4,10,zz\n")
    (tmp_path / "CC.csv").write_text("volume,date\n10,2020-01-02\n")
    got = {r["ticker"]: tuple(r)[2:] for r in files.read_prices(spark, str(tmp_path)).collect()}
    assert got == {"AA": (10.0, 1.0, 2.0, 0.5, 1.5, 1.4), "BB": (10.0, 1.0, 2.0, 0.5, 1.5, 1.4), "CC": (10.0, None, None, None, None, None)}


def test_news_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Article_title,Stock_symbol,Url,Article\n2020-01-02,t1,AA,u1,b1\n")
    (tmp_path / "b.csv").write_text("Url,Stock_symbol,Date,Article_title\nu2,BB,2020-01-03,t2\n")
    got = sorted((r["symbol"], r["title"], r["url"], r["body"]) for r in files.read_news(spark, str(tmp_path), "x").collect())
    assert got == [("AA", "t1", "u1", "b1"), ("BB", "t2", "u2", None)]


def test_unicode_space(spark):
    row = spark.createDataFrame([("\tAAPL\n", "profit today", "  A  b ")], "s string, w string, t string").select(
        text.symbol_of(F.col("s")), F.size(text.word_set(F.col("w"))), text.normal_title(F.col("t"))).first()
    assert tuple(row) == ("AAPL", 2, "a b")


@pytest.mark.parametrize("setting", ["true", "false"])
def test_hot_symbol_is_dealt_by_article(spark, setting):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", setting)
    try:
        news = spark.range(900).select(F.when(F.col("id") % 10 == 0, "B").otherwise("A").alias("symbol"),
                                       F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("date"), "id")
        sessions = spark.range(20).select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("symbol"),
                                          F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
        out = alignment.align_articles(news, sessions)
        assert out.count() == 900 and out.where("eff = date_add(date, 1)").count() == 900
        assert "hashpartitioning(symbol, date, _salt" in " ".join(
            out._jdf.queryExecution().executedPlan().toString().split()).replace("#", " ").translate({ord(d): None for d in "0123456789"}).replace(" ,", ",").replace("L,", ",")
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
