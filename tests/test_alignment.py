"""Strictly-next-session alignment and decay on hand-made days."""

from datetime import date

import pytest

from panelspark.operators import alignment

D = lambda m, d: date(2020, m, d)


@pytest.fixture(scope="module")
def sessions(spark):
    days = [D(1, 6), D(1, 7), D(1, 8), D(1, 10), D(1, 13)]
    return spark.createDataFrame([("a", d) for d in days] + [("quiet", d) for d in days[:2]], "symbol string, date date")


@pytest.fixture(scope="module")
def news(spark):
    rows = [("a", D(1, 1), 0.5), ("a", D(1, 6), 1.0), ("a", D(1, 6), 0.0), ("a", D(1, 9), -1.0), ("a", D(1, 13), 0.7),
            ("a", D(2, 1), 0.9), ("nobody", D(1, 6), 1.0)]
    return spark.createDataFrame(rows, "symbol string, date date, sent_signed double")


def test_next_session(news, sessions):
    got = {(r["date"], r["eff"]) for r in alignment.align_articles(news, sessions).collect()}
    assert got == {(D(1, 1), D(1, 6)), (D(1, 6), D(1, 7)), (D(1, 9), D(1, 10))}


def test_session_sentiment(news, sessions):
    got = {r["date"]: r for r in alignment.session_sentiment(news, sessions).collect()}
    assert got[D(1, 7)]["mean"] == 0.5 and got[D(1, 7)]["n"] == 2
    assert got[D(1, 7)]["sd"] == pytest.approx(0.5 ** 0.5)
    assert got[D(1, 6)]["sd"] == 0.0


def test_decay(news, sessions):
    rows = alignment.sentiment_daily(news, sessions).collect()
    a = {r["date"]: r for r in rows if r["symbol"] == "a"}
    assert len(a) == 5
    assert a[D(1, 8)]["sent_decay"] == pytest.approx(0.5 * 0.5 ** 0.2)
    assert a[D(1, 8)]["days_since_news"] == 1 and not a[D(1, 8)]["has_news"]
    assert a[D(1, 10)]["sent_decay"] == -1.0 and a[D(1, 13)]["days_since_news"] == 1
    quiet = [r for r in rows if r["symbol"] == "quiet"]
    assert [r["sent_decay"] for r in quiet] == [0.0, 0.0]
    assert {r["days_since_news"] for r in quiet} == {-1}


def test_moments_merge_over_days(spark, sessions):
    rows = [("a", D(1, d), v) for d, v in [(8, 0.1), (8, 0.4), (9, -0.3), (9, 0.9), (9, 0.2)]]
    df = spark.createDataFrame(rows, "symbol string, date date, sent_signed double")
    got = {r["date"]: r for r in alignment.session_sentiment(df, sessions).collect()}[D(1, 10)]
    values = [v for *_, v in rows]
    import statistics
    assert got["mean"] == pytest.approx(statistics.mean(values))
    assert got["sd"] == pytest.approx(statistics.stdev(values))
