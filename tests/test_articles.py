"""Cleaning, strict dedup with hot copies, scoring, and the streaming ingest."""

import pytest
from pyspark.sql import functions as F

from panelspark.functions import text as T
from panelspark.operators import articles
from panelspark.streaming import news as stream


def raw(spark, rows):
    return spark.createDataFrame(rows, "symbol string, ts string, title string, body string, url string, src string")


def test_clean(spark):
    rows = raw(spark, [
        (" aa ", "2020-01-02 00:00:00 UTC", "  Big   NEWS ", "short", "HTTP://X.com/a/?q=1#t", "allext"),
        ("bb", "2020-01-02", None, " ".join(f"w{i}" for i in range(100)), None, "allext"),
        ("cc", "not a date", "t", "b", None, "allext"), ("dd", "2020-01-02", " ", "  ", None, "allext")])
    got = {r["symbol"]: r for r in articles.clean(rows).collect()}
    assert set(got) == {"AA", "BB"}
    assert got["AA"]["ntitle"] == "big news" and got["AA"]["nurl"] == "http://x.com/a" and not got["AA"]["has_body"]
    assert got["BB"]["title"].split() == [f"w{i}" for i in range(60)] and got["BB"]["has_body"]


def test_dedup_of_a_hot_story(spark):
    copies = [("a", "2020-01-02 00:00:00 UTC", "Story", "x" * 30, "u", "nasdaq")] * 500
    rows = copies + [("a", "2020-01-02 00:00:00 UTC", "story ", "", "u?x", "allext"),
                     ("a", "2020-01-02 00:00:00 UTC", "story", "", "v", "allext")]
    got = articles.strict_dedup(articles.clean(raw(spark, rows)), ("allext", "nasdaq")).collect()
    assert len(got) == 2 and {r["src"] for r in got} == {"allext"}


def test_lexicon_and_scorer_agree(spark):
    texts = ["Profits rose, strong record.", "Shares fell on fraud", "nothing here", "gain loss"]
    df = spark.createDataFrame([(t,) for t in texts], "title string")
    got = articles.score_text(df, "title").withColumn("lex", articles.lexicon_sign(F.col("title"))).collect()
    assert [r["lex"] for r in got] == [1, -1, 0, 0]
    for r in got:
        assert (r["sent_signed"] > 0) - (r["sent_signed"] < 0) == r["lex"]
        assert r["p_pos"] + r["p_neg"] + r["p_neu"] == pytest.approx(1, abs=1e-6)


def test_date_only(spark):
    df = spark.createDataFrame([("2020-01-02 00:00:00 UTC",), ("2020-01-02 13:00:00 UTC",), ("2020-01-02",), ("x",)], "ts string")
    assert [r[0] for r in df.select(T.date_only(F.col("ts"))).collect()] == [True, False, True, False]


def test_streaming_dedup_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(300).select(
        (F.col("id") % 7).cast("string").alias("symbol"),
        (F.lit(1577836800) + (F.col("id") % 50) * 3600).cast("timestamp").alias("event_time"),
        F.lit("2020-01-01").alias("date"), (F.col("id") % 11).cast("string").alias("ntitle"), F.lit("").alias("nurl"))
    rows.repartition(3).write.parquet(source)
    read = stream.news_stream(spark, source, rows.schema, files_per_trigger=1)
    out = str(tmp_path / "out")
    stream.write_stream(stream.dedup_stream(read), out, str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(out).select("symbol", "date", "ntitle")
    assert got.count() == got.distinct().count() == rows.select("symbol", "date", "ntitle").distinct().count()


def test_native_lexicon_scores_like_the_scorer(spark):
    good, bad = articles.params.POSITIVE_WORDS[:3], articles.params.NEGATIVE_WORDS[:2]
    texts = ["", None, " ".join(good), f"{good[0]}. {good[0]},{bad[0]}", "nothing here", " ".join([*good, *bad]) * 40, "a\u00a0" + bad[1].upper()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    native = {r["i"]: r for r in articles.score_lexicon(df, "t").collect()}
    for r in articles.score_text(df, "t").collect():
        for c in ("p_pos", "p_neg", "p_neu", "sent_signed"):
            assert abs(native[r["i"]][c] - r[c]) < 1e-6
    assert "Python" not in articles.score_lexicon(df, "t")._jdf.queryExecution().executedPlan().toString()


def test_sample_per_label_is_cut_in_every_task(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 20, "few").when(F.col("id") % 50 > 0, "many").alias("label"))
    sample = articles.stratified_sample(rows, "label", "k", 70)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {"few": 20, "many": 70, None: 70}
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, sample.collect())) == set(map(tuple, articles.stratified_sample(rows.repartition(7), "label", "k", 70).collect()))


def test_agreement_of_decided_signs(spark):
    df = spark.createDataFrame([(0.5, 1), (-0.1, 1), (0.0, 0), (0.3, 0), (-2.0, -1)], "a double, b int")
    assert tuple(articles.sign_agreement(df, "a", "b").first()) == (0.6, 5)
    assert tuple(articles.sign_agreement(df, "a", "b", decided=True).first())[1] == 3


def test_feeds_are_put_together(spark):
    a = spark.createDataFrame([("x", 1)], "title string, n int")
    got = articles.union_sources([("one", a), ("two", a.drop("n"))])
    assert sorted(map(tuple, got.collect()), key=str) == [("x", 1, "one"), ("x", None, "two")]
