"""The maintained sentiment table against the batch table, batch by batch."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import alignment
from panelspark.streaming import sentiment as live

SCHEMA = "symbol string, date date, sent_signed double"


@pytest.fixture(scope="module")
def tables(spark):
    spin = np.random.default_rng(11)
    first = date(2019, 11, 1)
    days = {f"s{i}": sorted({first + timedelta(int(d)) for d in spin.integers(0, 500, 150)}) for i in range(12)}
    sessions = spark.createDataFrame([(s, d) for s, x in days.items() for d in x], "symbol string, date date").cache()
    news = [(f"s{spin.integers(9)}", first + timedelta(int(spin.integers(-5, 560))), float(spin.normal()) if spin.random() > 0.05 else None) for _ in range(600)]
    return sessions, [*news, ("s1", None, 0.5), ("none", first, 1.0)]


def values(df):
    return {(r["symbol"], r["date"]): [None if v is None else round(v, 9) if isinstance(v, float) else v for v in (
        r["sent_decay"], r["sent_raw"], r["news_intensity"], r["sent_dispersion"], r["days_since_news"], r["has_news"])] for r in df.collect()}


def test_batches_in_any_order_with_one_run_twice(spark, tables, tmp_path):
    sessions, news = tables
    root = str(tmp_path / "live")
    live.start_table(sessions, root, 4)
    assert values(live.read(spark, root)) == values(alignment.sentiment_daily(spark.createDataFrame([], SCHEMA), sessions))
    done = []
    for number, part in enumerate([news[400:], news[:150], [n for n in news[150:400] if n[0] == "s3"], [n for n in news[150:400] if n[0] != "s3"], []]):
        batch = spark.createDataFrame(part, SCHEMA)
        for _ in range(2 if number == 1 else 1):
            live.apply_batch(batch, number, sessions, root, 4)
        done += part
        assert values(live.read(spark, root)) == values(alignment.sentiment_daily(spark.createDataFrame(done, SCHEMA), sessions))


def test_only_touched_partitions_are_replaced(spark, tables, tmp_path):
    sessions, news = tables
    root = str(tmp_path / "live")
    live.start_table(sessions, root, 4)
    live.apply_batch(spark.createDataFrame(news, SCHEMA), 0, sessions, root, 4)

    def stamps():
        return {p.relative_to(tmp_path).parent: p.name for p in (tmp_path / "live" / "daily").glob("*/*/*.parquet")}

    before = stamps()
    late = spark.createDataFrame([("s3", date(2021, 1, 5), 0.9)], SCHEMA)
    live.apply_batch(late, 1, sessions, root, 4)
    changed = {p for p, name in stamps().items() if before[p] != name}
    shard = live._placed(late, 4).first()["shard"]
    assert changed and all(f"shard={shard}" in str(p) and "year=2021" in str(p) for p in changed)


def test_stream_with_a_restart(spark, tables, tmp_path):
    sessions, news = tables
    feed, root = str(tmp_path / "feed"), str(tmp_path / "live")
    for half in (news[300:], news[:300]):
        spark.createDataFrame(half, SCHEMA).repartition(2).write.mode("append").parquet(feed)
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(feed)
        live.maintain(arriving, sessions, root, 4).awaitTermination()
    assert values(live.read(spark, root)) == values(alignment.sentiment_daily(spark.createDataFrame(news, SCHEMA), sessions))
    assert spark.read.parquet(f"{root}/moments").select("batch").distinct().count() == 4


def test_no_row_per_session_is_shuffled_before_the_tables_are_written(spark, tables):
    """A batch moved every session through three exchanges and two sorts; now a symbol's sessions travel as one row."""
    sessions, news = tables
    scored = spark.createDataFrame([*news, ("s2", date(2020, 1, 3), None), ("s2", date(2020, 1, 4), 0.25), ("s2", date(2020, 1, 4), 0.75)], SCHEMA)
    days = alignment.news_days(scored)
    calendar = alignment.calendar_of(sessions)
    got = alignment.daily_from_calendar(days.unionByName(days), calendar, 3.0)
    assert got.dtypes == alignment.daily_from_days(days, sessions, 3.0).dtypes
    assert values(got) == values(alignment.daily_from_days(days.unionByName(days), sessions, 3.0))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_batches_of_the_query_hold_several_files(spark, tables, tmp_path):
    sessions, news = tables
    feed, root = str(tmp_path / "feed"), str(tmp_path / "live")
    for half in (news[300:], news[:300]):
        spark.createDataFrame(half, SCHEMA).repartition(3, "symbol", "date").write.mode("append").parquet(feed)
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(feed)
    live.maintain(arriving, alignment.calendar_of(sessions), root, 4).awaitTermination()
    assert values(live.read(spark, root)) == values(alignment.sentiment_daily(spark.createDataFrame(news, SCHEMA), sessions))
    assert spark.read.parquet(f"{root}/moments").select("batch").distinct().count() == 2
