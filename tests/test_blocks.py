"""Series as numpy columns against the same operators on Spark columns."""

import datetime as dt
import math
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelspark.functions import blocks
from panelspark.operators import features as X
from panelspark.operators import normalise as N
from panelspark.plans import catalogue, fixtures as fx, research

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import a test
SHAPE = ("symbol string, date date, o double, h double, l double, c double, v double, sent_decay double, sent_raw double, "
         "news_intensity int, sent_dispersion double, days_since_news long, has_news boolean, _matched int, split string")
SOME = {"lags": (1, 5), "windows": (5, 10), "correlations": (10,), "momenta": (5,)}


def wide(rows):
    return X.price_features(X.sentiment_features(X.forward_labels(rows, (5, 10))), **SOME)


def scaled(rows):
    panel = wide(rows)
    return X.to_storage_types(N.fit_apply(panel, research.scaled_features(panel.columns)))


@pytest.fixture(scope="module")
def joined(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k, (symbol, days) in enumerate([("a", 90), ("b", 1), (None, 40), ("flat", 60), ("quiet", 50), ("late", 45), ("odd", 60), ("gaps", 70)]):
        for d in range(days):
            o, c = rng.uniform(5, 9, 2).tolist()
            h, l, v = max(o, c) + 1, min(o, c) - 1, float(rng.integers(0, 5))
            if symbol == "flat":
                o, h, l, c, v = 7.1, 7.1, 7.1, 7.1, 0.0
            if symbol == "gaps":
                o, h, l, c, v = (x if rng.uniform() < 0.97 else None for x in (o, h, l, c, v))
            if symbol == "odd" and d > 40:
                o, c, h = (0.0, 1e-13, math.inf) if d % 9 == 0 else (o, math.nan, h) if d % 7 == 0 else (o, c, h)
            news = None if symbol == "quiet" or d % 11 == 10 else int(rng.integers(0, 3))
            sent = [None] * 7 if news is None else [float(rng.uniform(-1, 1)), 0.5 if news else None, news, 0.1 if news else None, d % 4 - 1, news > 0, 1]
            split = "test" if symbol == "late" or d > 35 else "train" if d > 3 else "warmup"
            rows.append((symbol, dt.date(2000, 1, 1) + dt.timedelta(days=2 * d), o, h, l, c, v, *sent, split))
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], SHAPE).repartition(5)


@pytest.mark.parametrize("work", [wide, scaled])
def test_a_block_gives_the_values_of_the_column_operators(joined, work):
    want, have = work(joined), blocks.by_symbol(joined, work)
    assert have.dtypes == want.dtypes
    one, two = ({(r["symbol"], r["date"]): r for r in df.collect()} for df in (want, have))
    assert one.keys() == two.keys() and len(one) == 416
    for key, a in one.items():
        for c in want.columns:
            x, y = a[c], two[key][c]
            same = x == y if not isinstance(x, float) or y is None else (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)
            assert same or work is scaled and x is not None and y is not None and abs(x - y) < 1e-5, (key, c, x, y)


def test_where_blocks_are_cut_does_not_matter(joined, spark):
    whole = {tuple(map(str, r)) for r in blocks.by_symbol(joined, scaled).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(map(str, r)) for r in blocks.by_symbol(joined, scaled, 10).collect()} == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert blocks.by_symbol(joined.limit(0), scaled).count() == 0


def test_the_panel_is_not_a_chain_of_window_stages(spark):
    """Some fifty window stages over rows of a hundred columns took 290 microseconds a row."""
    panel = catalogue.normalised_panel(spark, "/root/testdata/sf0.001")
    assert panel._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 15
    assert len(panel.columns) == 79


def test_rounding_a_panel_s_columns_is_one_compiled_method(spark):
    """Its code outgrew the 64 KB of a Java method and was compiled in vain."""
    rows = spark.createDataFrame([tuple(float(i) / 7 for i in range(75))], ", ".join(f"c{i} float" for i in range(75)))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    text = catalogue.rounded(rows, 3)._jdf.queryExecution().explainString(mode)
    assert "maxMethodCodeSize:" in text and "maxMethodCodeSize:-1" not in text
    assert catalogue.rounded(rows, 3).first()["c9"] == 1.286


def test_sizes_of_dates_are_counted_without_the_features(spark):
    bars = fx.adjusted(spark, "/root/testdata/sf0.001").cache()
    ranks = research.market_features(bars, fx.SPLITS).select("symbol", "date", "XS_RET_20").collect()
    direct = X.cross_sectional_ranks(X.price_features(bars, lags=(20,), windows=(20,), correlations=(), momenta=(20,)).select("symbol", "date", "RET_20"), ("RET_20",))
    assert len(ranks) > 1000 and sorted(map(str, ranks)) == sorted(map(str, direct.select("symbol", "date", F.col("XS_RET_20")).collect()))
