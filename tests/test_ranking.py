"""Rank operators: the single-task plan and the splitting plan against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import ranking

DIRECT, SPLIT = 10_000_000, 40


@pytest.fixture(scope="module")
def rows():
    """A third of all rows in one group, a third of the values equal, some NULL."""
    rng = np.random.default_rng(3)
    n = 900
    group = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 9, n))
    x = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.standard_normal(n), 2))
    y = x * 0.3 + rng.standard_normal(n)
    pdf = pd.DataFrame({"g": group, "id": np.arange(n), "x": x, "y": y})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows).withColumn("x", F.nanvl("x", F.lit(None))).cache()


@pytest.mark.parametrize("limit", [DIRECT, SPLIT])
def test_average_rank(frame, rows, limit):
    got = ranking.average_rank(frame, ["g"], "x", direct_rows=limit).toPandas().sort_values("id")
    want = rows.groupby("g")["x"].rank()
    assert len(got) == len(rows)
    np.testing.assert_allclose(got["rank"].to_numpy(float), want.to_numpy())


@pytest.mark.parametrize("limit", [DIRECT, SPLIT])
def test_positions(frame, rows, limit):
    got = ranking.positions(frame, ["g"], [F.col("y").desc(), F.col("id")], direct_rows=limit).toPandas()
    want = rows.sort_values(["y", "id"], ascending=[False, True])
    want = want.assign(position=want.groupby("g").cumcount() + 1).sort_values("id")
    got = got.sort_values("id")
    assert (got["position"].to_numpy() == want["position"].to_numpy()).all()
    assert (got["group_rows"].to_numpy() == got.groupby("g")["id"].transform("count").to_numpy()).all()


@pytest.mark.parametrize("limit", [DIRECT, SPLIT])
def test_global_positions(frame, rows, limit):
    got = ranking.positions(frame, [], [F.col("y"), F.col("id")], direct_rows=limit).toPandas()
    assert (got.sort_values("y")["position"].to_numpy() == np.arange(1, len(rows) + 1)).all()


@pytest.mark.parametrize("accuracy", [10_000, 1000, 40, 6])
def test_quantiles(frame, rows, accuracy):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = ranking.quantiles(frame, ["g"], "x", probs, accuracy=accuracy).toPandas().set_index("g")
    for g, part in rows.dropna().groupby("g"):
        np.testing.assert_allclose(got.loc[g, "q"], np.quantile(part["x"], probs), atol=1e-12)
    np.testing.assert_allclose(ranking.quantiles(frame, [], "x", probs, accuracy=accuracy).first()["q"], np.quantile(rows["x"].dropna(), probs), atol=1e-12)


def test_quantiles_order_a_sliver_of_a_large_group(spark):
    """A third of all rows is one value, keys may be missing, and what is put in order is a few values a group."""
    frame = spark.range(60_000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(
        (F.xxhash64("id") % 1_000_000) / 1000.0).alias("v"))
    pdf = frame.toPandas()
    got = {r["g"]: r["q"] for r in ranking.quantiles(frame, ["g"], "v", [0.05, 0.5, 0.95]).collect()}
    for g in (None, 1, 2, 3, 4):
        own = pdf["v"][pdf["g"].isna() if g is None else pdf["g"] == g]
        np.testing.assert_allclose(got[g], np.quantile(own, [0.05, 0.5, 0.95]), atol=1e-9)
    assert ranking.quantiles(frame.where("v is null"), ["g"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("limit", [DIRECT, SPLIT])
def test_rank_correlation(frame, rows, limit):
    both = rows.dropna()
    pooled = ranking.rank_correlation(frame, [], "x", "y", direct_rows=limit).first()
    assert pooled["n"] == len(both)
    assert pooled["ic"] == pytest.approx(both["x"].rank().corr(both["y"].rank()), abs=1e-12)
    got = ranking.rank_correlation(frame, ["g"], "x", "y", direct_rows=limit).toPandas().set_index("g")
    for g, part in both.groupby("g"):
        assert got.loc[g, "ic"] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


def test_split_plan_keeps_no_group_whole(frame):
    """The offsets of the splitting plan are ranges, and ranges are small."""
    cut = ranking._cut_into_ranges(frame, ["g", "y", "id"], 20)
    largest = cut.groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 200
