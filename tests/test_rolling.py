"""Merged windows against pandas rolling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import rolling
from panelspark.functions.rolling import series

WIDTHS = (5, 10, 20, 30, 60, 63)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    parts = []
    for s in range(3):
        n = 200
        x, z = 1000 + rng.standard_normal(n).cumsum(), rng.standard_normal(n)
        if s == 1:
            x[50:120] = 7.0
        hole = rng.choice(n, 3, replace=False)
        x[hole] = z[hole] = np.nan
        parts.append(pd.DataFrame({"symbol": s, "date": np.arange(n), "x": x, "z": z}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, data):
    df = spark.createDataFrame(data)
    return df.select("symbol", "date", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("x", "z")]).cache()


def test_tiling_covers_every_width():
    for width, near, far in rolling.tiling((5, 20, 63, 126, 252)):
        assert (near == 0 and width <= rolling.DIRECT_WIDTH) or near + far == width
    assert {w for w, *_ in rolling.tiling((7, 11, 13, 97))} >= {7, 11, 13, 97}


def test_trailing(frame, data):
    out = rolling.add_windows(frame, series(), WIDTHS, moments=("x", "z"), highs="x", lows="x", pairs=[("x", "z")])
    cols = []
    for w in WIDTHS:
        cols += [F.col(rolling.mean_of("x", w)).alias(f"mean{w}"), rolling.deviation("x", w).alias(f"std{w}"),
                 F.col(rolling.high_of("x", w)).alias(f"max{w}"), F.col(rolling.low_of("x", w)).alias(f"min{w}"),
                 rolling.correlation("x", "z", w).alias(f"corr{w}")]
    got = out.select("symbol", "date", *cols).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for w in WIDTHS:
        for stat in ("mean", "std", "max", "min"):
            want = data.groupby("symbol")["x"].transform(lambda v: getattr(v.rolling(w), stat)())
            np.testing.assert_allclose(got[f"{stat}{w}"].astype(float), want, rtol=1e-9, atol=1e-6)
        for s, part in data.groupby("symbol"):
            want = part["x"].rolling(w).corr(part["z"]).to_numpy()
            flat = part["x"].rolling(w).apply(lambda v: v.max() - v.min()).to_numpy() == 0
            have = got.loc[got.symbol == s, f"corr{w}"].to_numpy(float)
            assert np.isnan(have[flat]).all()
            np.testing.assert_allclose(have[~flat], want[~flat], atol=1e-7)


def test_leading(frame, data):
    out = rolling.add_windows(frame, series(), (5, 20, 63), moments=["z"], ahead=True)
    got = out.select("symbol", "date", *[rolling.deviation("z", w).alias(f"s{w}") for w in (5, 20, 63)])
    got = got.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    for w in (5, 20, 63):
        want = data.groupby("symbol")["z"].transform(lambda v: v.shift(-1).rolling(w).std().shift(-(w - 1)))
        np.testing.assert_allclose(got[f"s{w}"].astype(float), want, atol=1e-12)


def test_narrow_windows_are_fetched_values_without_sliding_frames(spark):
    """A sliding frame updates every aggregate once a row and place; prices and volumes paid ten of them."""
    frame = spark.createDataFrame([("a", d, x, x and x * 3.0) for d, x in enumerate([0.1] * 7 + [4.0, None, 2.0, 9.0, 5.0, 1.0, 7.0])], "symbol string, date int, x double, z double")
    for ahead in (False, True):
        out = rolling.add_windows(frame, series(), (1, 5, 10), moments=("x", "z"), highs="x", lows="x", pairs=[("x", "z")], ahead=ahead)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "RowFrame, -4, currentrow" not in plan and "RowFrame, 1, 5" not in plan
        rows = {r["date"]: r for r in out.collect()}
        flat, last = rows[4 if not ahead else 0], rows[13 if not ahead else 8]
        assert (flat["_x_dev5"], flat["_x_z_joint5"]) == (0.0, 0.0)
        assert [last[k] for k in ("_x_max5", "_x_min5")] == [9.0, 1.0] and round(last["_x_mean5"], 12) == 4.8
        assert round(last["_x_dev5"], 12) == 44.8 and round(last["_x_z_joint5"], 12) == 134.4
        assert rows[12 if not ahead else 7]["_x_dev5"] is None


def test_rounding_without_decimal_text_is_the_engine_s_to_the_bit(spark):
    """Rounding 35 columns as text cost three times as much as their windows."""
    from panelspark.plans.catalogue import nearest, rounded
    rng = np.random.default_rng(3)
    spread = rng.standard_normal(20000) * 10.0 ** rng.integers(-12, 14, 20000)
    ties = (rng.integers(-10**7, 10**7, 20000) + 0.5) / 10.0 ** rng.integers(0, 9, 20000)
    odd = [0.0, -0.0, -1e-9, 4.9e-324, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 99999.9999995, 1.0000005, 2.5e-7, -5e-7, 1e5, 1e11, None]
    near = [float(np.nextafter(t, s)) for t in ties[:4000] for s in (-np.inf, np.inf)]
    df = spark.createDataFrame([(v,) for v in [*spread.tolist(), *ties.tolist(), *near, *odd]], "x double")
    for digits in (6, 8):
        both = df.select(F.hex(F.format_string("%a", nearest(F.col("x"), digits))).alias("a"), F.hex(F.format_string("%a", F.round("x", digits))).alias("b"))
        assert both.where("not a <=> b").count() == 0
    assert "CASE WHEN" in rounded(df)._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_sets_the_session_to_methods_that_are_compiled(spark):
    from panelspark.sources.tables import table
    table(spark, "/root/testdata/sf0.001", "lineitem", "l_suppkey")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
