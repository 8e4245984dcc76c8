"""Bootstrap, effective size, normal probability and month-bit sessions against Python written here."""

import bisect
import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import normal
from panelspark.operators import bootstrap, quality


def series(spark, sets):
    rows = [(k, i, float(v) if v is not None else None) for k, x in sets.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "k string, t int, x double").repartition(3)


def by_hand(x, mean_block, replicates, spacing, seed="bootstrap"):
    """Every replicate written out value by value."""
    n, out = len(x), []
    for r in range(replicates):
        values, draw = [], 0
        while len(values) < n:
            digest = hashlib.md5(f"{seed}:{r}:{draw}".encode()).hexdigest()
            start, u = int(digest[:13], 16) % n, (int(digest[13:26], 16) + 1) / 2 ** 52
            length = 1 if mean_block <= 1 else 1 + math.floor(math.log(u) / math.log(1 - 1 / mean_block))
            values += [x[(start + i) % n] for i in range(min(length, n - len(values)))]
            draw += 1
        m = np.mean(values)
        out.append((m, m / (np.std(values, ddof=1) + 1e-12) * math.sqrt(252 / spacing) if n > 1 else None))
    return out


@pytest.mark.parametrize("mean_block", [1, 3.0, 200.0])
def test_replicates_against_written_out_values(spark, mean_block):
    rng = np.random.default_rng(4)
    # a mean of 1e6 with a deviation of 1: sums of raw squares would lose it
    sets = {"a": rng.normal(size=57), "b": 1e6 + rng.normal(size=23), "one": [2.5]}
    rows = series(spark, {**sets, "none": [None, None]}).unionByName(series(spark, {"a": [None]}).withColumn("t", F.lit(99)))
    got = bootstrap.replicate_statistics(rows, "x", ["k"], "t", mean_block, 20).collect()
    assert len(got) == 60
    for k, x in sets.items():
        mine = sorted((r["replicate"], r["mean"], r["sharpe"]) for r in got if r["k"] == k)
        want = by_hand(list(x), mean_block, 20, 5)
        np.testing.assert_allclose([m[1] for m in mine], [w[0] for w in want], rtol=1e-12)
        if k == "one":
            assert all(m[2] is None for m in mine)
        else:
            np.testing.assert_allclose([m[2] for m in mine], [w[1] for w in want], rtol=1e-7)


def test_intervals_and_rows_of_a_replicate(spark):
    x = np.random.default_rng(5).normal(0.1, 1, 80)
    each = bootstrap.replicate_statistics(series(spark, {"a": x}), "x", ["k"], "t", 4.0, 200)
    row = bootstrap.intervals(each, ["k"]).first()
    want = np.array(by_hand(list(x), 4.0, 200, 5))
    np.testing.assert_allclose([row["mean_low"], row["mean_high"]], np.quantile(want[:, 0], [0.025, 0.975]), rtol=1e-9)
    np.testing.assert_allclose(row["sharpe_se"], want[:, 1].std(ddof=1), rtol=1e-9)
    assert row["replicates"] == 200 and row["n"] == 80 and row["mean_low"] < x.mean() < row["mean_high"]
    sizes = spark.createDataFrame([("a", 80)], "k string, n long")
    blocks = bootstrap.block_chains(sizes, ["k"], 4.0, 200, "bootstrap")
    assert {tuple(r) for r in blocks.groupBy("replicate").agg(F.sum("used").alias("u")).select("u").collect()} == {(80,)}
    assert blocks.count() < 200 * 80 / 2
    # the draws of a replicate stay where the replicate was dealt: one exchange, and it is below the draws
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_effective_size(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=300)
    smooth = np.convolve(base, np.ones(5), "valid")
    rows = series(spark, {"flat": [1.0] * 20, "noise": base, "smooth": smooth}).withColumn("lags", F.when(F.col("k") == "smooth", 4).otherwise(0))
    got = {r["k"]: r for r in bootstrap.effective_size(rows, "x", "lags", ["k"], "t").collect()}
    e = smooth - smooth.mean()
    rho = [(e[k:] * e[:-k]).sum() / (e * e).sum() for k in range(1, 5)]
    want = len(smooth) / max(1, 1 + 2 * sum((1 - k / 5) * r for k, r in zip(range(1, 5), rho)))
    assert abs(got["smooth"]["n_eff"] - want) < 1e-9 and want < len(smooth) / 2
    assert got["noise"]["n_eff"] == 300
    sized = bootstrap.detectable_effect(spark.createDataFrame([(5, 750, 0.01, 0.1, 150.0)], "h int, n long, mean double, sd double, n_eff double"), "h").first()
    assert sized["n_floor"] == 150 and abs(sized["mde_floor"] - sized["mde_eff"]) < 1e-12
    assert abs(sized["mde_eff"] - (1.959964 + 0.841621) * math.sqrt((1 + 0.01 / 2) / 150) * math.sqrt(252 / 5)) < 1e-5


def test_normal_probability(spark):
    xs = [i / 97 for i in range(-3000, 3001, 7)] + [0.0, -0.0, 0.46875, 4.0, -4.0, 26.9, 60.0, -60.0, math.inf, -math.inf]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,), (math.nan,)], "x double")
    got = rows.select("x", normal.erfc(F.col("x")).alias("e"), normal.normal_cdf(F.col("x")).alias("p")).collect()
    for r in got[:-2]:
        want = math.erfc(r["x"])
        assert abs(r["e"] - want) <= 1e-15 * max(want, 1e-285)
        assert abs(r["p"] - 0.5 * math.erfc(-r["x"] / math.sqrt(2))) < 1e-15
    assert got[-2]["p"] is None and math.isnan(got[-1]["p"])
    assert "Python" not in rows.select(normal.normal_cdf(F.col("x")))._jdf.queryExecution().executedPlan().toString()


def test_sessions_by_month_bits(spark):
    rng = np.random.default_rng(7)
    first = date(1999, 11, 1)
    held = {s: sorted({first + timedelta(int(d)) for d in rng.integers(0, 400, 60)}) for s in range(4)}
    held[1] = [date(2000, 1, 31), date(2000, 2, 29), date(2000, 5, 1)]
    news = [(s, first + timedelta(int(d))) for s in range(5) for d in rng.integers(0, 420, 80)]
    news += [(1, date(2000, 1, 30)), (1, date(2000, 1, 31)), (1, date(2000, 3, 31)), (1, None)]
    want = set()
    for s, d in news:
        days = held.get(s, [])
        at = bisect.bisect_right(days, d) if d else len(days)
        if at < len(days):
            want.add((s, days[at]))
    got = quality.independent_sessions(spark.createDataFrame(news, "symbol int, date date"),
                                       spark.createDataFrame([(s, d) for s, x in held.items() for d in x], "symbol int, date date"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
