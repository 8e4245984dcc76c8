"""Portfolios, inference and ridge against numpy written here."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark import params
from panelspark.operators import inference as I
from panelspark.operators import portfolio as P
from panelspark.operators import ridge


@pytest.fixture(scope="module")
def synthetic():
    rng = np.random.default_rng(0)
    dates, names = 60, 80
    score = rng.standard_normal(dates * names)
    y = 0.02 * rng.standard_normal(dates * names) + 0.001 * score
    return pd.DataFrame({"t": np.repeat(np.arange(dates), names), "symbol": np.tile(np.arange(names), dates),
                         "score": score, "y": y, "noise": rng.standard_normal(dates * names)})


def hard(pdf, column="score", cost=0.001):
    out, previous = [], None
    for _, day in pdf.groupby("t"):
        day = day.sort_values([column, "symbol"], ascending=[False, True])
        k = max(1, math.ceil(0.10 * len(day)))
        w = pd.Series(1.0 / k, index=day["symbol"].to_numpy()[:k])
        gross = day["y"].to_numpy()[:k].mean()
        move = 0.0 if previous is None else 0.5 * w.sub(previous, fill_value=0).abs().sum()
        out.append((gross, move, gross - cost * move))
        previous = w
    return np.array(out)


@pytest.mark.parametrize("limit", [10_000_000, 30])
def test_hard_portfolio(spark, synthetic, limit):
    got = P.hard_portfolio(spark.createDataFrame(synthetic), direct_rows=limit).toPandas().sort_values("t")
    np.testing.assert_allclose(got[["gross", "turnover", "net"]].to_numpy(), hard(synthetic), atol=1e-12)
    assert got["turnover"].iloc[0] == 0.0 and (got["net"] <= got["gross"] + 1e-15).all()


@pytest.mark.parametrize("limit", [10_000_000, 30])
def test_soft_weights(spark, synthetic, limit):
    got = P.soft_weights(spark.createDataFrame(synthetic), 0.05, direct_rows=limit).toPandas()
    for t, day in got.groupby("t"):
        s = day["score"].to_numpy()
        w = 1 / (1 + np.exp(-(s - np.quantile(s, 0.9)) / (0.05 * (s.std() + 1e-8))))
        np.testing.assert_allclose(day["w"], w / (w.sum() + 1e-8), atol=1e-12)
        assert abs(day["w"].sum() - 1) < 1e-6


def test_soft_becomes_hard(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"t": 0, "symbol": np.arange(200), "score": rng.standard_normal(200)}))
    mass = []
    for tau in (1e-2, 1e-3, 1e-4, 1e-5):
        w = P.soft_weights(df, tau).toPandas().sort_values("score", ascending=False)["w"].to_numpy()
        mass.append(w[:20].sum())
    assert mass == sorted(mass) and mass[-1] > 0.999
    assert w[:20].std() / w[:20].mean() < 1e-3


def test_stable_holdings_cost_nothing(spark):
    rows = pd.DataFrame({"t": np.repeat(np.arange(5), 50), "symbol": np.tile(np.arange(50), 5)})
    rows["score"], rows["y"] = rows["symbol"].astype(float), 0.01
    net = P.hard_portfolio(spark.createDataFrame(rows)).toPandas()
    assert net["turnover"].abs().max() < 1e-12


def test_all_names_replaced(spark):
    rows = [(0, 1, 1.0, 0.1), (0, 2, 0.0, 0.0), (1, 3, 1.0, 0.2), (1, 4, 0.0, 0.0)]
    net = P.hard_portfolio(spark.createDataFrame(rows, "t long, symbol long, score double, y double"))
    assert [r["turnover"] for r in net.orderBy("t").collect()] == [0.0, 1.0]


def arms(pdf):
    wide = pdf.rename(columns={"t": "date_id", "symbol": "sym_id"})
    return wide.assign(model="m", s_risk=pdf["score"], s_mse=pdf["noise"], s_ridge=-pdf["noise"])


def deflated(d):
    n, sr = len(d), d.mean() / (d.std(ddof=1) + 1e-12)
    g3 = ((d - d.mean()) ** 3).mean() / (d.std() ** 3 + 1e-12)
    g4 = ((d - d.mean()) ** 4).mean() / (d.std() ** 4 + 1e-12)
    z = (sr - I.expected_max_sharpe(params.DSR_TRIALS) / math.sqrt(n - 1)) * math.sqrt(n - 1) / math.sqrt(
        max(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-9))
    return sr * math.sqrt(252 / 5), 0.5 * (1 + math.erf(z / math.sqrt(2)))


def overfitting(m):
    n = len(m)
    edges = [int(n * g / 10) for g in range(11)]
    lam = []
    for combo in combinations(range(10), 5):
        out = np.zeros(n, bool)
        for g in combo:
            out[edges[g]:edges[g + 1]] = True
        best = int(np.argmax(m[~out].mean(0)))
        rank = (m[out].mean(0).argsort(kind="stable").argsort(kind="stable")[best] + 1) / (m.shape[1] + 1)
        lam.append(math.log(rank / (1 - rank)))
    return np.mean(np.array(lam) <= 0)


def test_contrast(spark, synthetic):
    got = I.contrast(spark.createDataFrame(arms(synthetic))).first()
    risk, mse = hard(synthetic)[:, 2], hard(synthetic, "noise")[:, 2]
    flipped = synthetic.assign(flip=-synthetic["noise"])
    ridge_net = hard(flipped, "flip")
    sharpe = lambda r: r.mean() / (r.std(ddof=1) + 1e-12) * math.sqrt(252 / 5)
    assert got["sharpe_risk"] == pytest.approx(sharpe(risk)) and got["sharpe_mse"] == pytest.approx(sharpe(mse))
    sr, dsr = deflated(risk - mse)
    assert got["dSharpe_vs_mse"] == pytest.approx(sr) and got["DSR_vs_mse"] == pytest.approx(dsr, abs=1e-9)
    assert got["p_vs_ridge"] == pytest.approx(1 - deflated(risk - ridge_net[:, 2])[1], abs=1e-9)
    matrix = np.column_stack([hard(synthetic)[:, 0], hard(synthetic, "noise")[:, 0], ridge_net[:, 0]])
    assert got["PBO"] == pytest.approx(overfitting(matrix))
    assert got["sharpe_risk"] > got["sharpe_mse"]


def test_identical_arms_are_rejected(spark, synthetic):
    same = arms(synthetic).assign(s_mse=synthetic["score"], s_ridge=synthetic["score"])
    got = I.contrast(spark.createDataFrame(same)).first()
    assert not got["H1_ACCEPT"] and 0.0 <= got["PBO"] <= 1.0
    assert not I.verdict(I.contrast(spark.createDataFrame(same))).first()["any_accept"]


def test_overfitting_probability(spark):
    m = np.random.default_rng(5).standard_normal((47, 4))
    rows = [(int(t), int(c), float(m[t, c])) for t in range(47) for c in range(4)]
    got = I.overfitting_probability(spark.createDataFrame(rows, "t long, config int, value double")).first()
    assert got["n_splits"] == 252 and got["pbo"] == pytest.approx(overfitting(m))


@pytest.mark.parametrize("n", [13, 100, 389])
def test_decile_cut(spark, n):
    got = spark.range(1, n + 1).select(I.decile_of(F.col("id"), F.lit(n)).alias("b")).toPandas()["b"].to_numpy()
    want = pd.qcut(np.arange(1, n + 1), 10, labels=False)
    assert (got == want).mean() > 0.99


def test_false_discovery(spark):
    p = [0.001, 0.04, 0.03, 0.5, 0.009]
    got = I.false_discovery(spark.createDataFrame([(v,) for v in p], "p double")).orderBy("p").toPandas()
    np.testing.assert_allclose(got["p_adjusted"], [0.005, 0.0225, 0.05, 0.05, 0.5])


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(2)
    dates, names = 40, 25
    x = rng.standard_normal((dates * names, 3)) * [1, 5, 0.1] + [0, 3, -1]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = 3 + x @ [1.0, -0.2, 4.0] + 2 * rng.standard_normal(len(x))
    pdf["i"], pdf["symbol"] = np.repeat(np.arange(dates), names), np.tile(np.arange(names), dates)
    pdf["date"] = (pd.Timestamp("2020-01-01") + pd.to_timedelta(pdf["i"], "D")).dt.date
    return pdf


def closed_form(tr, te, alpha):
    f = ["a", "b", "c"]
    mu, sd = tr[f].mean().to_numpy(), tr[f].std(ddof=0).to_numpy() + 1e-8
    z = (tr[f].to_numpy() - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ tr["y"].to_numpy())
    return (te[f].to_numpy() - mu) / sd @ w


def test_ridge_all_folds(spark, panel):
    from panelspark.operators import folds as C
    rows = spark.createDataFrame(panel.drop(columns="i"))
    folds = C.purged_folds(rows).cache()
    roles = ridge.segments(folds)
    models = ridge.fit_folds(rows, roles, ["a", "b", "c"], 50.0)
    got = ridge.score_folds(rows, roles, models, ["a", "b", "c"]).toPandas()
    table = folds.toPandas()
    for fold in range(15):
        role = table[table.fold == fold].set_index("date")["role"]
        tag = panel["date"].map(role)
        te = panel[tag == "test"]
        mine = got[got.fold == fold].set_index(["date", "symbol"])["score"]
        want = closed_form(panel[tag == "train"], te, 50.0)
        np.testing.assert_allclose(mine.loc[list(zip(te["date"], te["symbol"]))].to_numpy(), want, atol=1e-9)


def test_ridge_alpha_path(spark, panel):
    from panelspark.operators import folds as C
    rows = spark.createDataFrame(panel.drop(columns="i"))
    inner = C.nested_inner(C.purged_folds(rows)).where("fold = 3").cache()
    path = ridge.alpha_path(rows, ridge.segments(inner, "val"), ["a", "b", "c"], [0.1, 10.0, 500.0]).toPandas()
    tag = panel["date"].map(inner.toPandas().set_index("date")["role"])
    for alpha, mse in zip(path["alpha"], path["mse"]):
        va = panel[tag == "val"]
        want = ((closed_form(panel[tag == "train"], va, alpha) - va["y"]) ** 2).mean()
        assert mse == pytest.approx(want, rel=1e-9)


def test_moments_merge_like_their_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((5000, 3)) * [1, 1, 1e-3] + [1e6, -1e9, 0]
    parts = [ridge.Moments.of(x[i:i + 37]) for i in range(0, len(x), 37)]
    merged = ridge._pairwise(parts)
    exact = np.cov((x - x[0]).T, bias=True) * len(x)
    np.testing.assert_allclose(merged.products, exact, rtol=1e-6, atol=1e-6)
    np.testing.assert_allclose(merged.products[0, 0], exact[0, 0], rtol=1e-11)
    np.testing.assert_allclose(merged.mean, x.mean(axis=0), rtol=1e-14)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(k=rng.integers(0, 3, len(x)))
    pdf.loc[::50, "a"] = np.nan
    rows = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).repartition(9)
    for r in ridge.co_moments(rows, "k", ["a", "b", "c"], fan_in=2).collect():
        own = pdf[(pdf.k == r["k"]) & pdf.a.notna()][["a", "b", "c"]].to_numpy()
        assert r["n"] == len(own)
        np.testing.assert_allclose(np.reshape(r["products"], (3, 3))[0, 0], ((own[:, 0] - own[:, 0].mean()) ** 2).sum(), rtol=1e-10)
        np.testing.assert_allclose(r["mean"], own.mean(axis=0), rtol=1e-13)


def test_ridge_with_a_far_off_feature_and_an_alpha_per_fold(spark, panel):
    from panelspark.operators import folds as C
    far = panel.assign(a=panel["a"] + 1e6)
    rows = spark.createDataFrame(far.drop(columns="i"))
    folds = C.purged_folds(rows).cache()
    alphas = spark.createDataFrame([(f, 10.0 ** (f % 3)) for f in range(14)], "fold int, alpha double")  # none for the last fold
    models = {r["fold"]: r for r in ridge.fit_folds(rows, ridge.segments(folds), ["a", "b", "c"], alphas).collect()}
    assert set(models) == set(range(14))
    table = folds.toPandas()
    for fold, m in models.items():
        tag = far["date"].map(table[table.fold == fold].set_index("date")["role"])
        tr, te = panel[tag == "train"], panel[tag == "test"]
        want = closed_form(tr, te, 10.0 ** (fold % 3))
        x = far[tag == "test"][["a", "b", "c"]].to_numpy()
        np.testing.assert_allclose(x @ m["weights"] + m["intercept"], want, atol=1e-7)
