"""Purged folds against a direct loop, and their properties."""

import math
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest

from panelspark.operators import folds as C
from panelspark.operators import sampling


def calendar(spark, n):
    return spark.createDataFrame([(date(2013, 1, 2) + timedelta(days=7 * i),) for i in range(n)], "date date")


@pytest.mark.parametrize("n,groups,k,purge", [(300, 6, 2, 1), (149, 6, 2, 1), (47, 10, 5, 0), (61, 5, 2, 3)])
def test_roles(spark, n, groups, k, purge):
    got = C.purged_folds(calendar(spark, n), groups, k, purge).toPandas()
    edges = [int(n * g / groups) for g in range(groups + 1)]
    for fold, combo in enumerate(combinations(range(groups), k)):
        roles = np.array(["train"] * n, dtype=object)
        test = [i for g in combo for i in range(edges[g], edges[g + 1])]
        for i in test:
            roles[max(0, i - purge):i + purge + 1] = "purged"
        roles[test] = "test"
        mine = got[got.fold == fold].sort_values("i")["role"].to_numpy()
        assert (mine == roles).all()


def test_gates_and_coverage(spark):
    folds = C.purged_folds(calendar(spark, 300)).cache()
    gates = C.fold_gates(folds).collect()
    assert len(gates) == math.comb(6, 2)
    assert all(g["passed"] and g["overlap"] == 0 and g["min_gap"] == 2 for g in gates)
    assert {r["paths"] for r in C.coverage(folds).collect()} == {math.comb(5, 1)}


def test_nested_inner(spark):
    inner = C.nested_inner(C.purged_folds(calendar(spark, 300))).where("fold = 0").toPandas().sort_values("j")
    n = len(inner)
    cut = int(n * 4 / 5)
    assert (inner["role"].to_numpy()[cut:] == "val").all() and inner["role"].to_numpy()[cut - 1] == "purged"
    assert (inner["role"].to_numpy()[:cut - 1] == "train").all()


def test_folds_per_set_use_their_own_dates(spark):
    a = calendar(spark, 60).selectExpr("'a' AS s", "date")
    b = calendar(spark, 30).selectExpr("'b' AS s", "date")
    got = C.purged_folds(a.unionByName(b), by=["s"]).groupBy("s", "fold").count().toPandas()
    assert set(got[got.s == "a"]["count"]) == {60} and set(got[got.s == "b"]["count"]) == {30}


def test_grid_and_backlog(spark):
    grid = C.work_grid(spark, ("x", "y"), ("mse", "risk"), 2, 3, extra=(("ridge", "ridge"),))
    rows = {r["cell"]: tuple(r)[1:] for r in grid.collect()}
    assert len(rows) == 5 * 6 and rows[0] == ("x", "mse", 0, 0) and rows[9] == ("x", "risk", 1, 0)
    assert rows[29] == ("ridge", "ridge", 1, 2)
    done = grid.where("model <> 'ridge'")
    assert C.pending_cells(grid, done).count() == 6


def test_samples(spark):
    dates = calendar(spark, 100)
    got = [r["i"] for r in sampling.evenly_spaced(dates, 7, 10, 20).orderBy("i").collect()]
    assert got == np.linspace(10, 80, 7).astype(int).tolist()
    blocks = sampling.date_blocks(dates, 16, seed=4)
    assert blocks.count() == 96
    assert {r["n"] for r in blocks.groupBy("block", "turn").count().withColumnRenamed("count", "n").collect()} == {16}
