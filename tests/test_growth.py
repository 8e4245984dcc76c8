"""What must not grow with the tables: the width of shuffled rows, the rows of a stage, a task's share."""

import re

import numpy as np
from pyspark.sql import functions as F

from panelspark import session
from panelspark.operators import inference as I
from panelspark.operators import series
from panelspark.plans import catalogue, fixtures as fx, research

FOLDER = "/root/testdata/sf0.001"


def shuffled_columns(df):
    """Columns of the rows of every exchange in the plan."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [int(n) for n in re.findall(r"\) Exchange\s+Input \[(\d+)\]", text)]


def test_wide_panel_rows_are_not_shuffled_by_any_session(spark):
    bars, sentiment = catalogue._panel_inputs(spark, FOLDER)
    changed = {"spark.sql.requireAllClusterKeysForCoPartition": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        for panel in (research.build_panel(bars, sentiment, fx.SPLITS), research.raw_panel(bars, sentiment, fx.SPLITS)):
            widths = shuffled_columns(panel)
            assert widths and max(widths) < 20 and len(panel.columns) > 75
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stored_scores_have_one_row_per_key(spark):
    stored, _, test = catalogue._cells(spark, FOLDER)
    keys = ["model", "arm", "date_id", "sym_id"]
    assert 0 < stored.count() == stored.select(keys).distinct().count()
    cells, _ = fx.score_cells(spark, FOLDER)
    whole = I.average_scores(cells.join(test.select("date_id"), "date_id", "left_semi"))
    both = stored.alias("a").join(whole.alias("b"), keys, "full_outer")
    assert both.where(F.col("a.score").isNull() | F.col("b.score").isNull() | (F.abs(F.col("a.score") - F.col("b.score")) > 1e-12)).count() == 0


def test_partitions_follow_the_table(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        session.roomy(spark, path)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before["spark.sql.shuffle.partitions"]
        monkeypatch.setattr(session, "INPUT_BYTES", 1000)
        session.roomy(spark, path)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_instance_norm_builds_no_struct_per_value(spark):
    windows = [[1.0, 2.0, 4.0], [1e9, 1e9 + 1, 1e9 + 2], [5.0, 5.0], [3.0], [], None]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(windows)], "i int, x array<double>")
    normed = rows.select("i", series.instance_norm(F.col("x")).alias("n"))
    assert "square" not in normed._jdf.queryExecution().analyzed().toString()
    for r in normed.collect():
        w, n = windows[r["i"]], r["n"]
        if w is None:
            assert n["mean"] is None and n["sd"] is None and n["z"] is None
        elif len(w) < 2:
            assert n["mean"] == (w[0] if w else 0.0) and (n["sd"] is None if w else n["sd"] == 1e-5)
        else:
            sd = np.std(w, ddof=1) + 1e-5
            assert np.allclose([n["mean"], n["sd"]], [np.mean(w), sd]) and np.allclose(n["z"], (np.array(w) - np.mean(w)) / sd)
