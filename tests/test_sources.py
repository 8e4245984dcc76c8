"""Raw file readers and sinks."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import bars as B
from panelspark.operators import folds as C
from panelspark.operators import profiles
from panelspark.sources import files, sinks
from panelspark.sources.tables import load_panel, load_scores

HEADER = "date,volume,open,high,low,close,adj close\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("prices")
    (root / "AAA.csv").write_text(HEADER + "2020-01-03,10,1,2,1,2,2\n2020-01-02,20,1,2,1,1.5,1.5\nbad,1,1,1,1,1,1\n")
    (root / "BBB.csv").write_text(HEADER)
    (root / "CCC.csv").write_text(HEADER + "nonsense,1,1,1,1,1,1\n")
    (root / "DDD.csv").write_text("")
    (root / "EEE.csv").write_text("day,price\n2020-01-02,5\n")
    return str(root)


def test_price_profile_with_failures(spark, folder):
    expected = spark.createDataFrame([("AAA",), ("DDD",)], "ticker string")
    listed = files.list_price_files(spark, folder, expected)
    prices = files.read_prices(spark, folder, listed).where(F.col("date").isNotNull())
    rows = {r["ticker"]: r for r in profiles.with_failures(profiles.price_profile(prices), listed).collect()}
    assert set(rows) == {"AAA", "BBB", "CCC", "DDD", "EEE"}
    assert rows["AAA"]["n_rows"] == 2 and rows["AAA"]["error"] == "" and rows["AAA"]["max_gap_days"] == 1
    assert rows["AAA"]["med_dollar_vol_full"] == 25.0
    assert rows["BBB"]["error"] == "empty" and rows["CCC"]["error"] == "no_valid_dates"
    assert rows["DDD"]["error"] == "no columns to parse" and rows["EEE"]["error"] == "needed columns are missing"
    assert all(rows[t]["n_rows"] == 0 and rows[t]["max_gap_days"] == -1 for t in "BBB CCC DDD EEE".split())


def test_profile_split_path(spark):
    rows = [("hot", f"2020-01-{1 + i % 28:02d}", float(i), 1.0) for i in range(300)] + [("x", "2020-02-01", 3.0, 2.0)]
    df = B.parse_dates(spark.createDataFrame(rows, "ticker string, date string, close double, volume double"))
    one = {r["ticker"]: tuple(r) for r in profiles.price_profile(df, 20).collect()}
    two = {r["ticker"]: tuple(r) for r in profiles.price_profile(df, 20, direct_rows=50).collect()}
    assert one == two and one["hot"][1] == 300


def test_news(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text('Date,Stock_symbol,Article_title,Article,Url\n'
                    '2020-01-02 00:00:00 UTC,aa,"Up, up","line one\nline two",http://x\n'
                    '2020-01-03 00:00:00 UTC,bb,Short\n'
                    '2020-01-04 00:00:00 UTC,cc,Too,many,fields,here,now\n')
    rows = {r["symbol"]: r for r in files.read_news(spark, str(path), "allext").collect()}
    assert set(rows) == {"aa", "bb"} and rows["aa"]["title"] == "Up, up" and "line two" in rows["aa"]["body"]
    assert rows["bb"]["url"] is None and rows["bb"]["src"] == "allext"


def test_tickers(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" aa \nBB\n\nbb\n")
    assert {r["ticker"] for r in files.read_tickers(spark, str(tmp_path / "list.txt")).collect()} == {"AA", "BB"}


def test_scores_are_stored_by_cell(spark, tmp_path):
    root = str(tmp_path / "scores")
    grid = C.work_grid(spark, ("m",), ("risk",), 2, 3)
    assert sinks.backlog(grid, root)[0].count() == 6
    rows = grid.withColumn("date_id", F.lit(1)).withColumn("sym_id", F.lit(2)).withColumn("y", F.lit(0.5)) \
        .withColumn("score", F.col("cell") * 1.0).drop("cell")
    sinks.write_scores(rows.where("seed = 0"), root)
    assert sinks.backlog(grid, root)[0].count() == 3
    sinks.write_scores(rows.where("seed = 0 and fold = 1").withColumn("score", F.lit(9.0)), root)
    stored = load_scores(spark, root, "m", "risk")
    assert stored.count() == 3 and stored.where("fold = 1").first()["score"] == 9.0
    chosen = spark.createDataFrame([("other", "risk")], "model string, arm string")
    todo, deferred = sinks.backlog(grid, root, chosen)
    assert todo.count() == 0 and deferred.count() == 3


def test_panel_is_pruned(spark, tmp_path):
    path = str(tmp_path / "panel")
    df = spark.createDataFrame([("a", "2020-01-01", "train", 1.0, 2.0, 0.1, 0.2, 9.0), ("b", "2021-01-01", "test", 3.0, 4.0, 0.3, 0.4, 9.0)],
                               "symbol string, date string, split string, F1 double, F2 double, fwd_ret_5 double, fwd_vol_5 double, fwd_ret_20 double")
    sinks.write_parquet(df, path, ["split"])
    rows, features = load_panel(spark, path, "test", 5, ["b"])
    assert features == ["F1", "F2"] and rows.count() == 1 and "fwd_ret_20" not in rows.columns
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "fwd_ret_20" not in plan and "PartitionFilters: [isnotnull(split" in plan


def test_lines_of_a_price_file_are_not_cut_to_tell_a_header(spark, tmp_path):
    """Every data line was cut into cells and each cell cleaned, in three passes; and sorted to meet its file's header."""
    folder = tmp_path / "odd"
    folder.mkdir()
    (folder / "a.b.csv").write_bytes(b"\xef\xbb\xbf DATE ,Close,\xc2\xa0Volume\r\n2020-01-02, 5.5 ,7\r\nupdate,1,2\r\n\r\n")
    (folder / "c.csv").write_text("volume,dated,close\n3,2020-01-02,4\n")
    (folder / "d.csv").write_text("Date,VOLUME\n2020-01-03,3\n")
    listed = files.list_price_files(spark, str(folder))
    assert {r["ticker"]: (r["lines"], r["problem"]) for r in listed.collect()} == {
        "a.b": (2, None), "c": (2, "needed columns are missing"), "d": (2, "needed columns are missing")}
    rows = files.read_prices(spark, str(folder))
    assert sorted((r["ticker"], str(r["date"]), r["volume"], r["close"]) for r in rows.collect()) == [
        ("a.b", "2020-01-02", 7.0, 5.5), ("a.b", "None", 2.0, 1.0), ("d", "2020-01-03", 3.0, None)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "regexp_extract" not in plan
    filters = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lower(" in filters.replace("contains(", "Contains(") and "CASE WHEN" in filters


def test_ticker_files_of_many_batches(spark, tmp_path):
    rows = [(t, r, f"é{t},{r}" if r else "head") for t in ("x", "yy", "z") for r in range(25)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        lines = spark.createDataFrame(rows[::-1], "ticker string, rank int, line string").withColumn("date", F.lit(None).cast("date"))
        sinks.write_ticker_files(lines, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")) == ["x.csv", "yy.csv", "z.csv"]
    for t in ("x", "yy", "z"):
        assert (tmp_path / "t" / f"{t}.csv").read_text(encoding="utf-8") == "".join(line + "\n" for u, _, line in rows if u == t)
