"""Stage tables: what is read of them, and that they give back what was stored."""

import re

import pytest
from pyspark.sql import functions as F

from panelspark.plans import catalogue
from panelspark.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def scans(df):
    plan = df._jdf.queryExecution().toString()
    return re.findall(r"PartitionFilters: (\[.*?), PushedFilters.*?ReadSchema: (struct<.*?>)", plan[plan.index("== Physical Plan =="):])


def test_stage_gives_back_its_rows(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 3).cast("int").alias("k"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("0"), F.col("id") % 2)).alias("name"),
                                   F.col("id").cast("string").alias("v"))
    for _ in range(2):  # a second write replaces the first whole
        back = sinks.store_stage(rows, str(tmp_path / "stage"), ("k", "name"))
        assert back.dtypes == rows.dtypes and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    found = scans(back.where("k = 1").select("v"))
    assert found and "(k" in found[0][0] and found[0][1] == "struct<v:string>"


def test_verdict_reads_test_partitions_and_four_columns(spark):
    cells, _, test = catalogue._cells(spark, FOLDER)
    found = scans(catalogue._paired(cells, test))
    assert found
    for filters, columns in found:
        assert "split" in filters and "= test" in filters and "arm" in filters
        assert columns in ("struct<date_id:bigint,sym_id:bigint,y:double,score:double>", "struct<date_id:bigint,sym_id:bigint,score:double>")
    assert any("(model" in f for f, _ in found)  # the shared comparator is one model's
