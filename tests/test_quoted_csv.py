"""The parallel CSV reader against Python's csv module, with splits of a few hundred bytes."""

import csv
import io

import numpy as np
import pytest

from panelspark.sources import files, quoted_csv

COLUMNS = {"b": "body", "a": "title", "absent": "none"}


def written(rows, header=("a", "b", "c"), end="\r\n", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    w.writerow(header)
    w.writerows(rows)
    return out.getvalue()


def expected(text):
    """What Python's csv reads, by column name."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline="")) if r]
    names = rows[0]
    out = []
    for r in rows[1:]:
        if not any(r[len(names):]):
            out.append(tuple((r[names.index(c)] or None) if c in names and names.index(c) < len(r) else None for c in COLUMNS))
    return out


def made(seed, n):
    spin = np.random.default_rng(seed)
    parts = ["word", "a,b", '"', '""', "\n", "\r\n", "\n\n", "é", "日本", " ", "", "x" * 90, '",\n"', "\t"]
    return [["".join(spin.choice(parts, int(k))) for k in spin.integers(0, 7, 3)] for _ in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, folder):
    return sorted(map(tuple, quoted_csv.read_quoted_csv(spark, str(folder), COLUMNS).collect()), key=str)


@pytest.mark.parametrize("end,quoting", [("\n", csv.QUOTE_MINIMAL), ("\r\n", csv.QUOTE_MINIMAL), ("\n", csv.QUOTE_ALL), ("\r\n", csv.QUOTE_ALL)])
def test_one_file_is_many_tasks_and_equals_csv(small_splits, tmp_path, end, quoting):
    text = written(made(1, 250), end=end, quoting=quoting)
    (tmp_path / "news.csv").write_bytes(text.encode())
    frame = quoted_csv.read_quoted_csv(small_splits, str(tmp_path), COLUMNS)
    assert frame.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected(text), key=str)


def test_records_longer_than_splits_and_files_of_their_own(small_splits, tmp_path):
    texts = [written([["t1", "line\n" * 300 + 'say ""hi""', "z"], ["t2", "b2", "c"], ["t3", '"' * 900, "\n" * 700]]),  # records over many splits
             "﻿" + written([["u", "v"], ["only"], ["p", "q", ""]], header=("b", "a")),                            # BOM, other order, short, extra but empty
             written([["p", "q", "too", "many"]], header=("a", "b", "c")), "a,b\n", "a,b,c\n\n\r\nx,y,z\n\n", 'a,b\nx,"never closed\nz,z']
    for i, t in enumerate(texts):
        (tmp_path / f"f{i}.csv").write_bytes(t.encode())
    assert read(small_splits, tmp_path) == sorted((r for t in texts for r in expected(t)), key=str)


def test_whole_splits_give_the_same_rows(spark, tmp_path):
    text = written(made(2, 300))
    (tmp_path / "news.csv").write_bytes(text.encode())
    assert read(spark, tmp_path) == sorted(expected(text), key=str)
    plan = quoted_csv.read_quoted_csv(spark, str(tmp_path), COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_bytes_that_are_no_text_and_fields_of_any_length(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'a,b\n\xff\xfe,"' + b"y" * 300_000 + b'"\n')
    row = quoted_csv.read_quoted_csv(spark, str(tmp_path), COLUMNS).first()
    assert row["title"] == "��" and len(row["body"]) == 300_000


def test_news_has_its_columns_and_tag(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Url,Stock_symbol,Date,Article_title\nu,AA,2020-01-01,"two\nlines"\n')
    row = files.read_news(spark, str(tmp_path), "nasdaq").first()
    assert row.asDict() == {"ts": "2020-01-01", "symbol": "AA", "title": "two\nlines", "body": None, "url": "u", "src": "nasdaq"}
