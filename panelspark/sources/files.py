"""Raw files: per-ticker price CSVs, news CSVs and ticker lists."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions import text
from panelspark.sources.quoted_csv import read_quoted_csv

# Column names of the raw files.
PRICE_COLUMNS = ("date", "volume", "open", "high", "low", "close", "adj close")
NEWS_COLUMNS = {"Date": "ts", "Stock_symbol": "symbol", "Article_title": "title",
                "Article": "body", "Url": "url"}


def _ticker() -> Column:
    """A file's name without ``.csv``, which every file that is read ends with."""
    name = F.col("_metadata.file_name")
    return F.left(name, F.length(name) - 4)


def _header() -> Column:
    """Names of a price file's header line, lower-cased."""
    return F.transform(F.split(F.col("line"), ","), lambda c: F.lower(text.strip(c)))


def _named(*names: str) -> Column:
    """Whether a line is a header with these names. Only lines that hold their letters are cut into cells."""
    likely = reduce(and_, [F.contains(F.lower("line"), F.lit(n)) for n in names])
    return F.when(likely, F.size(F.array_intersect(_header(), F.lit(list(names)))) == len(names)).otherwise(F.lit(False))


def read_prices(spark: SparkSession, folder: str, problems: DataFrame | None = None) -> DataFrame:
    """Rows (ticker, date, volume, open, high, low, close, adj_close) of a folder of CSVs.

    The ticker is the file name. Columns are found by the names in each file's own header, in
    any order; other columns are ignored and missing ones are NULL. Dates and numbers that
    cannot be read are NULL. A file without a header gives no rows, and files listed in
    ``problems`` (see :func:`list_price_files`) are left out.
    """
    marked = F.startswith("value", F.lit("\ufeff")) | F.endswith("value", F.lit("\r"))
    lines = (spark.read.option("pathGlobFilter", "*.csv").text(folder)
             .select(_ticker().alias("ticker"), F.when(marked, F.regexp_replace("value", "^\ufeff|\r$", "")).otherwise(F.col("value")).alias("line"))
             .where(text.strip(F.col("line")) != ""))
    is_header = _named("date")
    headers = lines.where(is_header).groupBy("ticker").agg(F.min("line").alias("line")).select("ticker", _header().alias("names"))
    cells = F.split("line", ",", -1)

    def named(name: str) -> Column:
        at = F.array_position("names", name).cast("int")
        return F.when(at > 0, text.strip(F.get(cells, at - 1)))

    # a row a file: the lines need no sort to meet it
    rows = lines.where(~is_header).join(headers.hint("shuffle_hash"), "ticker").select(
        "ticker", named("date").try_cast("date").alias("date"),
        *[named(c).try_cast("double").alias(c.replace(" ", "_")) for c in PRICE_COLUMNS[1:]])
    if problems is not None:
        rows = rows.join(problems.where(F.col("problem").isNotNull()).select("ticker"), "ticker", "left_anti")
    return rows


def list_price_files(spark: SparkSession, folder: str, expected: DataFrame | None = None) -> DataFrame:
    """(ticker, lines, problem) per file, also for empty and header-less ones.

    Only names come from the listing; contents are counted as text lines. A file whose
    header lacks a needed column carries a problem text instead of stopping the job.
    Spark does not list files of zero bytes; tickers of ``expected`` cover those.
    """
    names = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
             .select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("ticker")))
    if expected is not None:
        names = names.unionByName(expected.select("ticker")).distinct()
    lines = (spark.read.option("pathGlobFilter", "*.csv").text(folder)
             .select(_ticker().alias("ticker"), F.trim("value").alias("line"))
             .where(F.col("line") != ""))
    is_header = _named("date", "volume", "close")
    counted = lines.groupBy("ticker").agg(F.count_if(~is_header).alias("lines"),
                                          F.count_if(is_header).alias("headers"))
    joined = names.join(counted, "ticker", "left").fillna(0, ["lines", "headers"])
    problem = (F.when((F.col("headers") == 0) & (F.col("lines") == 0), "no columns to parse")
               .when(F.col("headers") == 0, "needed columns are missing"))
    return joined.select("ticker", "lines", problem.alias("problem"))


def read_news(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """News rows (ts, symbol, title, body, url, src), all text.

    Columns are found by name in each file's own header, and a missing one is NULL. A line with too
    many fields is dropped, a short one is kept with NULLs. Bodies may hold line ends; files are read in
    parallel within, see :mod:`panelspark.sources.quoted_csv`.
    """
    return read_quoted_csv(spark, path, NEWS_COLUMNS).withColumn("src", F.lit(tag))


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """One ticker per line, trimmed and upper-cased."""
    lines = spark.read.text(path).select(text.symbol_of(F.col("value")).alias("ticker"))
    return lines.where(F.col("ticker") != "").distinct()
