"""Stored tables: column-pruned Parquet reads and the panel with split pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.features import KEYS, feature_columns
from panelspark.session import roomy


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    roomy(spark, f"{folder}/{name}.parquet")
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_panel(spark: SparkSession, path: str, splits: str | Sequence[str], horizon: int,
               symbols: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Panel rows of the given splits with one horizon's labels, and the feature names.

    The panel is stored partitioned by split, so other splits are not listed; the symbol
    list becomes a Parquet filter and unused labels are never read.
    """
    panel = spark.read.parquet(path)
    features = feature_columns(panel.columns)
    wanted = [splits] if isinstance(splits, str) else list(splits)
    rows = panel.where(F.col("split").isin(*wanted))
    if symbols is not None:
        rows = rows.where(F.col("symbol").isin(*symbols))
    return rows.select(*KEYS, f"fwd_ret_{horizon}", f"fwd_vol_{horizon}", *features), features


def load_scores(spark: SparkSession, root: str, model: str | None = None, arm: str | None = None) -> DataFrame:
    """Score rows of all stored cells; model and arm are partition filters."""
    rows = spark.read.parquet(root)
    if model is not None:
        rows = rows.where(F.col("model") == model)
    if arm is not None:
        rows = rows.where(F.col("arm") == arm)
    return rows
