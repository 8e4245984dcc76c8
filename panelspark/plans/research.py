"""The workflow end to end: raw bars and news to a normalised panel, scores to a verdict."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame

from panelspark import params
from panelspark.functions import ranking
from panelspark.functions.blocks import Block, by_symbol
from panelspark.operators import bars as B
from panelspark.operators import features as X
from panelspark.operators import inference as I
from panelspark.operators import normalise as N
from panelspark.params import AcceptRule, Splits
from panelspark.session import durable


def scaled_features(columns: Sequence[str]) -> list[str]:
    """Features that are z-scored: all but the news flag."""
    return [c for c in X.feature_columns(columns) if c != "HAS_NEWS"]


def own_features(joined: DataFrame | Block, horizons: Sequence[int] = params.HORIZONS) -> DataFrame | Block:
    """Everything that needs one symbol's history only, from bars with their sentiment.

    Labels come first, while rows are narrow: their horizons take the most window stages.
    """
    return X.price_features(X.sentiment_features(X.forward_labels(joined, horizons))).drop(*"ohlcv")


def normalised_features(joined: DataFrame | Block, horizons: Sequence[int] = params.HORIZONS) -> DataFrame | Block:
    """:func:`own_features`, normalised on the training rows of the symbol, in storage types."""
    wide = own_features(joined, horizons)
    return X.to_storage_types(N.fit_apply(wide, scaled_features(wide.columns)))


def rank_sources(bars: DataFrame | Block) -> DataFrame | Block:
    """The columns that are ranked."""
    sources = X.price_features(bars, lags=(20,), windows=(20,), correlations=(), momenta=(20,))
    return sources.select("symbol", "date", *params.XS_SOURCES)


def market_features(bars: DataFrame, splits: Splits, direct_rows: int = ranking.DIRECT_ROWS) -> DataFrame:
    """Cross-sectional ranks, from the three source columns only.

    This is the one part that regroups rows by date. It carries five columns, not the
    wide panel.
    """
    narrow, sizes = by_symbol(bars, rank_sources), ranking.group_sizes(bars, ["date"])
    return B.tag_split(X.cross_sectional_ranks(narrow, direct_rows=direct_rows, sizes=sizes), splits).drop(*params.XS_SOURCES)


def _panel(bars: DataFrame, sentiment: DataFrame, splits: Splits, step: Callable[[Block], Block]) -> DataFrame:
    """The ranks join the bars, not the panel: a joined row holds eighteen columns, and what has 80 is made by ``step``
    after the last exchange, a block of whole symbols at a time."""
    ranks = market_features(bars, splits).drop("split")
    joined = B.tag_split(X.join_sentiment(bars.join(ranks, ["symbol", "date"]), sentiment), splits)
    wide = by_symbol(joined, step)
    last = ["split", *[c for c in ranks.columns if c not in X.KEYS]]
    return wide.select(*[c for c in wide.columns if c not in last], *last)


def raw_panel(bars: DataFrame, sentiment: DataFrame, splits: Splits,
              horizons: Sequence[int] = params.HORIZONS) -> DataFrame:
    """All features, labels and split tags before normalisation."""
    return _panel(bars, sentiment, splits, partial(own_features, horizons=tuple(horizons)))


def build_panel(bars: DataFrame, sentiment: DataFrame, splits: Splits,
                horizons: Sequence[int] = params.HORIZONS) -> DataFrame:
    """The normalised panel in storage types.

    ``bars`` are adjusted and unique per (symbol, date); pass stored bars, they are read
    twice. Features are normalised where they are computed, partitioned by symbol, so the
    wide rows are never shuffled.
    """
    return _panel(bars, sentiment, splits, partial(normalised_features, horizons=tuple(horizons)))


def verdict(cells: DataFrame, test_dates: DataFrame, rule: AcceptRule = AcceptRule(),
            shared_arm: str = "ridge") -> tuple[DataFrame, DataFrame]:
    """(contrast per model, overall verdict) of stored score cells on the test dates."""
    average = I.average_scores(cells)
    paired = I.pair_arms(average, shared=shared_arm).join(test_dates, "date_id", "left_semi")
    table = durable(I.contrast(durable(paired), rule=rule))
    return table, I.verdict(table)
