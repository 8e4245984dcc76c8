"""Registered queries against their DuckDB twins on the smallest tables.

A cross-section of the catalogue by default; PANELSPARK_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import check, connect

FOLDER = "/root/testdata/sf0.001"
QUICK = ("daily_bars universe_reasons dedup_articles lexicon_sign next_session sentiment_daily rolling_features "
         "corr_features forward_labels xs_rank_features eligible_rows sequence_windows top_decile_net "
         "soft_decile_net rank_ic_pooled panel_gates truncation_causality trend_seasonal").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the generated tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()) if os.environ.get("PANELSPARK_ALL") else QUICK)
def test_query(spark, con, name):
    _, rows, problem = check(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert problem in (None, "no twin"), problem


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["t", "date", "gross", "turnover", "net"] and df.count() > 0


def test_audits_find_nothing(spark):
    for row in entry.queries()["truncation_causality"](spark, FOLDER).collect():
        assert row["bad"] == 0 and row["checked"] > 0
    gates = {r["gate"]: r for r in entry.queries()["sentiment_gates"](spark, FOLDER).collect()}
    for name in ("look_ahead", "news_day_age_not_zero", "news_day_decay_not_raw", "quiet_day_decay_rises", "symbols_off"):
        assert gates[name]["passed"] and gates[name]["value"] == 0
