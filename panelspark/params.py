"""Parameters of the panel research workflow.

Everything an operator needs is passed as an argument; these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- Fixed values -----------------------------------------------------------
# They must keep these values for results to agree with the published panel.
EPS = 1e-12
WEIGHT_EPS = 1e-8
RETURN_LAGS = (1, 5, 10, 20, 30, 60)
ROLL_WINDOWS = (5, 10, 20, 30, 60)
CORR_WINDOWS = (10, 20, 60)
MOMENTUM_WINDOWS = (5, 10, 20)
HORIZONS = (5, 20, 63, 126, 252)
XS_SOURCES = ("RET_20", "MOM_20", "MA_20")
Z_LIMIT = 8.0
SENTIMENT_HALF_LIFE = 5
LOOKBACK_ROWS = 504
MIN_HISTORY_ROWS = 300
TOP_FRACTION = 0.10
ONE_WAY_COST = 0.001
PERIODS_PER_YEAR = 252.0
DSR_TRIALS = 1152
EULER_GAMMA = 0.5772156649
CPCV_GROUPS, CPCV_TEST_GROUPS, CPCV_PURGE = 6, 2, 1
CSCV_GROUPS = 10
BLOCK_DATES = 16
TITLE_FALLBACK_WORDS = 60
LOOSE_TITLE_CHARS = 120
MIN_BODY_CHARS = 20
LONG_BODY_CHARS = 200
LEVERAGED_PATTERN = r"^(TQQQ|SQQQ|UVXY|VXX|SVXY|.*(BULL|BEAR)).*$"
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
POSITIVE_WORDS = (
    "beat beats beneficial best better boom boosted breakthrough exceeded gain "
    "gains grew growth high higher improve improved outperform positive profit "
    "profitable raise raised rally record rose strong strength surge upgrade "
    "upbeat win wins"
).split()
NEGATIVE_WORDS = (
    "bankrupt cut cuts decline declined drop dropped fall fell fraud "
    "investigation lawsuit loss losses lower miss missed plunge downgrade "
    "negative recall slump weak weakness warn warning sink sank slowdown halt"
).split()
# --- End of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Splits:
    """Calendar split of the panel; dates outside train/val/test are warm-up."""

    start: date = date(2011, 1, 1)
    train: tuple[date, date] = (date(2013, 1, 1), date(2019, 12, 31))
    val: tuple[date, date] = (date(2020, 1, 1), date(2020, 12, 31))
    test: tuple[date, date] = (date(2021, 1, 1), date(2023, 12, 28))

    @property
    def end(self) -> date:
        return self.test[1]


@dataclass(frozen=True)
class Floors:
    """Universe screen: absolute floors a ticker must clear, in this order."""

    first_date_max: date = date(2011, 1, 1)
    last_date_min: date = date(2023, 12, 20)
    n_rows_min: int = 2800
    max_gap_days: int = 10
    dollar_vol_min: float = 5_000_000.0
    news_total_min: int = 500
    train_years: tuple[int, ...] = tuple(range(2013, 2020))
    test_years: tuple[int, ...] = (2021, 2022, 2023)
    train_years_min: int = 5
    test_years_min: int = 2
    window_years: tuple[int, ...] = tuple(range(2011, 2024))


@dataclass(frozen=True)
class AcceptRule:
    """Thresholds of the pre-set accept rule for a paired contrast."""

    min_sharpe_gain: float = 0.20
    min_rank_ic_gain: float = 0.01
    max_pbo: float = 0.5
    max_p: float = 0.05


@dataclass(frozen=True)
class PanelSpec:
    """Settings of one panel build, bundled so that plans stay short."""

    splits: Splits = field(default_factory=Splits)
    floors: Floors = field(default_factory=Floors)
    lookback: int = LOOKBACK_ROWS
    min_history: int = MIN_HISTORY_ROWS
    horizon: int = 5
