"""Rolling statistics that are NULL until the whole window holds values.

All helpers take a window specification that is already partitioned by the series and
ordered by time. Series windows are bounded by the calendar: bars and sentiment are
unique per (symbol, date) before any window runs, so one symbol never has more rows
than there are days in the modelling window, however many ticks or articles it has.

A bounded frame of width w costs w updates per row and aggregate in Spark. Narrow windows
are therefore plain expressions over values fetched with ``lag`` (or ``lead``), and wide ones are put
together from two adjacent narrower ones that are already there: the
nearer block on the row itself, the farther block fetched with ``lag`` (or ``lead``).
Means and squared deviations of blocks merge without cancellation, and a block with a
missing value is NULL, which makes every window containing it NULL. Deviations of a narrow window
are taken from its nearest value, so a flat one has none. All stages keep the
same partitioning and order, so they add no exchange and no sort. Rows are a DataFrame or a
:class:`~panelspark.functions.blocks.Block` of whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelspark.functions.blocks import functions

DIRECT_WIDTH = 8


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(order)


def trailing(spec: WindowSpec, width: int) -> WindowSpec:
    return spec.rowsBetween(-(width - 1), 0)


def leading(spec: WindowSpec, width: int) -> WindowSpec:
    """The next ``width`` rows, not including the current one."""
    return spec.rowsBetween(1, width)


def before(spec: WindowSpec) -> WindowSpec:
    """Everything strictly before the current row; evaluated incrementally."""
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def so_far(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def whole(spec: WindowSpec | None) -> WindowSpec | None:
    return spec and spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def tiling(widths: Sequence[int]) -> list[tuple[int, int, int]]:
    """Steps (width, near, far) in build order; near 0 marks a direct frame."""
    steps: list[tuple[int, int, int]] = []
    built: set[int] = set()

    def build(width: int) -> None:
        if width in built:
            return
        pair = next(((a, width - a) for a in sorted(built, reverse=True) if width - a in built), None)
        if width <= DIRECT_WIDTH:
            pair = (0, 0)
        elif pair is None:
            near = width // 2 if width % 2 == 0 else width - 1
            build(near)
            if width - near not in built:
                build(width - near)
            pair = (near, width - near)
        steps.append((width, *pair))
        built.add(width)

    for width in sorted(widths):
        build(width)
    return steps


def mean_of(value: str, width: int) -> str:
    return f"_{value}_mean{width}"


def spread_of(value: str, width: int) -> str:
    return f"_{value}_dev{width}"


def high_of(value: str, width: int) -> str:
    return f"_{value}_max{width}"


def low_of(value: str, width: int) -> str:
    return f"_{value}_min{width}"


def joint_of(a: str, b: str, width: int) -> str:
    return f"_{a}_{b}_joint{width}"


def deviation(value: str, width: int, f=F) -> Column:
    """Sample standard deviation of a full window."""
    return f.sqrt(f.try_divide(f.col(spread_of(value, width)), f.lit(width - 1)))


def correlation(a: str, b: str, width: int, f=F) -> Column:
    """Correlation of a full window; NULL when one side is flat, where ``corr`` raises."""
    return f.try_divide(f.col(joint_of(a, b, width)),
                        f.sqrt(spread_of(a, width)) * f.sqrt(spread_of(b, width)))


def add_windows(df: DataFrame, spec: WindowSpec, widths: Sequence[int], moments: Sequence[str] = (),
                highs: Sequence[str] = (), lows: Sequence[str] = (),
                pairs: Sequence[tuple[str, str]] = (), ahead: bool = False) -> DataFrame:
    """Add statistics of full windows of every width in ``widths``.

    ``moments`` get mean and sum of squared deviations, ``highs`` and ``lows`` extremes,
    ``pairs`` the sum of joint deviations (both columns must be NULL together and be
    listed in ``moments``). Windows end at the current row, or start after it when
    ``ahead``. Columns carry the names of :func:`mean_of` and its siblings.
    """
    for width, near, far in tiling(widths):
        if near == 0:
            df = _direct(df, spec, width, moments, highs, lows, pairs, ahead)
            continue
        f = functions(df)
        shift = f.lead if ahead else f.lag
        parts = [name(v, far) for v in moments for name in (mean_of, spread_of)]
        parts += [high_of(v, far) for v in highs] + [low_of(v, far) for v in lows]
        parts += [joint_of(a, b, far) for a, b in pairs]
        fetched = df.select("*", *[shift(p, near).over(spec).alias(f"_far{p}") for p in parts])
        df = fetched.select(*df.columns, *_merged(functions(fetched), width, near, far, moments, highs, lows, pairs))
    return df


def _direct(df, spec, width, moments, highs, lows, pairs, ahead) -> DataFrame:
    f = functions(df)
    shift, steps = (f.lead, range(1, width + 1)) if ahead else (f.lag, range(width))
    values = list(dict.fromkeys([*moments, *highs, *lows]))
    fetched = df.select("*", *[shift(v, k).over(spec).alias(f"_at{k}_{v}") for k in steps if k for v in values])
    f = functions(fetched)

    @cache
    def cells(v: str) -> list[Column]:
        return [f.col(f"_at{k}_{v}") if k else f.col(v).cast("double") if v in moments else f.col(v) for k in steps]

    @cache
    def gaps(v: str) -> list[Column]:
        near, *rest = cells(v)
        return [near - near, *[x - near for x in rest]]

    @cache
    def off(v: str) -> list[Column]:
        return [x - f.col(f"_mid_{v}") for x in gaps(v)]

    def extreme(v: str, pick) -> Column:
        whole = reduce(and_, [x.isNotNull() for x in cells(v)])
        return f.when(whole, pick(*cells(v)) if width > 1 else cells(v)[0])

    centred = fetched.select("*", *[(reduce(add, gaps(v)) / width).alias(f"_mid_{v}") for v in moments])
    f = functions(centred)
    out = []
    for v in moments:
        out.append((reduce(add, cells(v)) / width).alias(mean_of(v, width)))
        out.append(reduce(add, [x * x for x in off(v)]).alias(spread_of(v, width)))
    out += [extreme(v, f.greatest).alias(high_of(v, width)) for v in highs]
    out += [extreme(v, f.least).alias(low_of(v, width)) for v in lows]
    out += [reduce(add, [x * y for x, y in zip(off(a), off(b))]).alias(joint_of(a, b, width)) for a, b in pairs]
    return centred.select(*df.columns, *out)


def _merged(f, width, near, far, moments, highs, lows, pairs) -> list[Column]:
    @cache
    def gap(v: str) -> Column:
        return f.col(f"_far{mean_of(v, far)}") - f.col(mean_of(v, near))

    def both(name) -> tuple[Column, Column]:
        return f.col(name(near)), f.col(f"_far{name(far)}")

    share = near * far / width
    out = []
    for v in moments:
        a, b = both(lambda w: mean_of(v, w))
        out.append(((a * near + b * far) / width).alias(mean_of(v, width)))
        a, b = both(lambda w: spread_of(v, w))
        out.append((a + b + gap(v) * gap(v) * share).alias(spread_of(v, width)))
    for values, name, pick in ((highs, high_of, f.greatest), (lows, low_of, f.least)):
        for v in values:
            a, b = both(lambda w: name(v, w))
            out.append(f.when(a.isNotNull() & b.isNotNull(), pick(a, b)).alias(name(v, width)))
    for x, y in pairs:
        a, b = both(lambda w: joint_of(x, y, w))
        out.append((a + b + gap(x) * gap(y) * share).alias(joint_of(x, y, width)))
    return out
