"""Exact ranks, positions and quantiles whose groups may be arbitrarily large.

A window over a whole group sorts that group in one task. That is the best plan while
the largest group fits a task, so every function measures the largest group first (one
partial-aggregated count). Beyond ``direct_rows`` the group is cut into ranges:

* rows are range-partitioned on (group, order columns), so a hot group spreads over
  many tasks and the partition number is stored durably (range boundaries are sampled
  and must not be drawn twice);
* ranks inside a range are shifted by the number of rows of the same group in earlier
  ranges, a table of at most (#ranges + #groups) rows.

Equal values are first collapsed to one (group, value, ties) row with map-side
combine, so a value that fills a third of the table is one row when ranking starts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import durable

DIRECT_ROWS = 1_000_000
RANGE_ROWS = 1_000_000
HEAVY_SHARE = 1_000


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   equal: Sequence[str] = ()) -> DataFrame:
    """Join on ``keys``, where NULL meets NULL, and on ``equal``, where it does not; the left side's names stay."""
    other = right.select(*[F.col(c).alias(f"_right_{c}") if c in (*keys, *equal) else F.col(c) for c in right.columns])
    on = [left[k].eqNullSafe(other[f"_right_{k}"]) for k in keys] + [left[k] == other[f"_right_{k}"] for k in equal]
    if not on:
        return left.crossJoin(other)  # one row per side of no keys at all
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in (*keys, *equal)])


def group_sizes(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """(all rows, rows of the largest group)."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.sum("_n").alias("total"), F.max("_n").alias("largest")).first()
    return int(row["total"] or 0), int(row["largest"] or 0)


def _range_count(rows: int, direct_rows: int) -> int:
    return max(2, math.ceil(rows / min(direct_rows, RANGE_ROWS)))


def _cut_into_ranges(df: DataFrame, keys: Sequence[Column | str], ranges: int) -> DataFrame:
    return durable(df.repartitionByRange(ranges, *keys)
                   .withColumn("_range", F.spark_partition_id()))


def _range_offsets(cut: DataFrame, group: Sequence[str], weight: Column) -> DataFrame:
    """Rows of the group in earlier ranges, and in all ranges."""
    per_range = cut.groupBy(*group, "_range").agg(F.sum(weight).alias("_in_range"))
    spec = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = spec.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        *group, "_range",
        F.coalesce(F.sum("_in_range").over(earlier), F.lit(0)).alias("_earlier"),
        F.sum("_in_range").over(spec).alias("_total"))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column],
              position: str = "position", size: str = "group_rows",
              direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Row number (from 1) in each group and the group's row count.

    ``order`` has to be a total order within the group (add a tie-break), both for a
    repeatable result and because it is what lets a hot group be cut anywhere.
    """
    group = list(group)
    rows, largest = group_sizes(df, group)
    if largest <= direct_rows:
        spec = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        return (df.withColumn(position, F.row_number().over(spec.orderBy(*order)).cast("long"))
                .withColumn(size, F.count(F.lit(1)).over(spec)))
    cut = _cut_into_ranges(df, [*group, *order], _range_count(rows, direct_rows))
    offsets = _range_offsets(cut, group, F.lit(1))
    inside = Window.partitionBy(*group, "_range").orderBy(*order)
    return (join_null_safe(cut, offsets, [*group, "_range"])
            .withColumn(position, F.row_number().over(inside) + F.col("_earlier"))
            .withColumnRenamed("_total", size)
            .drop("_range", "_earlier"))


def tie_blocks(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None,
               direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """One row per (group, value): ``ties``, rows ``below`` and group ``total``.

    NULL values take no part. ``weight`` is a row multiplicity when ``df`` is already
    collapsed; ``members`` counts the rows of ``df`` themselves.
    """
    group = list(group)
    multiplicity = F.col(weight) if weight else F.lit(1)
    blocks = (df.where(F.col(value).isNotNull()).groupBy(*group, value)
              .agg(F.sum(multiplicity).alias("ties"), F.count(F.lit(1)).alias("members")))
    rows, largest = group_sizes(blocks, group)
    if largest <= direct_rows:
        spec = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        earlier = spec.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.select(
            *group, value, "ties", "members",
            F.coalesce(F.sum("ties").over(earlier), F.lit(0)).alias("below"),
            F.sum("ties").over(spec).alias("total"))
    cut = _cut_into_ranges(blocks, [*group, value], _range_count(rows, direct_rows))
    offsets = _range_offsets(cut, group, F.col("ties"))
    inside = (Window.partitionBy(*group, "_range").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    return join_null_safe(cut, offsets, [*group, "_range"]).select(
        *group, value, "ties", "members",
        (F.coalesce(F.sum("ties").over(inside), F.lit(0)) + F.col("_earlier")).alias("below"),
        F.col("_total").alias("total"))


def middle_rank() -> Column:
    """Average rank of a tie block, counted from 1."""
    return F.col("below") + (F.col("ties") + 1) / F.lit(2.0)


def average_rank(df: DataFrame, group: Sequence[str], value: str, rank: str = "rank",
                 size: str = "ranked_rows", direct_rows: int = DIRECT_ROWS,
                 sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rank with ties averaged among the non-NULL values of each group.

    ``sizes`` passes on a result of :func:`group_sizes` when several columns of the same
    rows are ranked.
    """
    group = list(group)
    rows, largest = sizes or group_sizes(df, group)
    if largest <= direct_rows:
        spec = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        ordered = spec.orderBy(F.col(value).asc_nulls_last())
        equal = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        return (df.withColumn(rank, F.when(
                    F.col(value).isNotNull(),
                    F.rank().over(ordered) + (F.count(value).over(equal) - 1) / F.lit(2.0)))
                .withColumn(size, F.count(value).over(spec)))
    # stored once: both sides of the join below must see the same doubles, and the input runs once
    rows_in = durable(df)
    blocks = durable(tie_blocks(rows_in, group, value, direct_rows=direct_rows))
    ranked = blocks.select(*group, value, "members", middle_rank().alias(rank),
                           F.col("total").alias(size))
    placed = join_tie_blocks(rows_in.where(F.col(value).isNotNull()), ranked, group, value, rows)
    totals = rows_in.groupBy(*group).agg(F.count(value).alias(size))
    missing = join_null_safe(rows_in.where(F.col(value).isNull()), totals, group)
    return placed.unionByName(missing, allowMissingColumns=True)


def join_tie_blocks(df: DataFrame, blocks: DataFrame, group: Sequence[str], value: str, rows: int) -> DataFrame:
    """Attach stored per-value results to rows without sending a hot value to one task.

    A value with more than 1/1000 of the rows is heavy; there can be at most 1000 such
    values, so that side is broadcast. All other values go through a shuffle join. Groups
    may be NULL, values may not.
    """
    heavy = blocks.where(F.col("members") * HEAVY_SHARE > rows).drop("members")
    light = blocks.where(F.col("members") * HEAVY_SHARE <= rows).drop("members")
    hot = join_null_safe(df, F.broadcast(heavy), group, "inner", [value])
    rest = join_null_safe(df, F.broadcast(heavy.select(*group, value)), group, "left_anti", [value])
    return hot.unionByName(join_null_safe(rest, light, group, "inner", [value]))


def quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Sequence[float],
              out: str = "q", accuracy: int = 1000) -> DataFrame:
    """Exact linearly interpolated quantiles per group, as an array in ``out``; NULL values are left out.

    One plan, nothing is measured before it. A sketch of each group gives a bracket around every wanted
    position, wide enough for the error it states; one more pass counts what lies below, inside and above. Only
    the distinct values inside brackets, some 4 / ``accuracy`` of a group, are put in order. Rows below and
    above collapse to one per task, so a group may hold any share of all rows. A bracket that misses its
    position would stop the query; it cannot give another value.
    """
    group, wanted = list(group), [float(p) for p in probs]
    present = df.where(F.col(value).isNotNull()).select(*group, (F.col(value).cast("double") + F.lit(0.0)).alias("_v"))  # + 0.0: no -0.0
    ends = [(p - 2 / accuracy, p + 2 / accuracy) for p in wanted]
    marks = [min(1.0, max(0.0, e)) for pair in ends for e in pair]
    sketch = present.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", marks, F.lit(accuracy)).alias("_s"))
    brackets = F.array(*[F.struct((F.col("_s")[2 * i] if lo > 0 else F.lit(None).cast("double")).alias("lo"),
                                  (F.col("_s")[2 * i + 1] if hi < 1 else F.lit(None).cast("double")).alias("hi"))
                         for i, (lo, hi) in enumerate(ends)])
    tall = join_null_safe(present, sketch, group).select(*group, "_n", "_v", F.posexplode(brackets).alias("_i", "_b"))
    side = F.when(F.col("_v") < F.col("_b.lo"), -1).when(F.col("_v") > F.col("_b.hi"), 1).otherwise(0)
    counted = (tall.withColumn("_side", side).groupBy(*group, "_i", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_at"))
               .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_top"), F.min("_v").alias("_v"), F.max("_n").alias("_n")))
    spec = Window.partitionBy(*group, "_i").orderBy("_side", "_at").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_c").over(spec))
    position = (F.col("_n") - 1) * F.element_at(F.lit(wanted), F.col("_i") + 1)

    def value_at(rank: Column) -> Column:
        # a position next to the bracket is known too: the greatest value below it, the least above it
        first = F.col("_to") - F.col("_c")
        here = (first <= rank) & (rank < F.col("_to"))
        found = (F.when(F.col("_side") == 0, F.col("_v")).when((F.col("_side") == 1) & (first == rank), F.col("_v"))
                 .when((F.col("_side") == -1) & (F.col("_to") - 1 == rank), F.col("_top"))
                 .otherwise(F.raise_error(F.lit("a quantile's bracket missed it")).cast("double")))
        return F.when(here, found)

    low, high = value_at(F.floor(position)), value_at(F.ceil(position))
    near = placed.select(*group, "_i", "_n", (position - F.floor(position)).alias("_part"), low.alias("_low"), high.alias("_high"))
    each = near.groupBy(*group).agg(*[F.max(F.when(F.col("_i") == i, F.col(c))).alias(f"{c}{i}") for i in range(len(wanted)) for c in ("_low", "_high", "_part")])
    parts = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}") for i in range(len(wanted))]
    return each.select(*group, F.array(*parts).alias(out))


def rank_correlation(df: DataFrame, group: Sequence[str], x: str, y: str,
                     out: str = "ic", direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Spearman correlation per group (one row in all for an empty ``group``).

    Rows with a NULL side are left out. Pairs are collapsed first and stored, as their sizes
    are measured before they are ranked; the mean rank is known, so the sums are centred and nothing cancels.
    """
    group = list(group)
    pairs = durable(df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
                    .groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_w")))
    rows, largest = group_sizes(pairs, group)
    if largest <= direct_rows:
        spec = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        ranked = pairs
        for side, name in ((x, "_rx"), (y, "_ry")):
            up_to = spec.orderBy(side).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            equal = spec.orderBy(side).rangeBetween(Window.currentRow, Window.currentRow)
            ranked = ranked.withColumn(
                name, F.sum("_w").over(up_to) - (F.sum("_w").over(equal) - 1) / F.lit(2.0))
        ranked = ranked.withColumn("_n", F.sum("_w").over(spec))
    else:
        ranked = pairs
        for side, name in ((x, "_rx"), (y, "_ry")):
            blocks = durable(tie_blocks(pairs, group, side, "_w", direct_rows))
            keep = blocks.select(*group, side, "members", middle_rank().alias(name),
                                 F.col("total").alias(f"{name}n"))
            ranked = join_tie_blocks(ranked, keep, group, side, rows)
        ranked = ranked.withColumn("_n", F.col("_rxn"))
    mid = (F.col("_n") + 1) / F.lit(2.0)
    dx, dy, w = F.col("_rx") - mid, F.col("_ry") - mid, F.col("_w")
    return ranked.groupBy(*group).agg(
        F.try_divide(F.sum(w * dx * dy),
                     F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))).alias(out),
        F.sum("_w").alias("n"), F.countDistinct(x).alias("distinct_x"))
