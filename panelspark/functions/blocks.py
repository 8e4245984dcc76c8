"""Whole series as numpy columns, under the names the plans use for Spark columns.

A chain of window stages copies every row once a stage, and a panel has some fifty stages over rows of a
hundred columns. Operators that need one symbol's history only are written against :func:`functions`, so the same
formulas also run on a :class:`Block`: the rows of some whole symbols in date order, one array per column. A
:class:`Cell` follows Spark's rules value by value: NULL is a mask and not NaN, a logarithm outside its domain and a
quotient by zero are NULL, NaN is the greatest number. Sums run in the order of the formula, so doubles agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from panelspark.session import shipped

#: Rows worked on at once: a column of them stays in a core's cache.
BLOCK_ROWS = 16384
_TYPES = {"double": np.float64, "float": np.float32, "byte": np.int8}


def _either(*masks: np.ndarray | None) -> np.ndarray | None:
    some = [m for m in masks if m is not None]
    if len(some) < 2:
        return some[0] if some else None
    out = some[0] | some[1]
    for m in some[2:]:
        out |= m
    return out


class Cell:
    """A column: values, a mask that is true where it is NULL (None: nowhere), and a name."""

    __slots__ = ("values", "null", "name")
    __hash__ = None

    def __init__(self, values: np.ndarray, null: np.ndarray | None = None, name: str = "") -> None:
        self.values, self.null, self.name = values, null, name

    def alias(self, name: str) -> Cell:
        return Cell(self.values, self.null, name)

    def cast(self, to: str) -> Cell:
        return Cell(self.values.astype(_TYPES[to], copy=False), self.null)

    def isNotNull(self) -> Cell:
        return Cell(np.ones(len(self.values), bool) if self.null is None else ~self.null)

    def _with(self, other: Any, work: Callable, flip: bool = False) -> Cell:
        values, null = (other.values, other.null) if isinstance(other, Cell) else (other, None)
        return Cell(work(values, self.values) if flip else work(self.values, values), _either(self.null, null))

    def __add__(self, other): return self._with(other, np.add)
    def __sub__(self, other): return self._with(other, np.subtract)
    def __mul__(self, other): return self._with(other, np.multiply)
    def __radd__(self, other): return self._with(other, np.add, True)
    def __rsub__(self, other): return self._with(other, np.subtract, True)
    def __rmul__(self, other): return self._with(other, np.multiply, True)
    def __eq__(self, other): return self._with(other, np.equal)

    def __and__(self, other: Cell) -> Cell:
        return Cell(self.true() & other.true())

    def __truediv__(self, other: Any) -> Cell:
        if not isinstance(other, Cell):
            return self._with(other, np.true_divide)
        zero = other.values == 0
        return Cell(np.true_divide(self.values, other.values), _either(self.null, other.null, zero if zero.any() else None))

    def true(self) -> np.ndarray:
        """Where a condition holds."""
        return self.values if self.null is None else self.values & ~self.null


class Given:
    """A column that is no number: kept as it came."""

    __hash__ = None

    def __init__(self, array: pa.Array, name: str = "") -> None:
        self.array, self.name = array, name

    def alias(self, name: str) -> Given:
        return Given(self.array, name)

    def __eq__(self, other: Any) -> Cell:
        return Cell(pc.fill_null(pc.equal(self.array, other), False).to_numpy(zero_copy_only=False))


class _Shift:
    def __init__(self, block: Block, cell: Cell, by: int) -> None:
        self.block, self.cell, self.by = block, cell, by

    def over(self, _: None) -> Cell:
        return self.block.shifted(self.cell, self.by)


class _Largest:
    def __init__(self, block: Block, cell: Cell) -> None:
        self.block, self.cell = block, cell

    def over(self, _: None) -> Cell:
        return self.block.largest(self.cell)


class Functions:
    """The part of ``pyspark.sql.functions`` the operators use, on the columns of one block."""

    def __init__(self, block: Block) -> None:
        self.block = block

    def col(self, name: str) -> Cell | Given:
        return self.block.cells[name]

    def _cell(self, x: Cell | str) -> Cell:
        return self.block.cells[x] if isinstance(x, str) else x

    def lit(self, value: Any) -> Cell:
        return Cell(np.asarray(value))

    def _real(self, x: Cell | str, work: Callable, above: float | None = None) -> Cell:
        x = self._cell(x)
        values = x.values.astype(float, copy=False)
        outside = None if above is None else values <= above
        return Cell(work(values), x.null if outside is None or not outside.any() else _either(x.null, outside))

    def ln(self, x: Cell | str) -> Cell:
        return self._real(x, np.log, 0.0)

    def log1p(self, x: Cell | str) -> Cell:
        return self._real(x, np.log1p, -1.0)

    def sqrt(self, x: Cell | str) -> Cell:
        return self._real(x, np.sqrt)

    def try_divide(self, x: Cell, y: Cell) -> Cell:
        return x / y

    def nullif(self, x: Cell, y: Cell) -> Cell:
        equal = (x == y).true()
        return Cell(x.values, _either(x.null, equal) if equal.any() else x.null)

    def when(self, condition: Cell, value: Cell) -> Cell:
        return Cell(value.values, _either(value.null, ~condition.true()))

    def coalesce(self, x: Cell, y: Cell) -> Cell:
        return x if x.null is None else Cell(np.where(x.null, y.values, x.values), None if y.null is None else x.null & y.null)

    def _pick(self, work: Callable, first: Cell, *others: Cell) -> Cell:
        for x in others:
            values = work(first.values, x.values)
            if first.null is not None:
                values = np.where(first.null, x.values, values)
            if x.null is not None:
                values = np.where(x.null, first.values, values)
            first = Cell(values, None if first.null is None or x.null is None else first.null & x.null)
        return first

    def greatest(self, *cells: Cell) -> Cell:
        return self._pick(np.maximum, *cells)

    def least(self, *cells: Cell) -> Cell:
        return self._pick(np.fmin, *cells)

    def lag(self, x: Cell | str, by: int) -> _Shift:
        return _Shift(self.block, self._cell(x), by)

    def lead(self, x: Cell | str, by: int) -> _Shift:
        return _Shift(self.block, self._cell(x), -by)

    def max(self, x: Cell | str) -> _Largest:
        return _Largest(self.block, self._cell(x))


class Block:
    """Rows of whole series in order. Numbers are cells, other columns stay as they came."""

    def __init__(self, cells: dict[str, Cell | Given], place: np.ndarray) -> None:
        self.cells, self.place, self.rows = cells, place, len(place)
        self.starts = np.flatnonzero(place == 0)
        self.lengths = np.diff(np.append(self.starts, self.rows))
        self._outside: dict[int, np.ndarray] = {}

    @staticmethod
    def of(batch: pa.RecordBatch, place: np.ndarray) -> Block:
        return Block({n: _cell(batch.column(i), n) for i, n in enumerate(batch.schema.names)}, place)

    @property
    def columns(self) -> list[str]:
        return [*self.cells]

    def select(self, *chosen: Cell | Given | str) -> Block:
        cells: dict[str, Cell | Given] = {}
        for x in chosen:
            if not isinstance(x, str):
                cells[x.name] = x
            elif x == "*":
                cells.update(self.cells)
            else:
                cells[x] = self.cells[x]
        return self._like(cells)

    def withColumn(self, name: str, cell: Cell) -> Block:
        return self._like(self.cells | {name: cell.alias(name)})

    def drop(self, *names: str) -> Block:
        return self._like({n: c for n, c in self.cells.items() if n not in names})

    def _like(self, cells: dict[str, Cell | Given]) -> Block:
        out = object.__new__(Block)
        out.__dict__.update(self.__dict__, cells=cells)
        return out

    def shifted(self, cell: Cell, by: int) -> Cell:
        """Values ``by`` rows back in the same series, or ahead if it is negative."""
        if by not in self._outside:
            left = np.repeat(self.lengths, self.lengths) - 1 - self.place if by < 0 else self.place
            self._outside[by] = left < abs(by)
        values, null = np.zeros_like(cell.values), self._outside[by]
        kept = max(self.rows - abs(by), 0)
        head, tail = slice(0, kept), slice(self.rows - kept, None)
        to, of = (tail, head) if by > 0 else (head, tail)
        values[to] = cell.values[of]
        if cell.null is not None:
            null = null.copy()
            null[to] |= cell.null[of]
        return Cell(values, null)

    def largest(self, cell: Cell) -> Cell:
        """The greatest value of the series on each of its rows."""
        if not self.rows:
            return cell
        least = np.iinfo(cell.values.dtype).min if cell.values.dtype.kind == "i" else -np.inf
        values = cell.values if cell.null is None else np.where(cell.null, least, cell.values)
        null = None if cell.null is None else np.repeat(np.logical_and.reduceat(cell.null, self.starts), self.lengths)
        return Cell(np.repeat(np.maximum.reduceat(values, self.starts), self.lengths), null)

    def moments(self, names: list[str], chosen: np.ndarray) -> tuple[list[Cell], list[Cell]]:
        """Mean and sample deviation of the chosen rows per series, on each of its rows.

        Values are added one after the other, as the engine adds them: a flat column has no deviation at all, and no
        rounding decides whether it has. One step takes the next row of all series and columns.
        """
        at = np.flatnonzero(chosen)
        owner = np.searchsorted(self.starts, at, side="right") - 1
        number = np.bincount(owner, minlength=len(self.starts))
        begins = np.cumsum(number) - number
        order = np.argsort(-number, kind="stable")
        x = np.stack([self.cells[n].values[at].astype(float, copy=False) for n in names], axis=1) if names else np.empty((len(at), 0))
        there = np.stack([np.ones(len(at), bool) if (m := self.cells[n].null) is None else ~m[at] for n in names], axis=1) if names else x.astype(bool)
        count, total, mean, spread = (np.zeros((len(number), len(names))) for _ in range(4))
        going = len(number) - np.searchsorted(np.sort(number), np.arange(number.max(initial=0)), side="right")
        for step, k in enumerate(going.tolist()):
            row = begins[order[:k]] + step
            value, here = x[row], there[row]
            count[:k] += here
            off = value - mean[:k]
            share = off / np.maximum(count[:k], 1.0)
            np.add(total[:k], value, out=total[:k], where=here)
            np.add(mean[:k], share, out=mean[:k], where=here)
            np.add(spread[:k], off * (off - share), out=spread[:k], where=here)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        count, total, spread = count[back], total[back], spread[back]
        deviation = np.sqrt(spread / np.maximum(count - 1, 1.0))
        average = total / np.maximum(count, 1.0)

        def spread_out(values: np.ndarray, null: np.ndarray) -> list[Cell]:
            return [Cell(np.repeat(values[:, i], self.lengths), np.repeat(null[:, i], self.lengths)) for i in range(len(names))]

        return spread_out(average, count < 1), spread_out(deviation, count < 2)

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c.values, mask=c.null) if isinstance(c, Cell) else c.array for c in self.cells.values()]
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


def _cell(array: pa.Array, name: str) -> Cell | Given:
    kind = array.type
    if not (pa.types.is_floating(kind) or pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return Given(array, name)
    null = pc.is_null(array).to_numpy(zero_copy_only=False) if array.null_count else None
    return Cell(pc.fill_null(array, pa.scalar(0).cast(kind)).to_numpy(zero_copy_only=False), null, name)


def functions(df: DataFrame | Block) -> Any:
    """``pyspark.sql.functions`` for a DataFrame, their like on a block's own columns."""
    return Functions(df) if isinstance(df, Block) else F


def series_of(df: DataFrame | Block, *keys: str, order: str | None = "date") -> WindowSpec | None:
    """The window of one series in order; a block is cut by series and in order already."""
    if isinstance(df, Block):
        return None
    spec = Window.partitionBy(*keys)
    return spec.orderBy(order) if order else spec


_PLACE = "_place_in_series"


def by_symbol(df: DataFrame, step: Callable[[Block], Block], rows: int = BLOCK_ROWS) -> DataFrame:
    """``step`` on blocks of whole symbols, their rows in date order. Names and types are those it gives an empty block.

    The row number is a window by symbol, whose needs the engine meets and keeps in whatever way it plans, splits or
    merges tasks: a task holds whole symbols, sorted. A symbol's rows are bounded by the calendar.
    """
    shipped(df.sparkSession)
    placed = df.withColumn(_PLACE, F.row_number().over(series_of(df, "symbol")) - 1)
    given = to_arrow_schema(placed.schema)
    empty = pa.RecordBatch.from_arrays([pa.array([], t) for t in given.types], schema=given)
    return placed.mapInArrow(partial(_blocks, step=step, least=rows), from_arrow_schema(_worked(empty, step).schema))


def _worked(rows: pa.RecordBatch, step: Callable[[Block], Block]) -> pa.RecordBatch:
    at = rows.schema.get_field_index(_PLACE)
    with np.errstate(all="ignore"):
        return step(Block.of(rows.remove_column(at), rows.column(at).to_numpy())).batch()


def _blocks(batches: Iterator[pa.RecordBatch], step: Callable[[Block], Block], least: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    count, enough = 0, least
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= enough:
            rows = pa.concat_batches(held)
            last = int(np.flatnonzero(rows.column(_PLACE).to_numpy() == 0)[-1])  # the last symbol may go on
            if last:
                yield _worked(rows.slice(0, last), step)
            held, count = [rows.slice(last)], rows.num_rows - last
            enough = max(least, 2 * count)
    if count:
        yield _worked(pa.concat_batches(held), step)
