"""CSV whose quoted fields may hold line ends, read in parallel inside a file.

Whether a line end ends a record depends on every quote before it in the file. A first pass counts each
split's quotes; a running parity over the splits of a file, a row each, says which of them begin
inside a quoted field. With that the second pass cuts every split by itself. Records that cross a border
leave one piece in each split they touch; these pieces alone are grouped and put together.

Quotes must be balanced as RFC 4180 has it: a quote inside a field is doubled and its field is quoted.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.session import shipped

SPLITS = "path string, start long, odd int, ends_inside boolean, header binary"
PIECES = "path string, owner long, start long, tail int, piece binary, header binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes in the order of the file, with the file and the first byte of their split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, start, first row, end row) of the splits in a batch; rows of a split stand together."""
    if not batch.num_rows:
        return
    codes = pc.dictionary_encode(batch.column(0))
    at, start = codes.indices.to_numpy(), batch.column(1).to_numpy()
    first = np.concatenate([[0], 1 + np.flatnonzero((np.diff(at) != 0) | (np.diff(start) != 0))])
    for lo, hi in zip(first, [*first[1:], batch.num_rows]):
        yield codes.dictionary[int(at[lo])].as_py(), int(start[lo]), int(lo), int(hi)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype(np.int64)


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: parity of its quotes, whether a record ends in it if it begins inside one, the header."""
    done: list[dict] = []
    for batch in batches:
        for path, start, lo, hi in _runs(batch):
            if not done or (done[-1]["path"], done[-1]["start"]) != (path, start):
                done.append({"path": path, "start": start, "odd": 0, "ends_inside": False, "header": None, "_head": [] if start == 0 else None})
            now, lines = done[-1], batch.column(2).slice(lo, hi - lo)
            parity = (now["odd"] + np.cumsum(_quotes(lines))) % 2
            now["ends_inside"] |= bool((parity == 1).any())
            for line, odd in zip(lines, parity) if now["_head"] is not None else ():
                now["_head"].append(line.as_py())
                if not odd:
                    text = b"\n".join(now["_head"])
                    now["_head"] = []
                    if text.strip(b"\r\n\xef\xbb\xbf"):
                        now["header"], now["_head"] = text, None
                        break
            now["odd"] = int(parity[-1])
    for now in done:
        now.pop("_head")
    yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.int32()),
                                                             ("ends_inside", pa.bool_()), ("header", pa.binary())]))


def split_table(lines: DataFrame) -> DataFrame:
    """(path, start, inside, owner, header) per split.

    ``inside`` is 1 if the split begins inside a quoted field; ``owner`` is the split in which the record begins that
    reaches into this one. One row per task of the scan, so per file no more than its splits.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = lines.mapInArrow(_surveyed, SPLITS)
    found = found.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begins = F.when((F.col("inside") == 0) | F.col("ends_inside"), F.col("start"))
    return found.select("path", "start", F.col("inside").cast("int").alias("inside"),
                        F.coalesce(F.last(begins, ignorenulls=True).over(before), F.lit(0).cast("long")).alias("owner"),
                        F.max("header").over(Window.partitionBy("path")).alias("header"))


class _Cutter:
    """Follows one task's lines: whole records of a split, and the pieces at its borders."""

    def __init__(self) -> None:
        self.key: tuple | None = None
        self.header: bytes | None = None
        self.skip = False
        self.parity = self.owner = 0
        self.head, self.held = False, []

    def enter(self, path: str, start: int, inside: int | None, owner: int, header: bytes | None) -> None:
        if inside is None:
            raise ValueError(f"the splits of {path} changed while it was read")
        self.key, self.parity, self.head, self.owner, self.header = (path, start), inside, inside == 1, owner, header
        self.skip, self.held = start == 0, []

    def feed(self, lines: pa.Array) -> tuple[list[bytes], list[bytes] | None]:
        """(lines of whole records, lines of the piece that ends here or None)."""
        parity = (self.parity + np.cumsum(_quotes(lines))) % 2
        self.parity = int(parity[-1])
        ends, rows = np.flatnonzero(parity == 0), lines.to_pylist()
        piece = None
        if self.head:
            cut = int(ends[0]) + 1 if len(ends) else len(rows)
            self.held += rows[:cut]
            if not len(ends):
                return [], None
            piece, self.held, self.head = self.held, [], False
            rows, ends = rows[cut:], ends[1:] - cut
        if not len(ends):
            self.held += rows
            return [], piece
        last = int(ends[-1]) + 1
        whole, self.held = self.held + rows[:last], rows[last:]
        return whole, piece


def _records(text: bytes, header: bytes | None, wanted: Mapping[str, str], skip: bool = False) -> tuple[list[list], bool]:
    """(values of the wanted columns of every record, whether a header is still to be skipped)."""
    csv.field_size_limit(sys.maxsize)
    if header is None:
        raise ValueError("a file's header must lie within its first split")
    names = next(csv.reader(io.StringIO(header.decode("utf-8", "replace").lstrip("\ufeff"), newline="")))
    at = [names.index(raw) if raw in names else None for raw in wanted]
    out = []
    for fields in csv.reader(io.StringIO(text.decode("utf-8", "replace"), newline="")):
        if not fields or fields == ["\ufeff"]:
            continue
        if skip:
            skip = False
        elif not any(fields[len(names):]):
            out.append([(fields[i] or None) if i is not None and i < len(fields) else None for i in at])
    return out, skip


def _table(rows: list[list], wanted: Mapping[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(wanted))], names=list(wanted.values()))


def _cut(batches: Iterator[pa.RecordBatch], wanted: Mapping[str, str], pieces: bool) -> Iterator[pa.RecordBatch]:
    """Records of the wanted columns, or with ``pieces`` what is left at the borders of the splits."""
    now = _Cutter()

    def piece(lines: list[bytes], owner: int, tail: int) -> pa.RecordBatch:
        row = {"path": now.key[0], "owner": owner, "start": now.key[1], "tail": tail, "piece": b"\n".join(lines), "header": now.header}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("path", pa.string()), ("owner", pa.int64()), ("start", pa.int64()), ("tail", pa.int32()),
                                                                   ("piece", pa.binary()), ("header", pa.binary())]))

    def leave() -> Iterator[pa.RecordBatch]:
        if pieces and now.key and now.held:
            yield piece(now.held, now.owner if now.head else now.key[1], 0 if now.head else 1)

    for batch in batches:
        for path, start, lo, hi in _runs(batch):
            if now.key != (path, start):
                yield from leave()
                now.enter(path, start, *[batch.column(i)[lo].as_py() for i in (3, 4, 5)])
            whole, border = now.feed(batch.column(2).slice(lo, hi - lo))
            if pieces and border is not None:
                yield piece(border, now.owner, 0)
            if not pieces and whole:
                rows, now.skip = _records(b"\n".join(whole), now.header, wanted, now.skip)
                yield _table(rows, wanted)
    yield from leave()


def _joined(batches: Iterator[pa.RecordBatch], wanted: Mapping[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, header in zip(batch.column(0), batch.column(1)):
            yield _table(_records(text.as_py(), header.as_py(), wanted)[0], wanted)


def read_quoted_csv(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """Text columns of all CSV files under ``path``, found by name in each file's own header: raw name to new name.

    Records are those of Python's csv module: quoted fields may hold commas, line ends and doubled quotes,
    lines end with a line feed, with or without a carriage return. An empty field, a missing column and the
    missing end of a short record are NULL; a record with a filled field beyond the header is dropped; empty lines
    are no records. A file of any size is as many tasks as it has splits, and nothing is run per file.
    """
    lines = _lines(shipped(spark), path)
    # one row per task of the scan, which the driver schedules anyway: bounded by the number of splits
    marked = lines.join(F.broadcast(split_table(lines)), ["path", "start"], "left").select("path", "start", "line", "inside", "owner", "header")
    shape = ", ".join(f"`{name}` string" for name in columns.values())
    inner = marked.mapInArrow(partial(_cut, wanted=dict(columns), pieces=False), shape)
    pieces = marked.mapInArrow(partial(_cut, wanted=dict(columns), pieces=True), PIECES)
    # a group is one record: its first piece and what the following splits hold of it
    whole = pieces.groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "tail", "piece"))).alias("_all"), F.first("header").alias("header"))
    text = F.aggregate(F.col("_all"), F.lit(None).cast("binary"), lambda acc, p: F.coalesce(F.concat(acc, F.lit("\n").cast("binary"), p["piece"]), p["piece"]))
    return inner.unionByName(whole.select(text.alias("_text"), "header").mapInArrow(partial(_joined, wanted=dict(columns)), shape))
