"""Sinks: Parquet panel, CSV and JSON results, idempotent score cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from panelspark.operators.folds import pending_cells

CELL = ("model", "arm", "seed", "fold")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """zstd Parquet; the panel is written ``by=["split"]`` for partition pruning."""
    df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV as RFC 4180 has it: quotes doubled inside quoted fields, white space kept, NULL and empty the same."""
    (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", quote_all)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path))


def write_ticker_files(lines: DataFrame, folder: str) -> None:
    """One text file ``<ticker>.csv`` per ticker from (ticker, rank, date, line), in order of rank and date.

    A ticker's file is the history of one symbol, which the calendar bounds. Files are written by the tasks that
    hold the rows, under a name of their own, and put in place by a rename, so a repeated task does no harm.
    """
    def save(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs
        place, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        place.create_dir(root, recursive=True)
        ticker, out, wide = None, [], pa.large_binary()

        def close():
            if ticker is not None:
                name = f"{root}/_{uuid.uuid4().hex}"
                with place.open_output_stream(name) as f:
                    f.writelines(out)
                place.move(name, f"{root}/{ticker}.csv")

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            if not batch.num_rows:
                continue
            # a ticker's lines stand together: their bytes are one stretch of the batch
            codes = pc.dictionary_encode(batch.column(0))
            place_of = codes.indices.to_numpy()
            first = np.concatenate([[0], 1 + np.flatnonzero(np.diff(place_of))])
            lines = pc.binary_join_element_wise(batch.column(1).cast(wide), pa.scalar(b"", wide), pa.scalar(b"\n", wide))
            ends, text = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:], lines.buffers()[2]
            for lo, hi in zip(first, [*first[1:], batch.num_rows]):
                t = codes.dictionary[int(place_of[lo])].as_py()
                if t != ticker:
                    close()
                    ticker, out = t, []
                out.append(text[int(ends[lo]):int(ends[hi])].to_pybytes())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([1])], names=["done"])

    ordered = lines.repartition("ticker").sortWithinPartitions("ticker", "rank", "date").select("ticker", "line")
    ordered.mapInArrow(save, "done long").agg({"done": "sum"}).collect()


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scores(scores: DataFrame, root: str) -> None:
    """Store score rows by cell; only the cells present in ``scores`` are replaced.

    The rebalance hint merges small cells into few files and splits a large one.
    """
    (scores.hint("rebalance", *CELL).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy(*CELL).parquet(root))


def store_stage(rows: DataFrame, root: str, by: Sequence[str]) -> DataFrame:
    """Write a stage table partitioned by ``by`` and return it as stored.

    The next stage reads only the partitions and columns it names, and a lost executor repeats a task of that
    stage, not the stage before. Partitions are merged into few files or split into several by their size.
    """
    (rows.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .option("compression", "zstd").partitionBy(*by).parquet(root))
    order = [*[c for c in rows.columns if c not in by], *by]
    return rows.sparkSession.read.schema(rows.select(order).schema).parquet(root).select(rows.columns)


def finished_cells(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(root).select(*CELL).distinct()
    except AnalysisException:
        return None


def backlog(grid: DataFrame, root: str, selected: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(cells to run, cells to defer): finished cells are skipped, cells of a (model, arm)
    without a selected configuration are deferred."""
    done = finished_cells(grid.sparkSession, root)
    todo = grid if done is None else pending_cells(grid, done)
    if selected is None:
        return todo, None
    chosen = selected.select("model", "arm").distinct()
    return (todo.join(chosen, ["model", "arm"], "left_semi"),
            todo.join(chosen, ["model", "arm"], "left_anti"))
