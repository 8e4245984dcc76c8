"""What the corpus operators share: input columns, stored stages, bounded samples, chunk memos."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that tasks import it and a
    worker keeps its tables and memos from task to task."""
    if spark.sparkContext.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="panelspark-"), "panelspark.zip")
        with zipfile.ZipFile(name, "w") as z:
            for folder, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(top)))
        spark.sparkContext.addPyFile(name)
        _SHIPPED.add(spark.sparkContext.applicationId)
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8, a missing text as none."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local master without one gets a scratch folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="panelspark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and return its rows; a lost executor costs one task, not the plan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; NULL ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(modulus: int, value: int) -> Column:
    """Rows kept from learning; a row without an id belongs to the training side."""
    return F.coalesce(remainder(modulus) == value, F.lit(False))


def bounded_sample(df: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """At most ``per_class`` rows of each class, in hash order of the key and, where there is one, the text.

    Rows that share a key, or have none, are drawn one by one by their texts; rows equal in both are one draw
    and give one row. The hash threshold of a class comes from its number of draws, so only about twice the
    wanted rows are ever sorted, whatever the size of the table, and no class is lost.
    """
    mark = F.xxhash64(*[F.col(c) for c in (key, *(["text"] if "text" in df.columns and key != "text" else []))])
    draw = (mark + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    counts = df.groupBy(label).agg(F.approx_count_distinct(mark).alias("_n"))
    share = F.lit(2.0 * per_class + 64) / F.col("_n")
    # one row per class, and the learner holds a machine per class anyway: bounded, and no shuffle by class
    near = df.join(F.broadcast(counts), label).where(draw < share).withColumn("_mark", mark).dropDuplicates([label, "_mark"])
    order = Window.partitionBy(label).orderBy("_mark", F.col(key))
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_class).drop("_r", "_n", "_mark")


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type of a column, of any type a key may have."""
    return to_arrow_type(df.schema[column].dataType)


class Tidied:
    """A function over batches that gives freed memory back to the system when a task ends.

    Workers live on from stage to stage; what allocators keep of an earlier stage would count against a later one.
    """

    def __init__(self, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
        self.function = function

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from self.function(batches)
        finally:
            release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


_STATE: dict[str, object] = {}


def worker_state(tag: str, make: Callable[[], object]) -> object:
    """This worker's table or memo of the name ``tag``; what a stage before left is given back first.

    A worker lives on from stage to stage, and memos of several operators at once do not fit beside an executor's heap.
    """
    if tag not in _STATE:
        if _STATE:
            _STATE.clear()
            release_memory()
        _STATE[tag] = make()
    return _STATE[tag]


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of a binary column of about ``limit`` bytes: (first row, values)."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    first = size = 0
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= limit:
            yield first, batch.column(column).slice(first, i + 1 - first).to_pylist()
            first, size = i + 1, 0
    if first < len(lengths):
        yield first, batch.column(column).slice(first).to_pylist()


def library_tokenizer(path: str) -> tuple[object, list[str]]:
    """The library's tokenizer of a file, without truncation or padding, and its special strings.

    Spark already gives every core a task: threads of the library's own would only fight for them, and
    for batches of single pre-tokens they cost more than the encoding.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class ChunkMemo:
    """Values of texts put together from those of their pre-tokens, each computed once per worker.

    For patterns that attach one blank to the word behind it, a text is the sum of the chunks
    between its blanks (each with its blank) if no chunk is empty or begins or ends with white
    space. ``cut`` gives a chunk's pre-tokens, ``many`` the values of new pre-tokens, ``join``
    the value of a sequence of values. A text that is not regular in this sense, or that has one
    of the ``special`` strings in it, goes to ``whole``. Pre-tokens are held in two halves of ``limit``; when the
    newer is full the older goes, and what is still in use has moved over.
    """

    def __init__(self, cut: Callable[[str], list[str]], many: Callable[[list[str]], list], join: Callable[[list], object],
                 whole: Callable[[str], object], special: list[str] | tuple[str, ...] = (), limit: int = 600_000):
        self.cut, self.many, self.join, self.whole, self.special, self.limit = cut, many, join, whole, special, limit
        self.pre: dict[str, object] = {}
        self.inner: dict[str, object] = {}
        self.first: dict[str, object] = {}
        self.before: dict[str, object] = {}

    def _parts(self, chunk: str, lead: str) -> list[str] | None:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return [lead + chunk[:-1], chunk[-1]]
        return self.cut(lead + chunk)

    def _fill(self, table: dict, new: Iterable[str], lead: str) -> None:
        words, parts = [], {}
        for c in new:
            if c.isalpha():
                words.append(c)
            else:
                parts[c] = self._parts(c, lead)
        whole = [lead + c for c in words]
        fresh = {p for x in parts.values() if x for p in x}
        fresh = fresh.union(whole).difference(self.pre)
        if back := fresh.intersection(self.before):
            self.pre.update((p, self.before[p]) for p in back)
            fresh -= back
        if fresh:
            order = list(fresh)
            self.pre.update(zip(order, self.many(order)))
        value = self.pre.__getitem__
        table.update(zip(words, map(value, whole)))
        for c, x in parts.items():
            table[c] = None if x is None else value(x[0]) if len(x) == 1 else self.join(list(map(value, x)))

    def values(self, texts: list[str]) -> Iterator[list]:
        """Per text the values to join."""
        if len(self.pre) > self.limit // 2:
            self.before, self.pre = self.pre, {}
        if len(self.inner) + len(self.first) > self.limit // 2:
            self.inner, self.first = {}, {}
        parts = [t.split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        self._fill(self.inner, seen.difference(self.inner), " ")
        self._fill(self.first, {p[0] for p in parts}.difference(self.first), "")
        for text, p in zip(texts, parts):
            if text == "":
                yield []
                continue
            if not any(s in text for s in self.special):
                head = self.first[p[0]]
                if head is not None:
                    found = list(map(self.inner.__getitem__, p[1:]))
                    if None not in found:
                        found.insert(0, head)
                        yield found
                        continue
            yield [self.whole(text)]
