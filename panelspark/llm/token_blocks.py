"""Token ids in a compact file format: static range asymmetric numeral system (rANS).

One frequency table of the whole corpus serves every block. A block holds whole documents, is
coded by itself with ``LANES`` interleaved states, and carries its own checkpoints (all states and
the place in the words, every ``CHECKPOINT`` rows), so its stretches decode side by side, and a
checksum of its ids. Files are Parquet: any store that Spark writes to will do.

    <path>/table   symbol, frequency                 one row per id of the vocabulary
    <path>/blocks  part, block, doc_ids, lengths, n_tokens, rows, checksum, states, at, words
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_type, library_tokenizer, new_path, ship, slices, stored, text_bytes

LANES, CHECKPOINT, BLOCK_TOKENS = 512, 256, 1 << 18
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2^bits; every symbol has one at least, so any id can be written."""

    bits: int
    frequency: np.ndarray
    start: np.ndarray
    symbol: np.ndarray  # of each of the 2^bits slots

    @classmethod
    def of(cls, frequency: np.ndarray) -> Table:
        f = frequency.astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(f)]).astype(np.uint64)
        return cls(int(start[-1]).bit_length() - 1, f, start[:-1], np.repeat(np.arange(len(f), dtype=np.uint32), frequency))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Table:
        size = len(counts)
        room = 1 << max(12, size.bit_length() + 3)
        total = max(1, int(counts.sum()))
        f = 1 + np.array([int(c) * (room - size) // total for c in counts], dtype=np.int64)
        f[int(np.argmax(f))] += room - int(f.sum())
        return cls.of(f)


@dataclass(frozen=True)
class Block:
    n_tokens: int
    rows: int
    checksum: int
    states: bytes  # (checkpoints, LANES) 64-bit
    at: list[int]  # words before each checkpoint
    words: bytes  # 32-bit


def write_block(ids: np.ndarray, table: Table) -> Block:
    rows = -(-len(ids) // LANES)
    grid = np.zeros(rows * LANES, dtype=np.int64)
    grid[:len(ids)] = ids
    f, c = table.frequency[grid].reshape(rows, LANES), table.start[grid].reshape(rows, LANES)
    most = f << np.uint64(63 - table.bits)
    grow = np.uint64(1 << table.bits) - f  # (q << bits) + r + c is q * grow + x + c
    x = np.full(LANES, _LOW)
    words: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
    states = np.zeros((-(-rows // CHECKPOINT), LANES), dtype=np.uint64)
    for t in range(rows - 1, -1, -1):
        full = x >= most[t]
        words[t] = x[full].astype(np.uint32)
        x >>= full.astype(np.uint64) * _32
        x += x // f[t] * grow[t]
        x += c[t]
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT] = x
    before = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    return Block(len(ids), rows, zlib.crc32(ids.astype("<u4").tobytes()), states.astype("<u8").tobytes(),
                 before[:-1][::CHECKPOINT].tolist() if rows else [],
                 (np.concatenate(words) if rows else np.zeros(0, np.uint32)).astype("<u4").tobytes())


def read_block(block: Block, table: Table) -> np.ndarray:
    """The ids; all stretches between checkpoints are decoded side by side. A wrong checksum is an error."""
    x = np.frombuffer(block.states, dtype="<u8").astype(np.uint64).reshape(-1, LANES)
    words = np.frombuffer(block.words + b"\0\0\0\0", dtype="<u4").astype(np.uint64)
    at = np.array(block.at, dtype=np.int64)
    out = np.zeros((len(x), CHECKPOINT, LANES), dtype=np.uint32)
    mask, bits = np.uint64((1 << table.bits) - 1), np.uint64(table.bits)
    for t in range(min(CHECKPOINT, block.rows)):
        live = slice(0, len(x) if t < block.rows - (len(x) - 1) * CHECKPOINT else len(x) - 1)
        y = x[live]
        slot = y & mask
        symbol = table.symbol[slot]
        out[live, t] = symbol
        y = table.frequency[symbol] * (y >> bits) + slot - table.start[symbol]
        low = y < _LOW
        rank = np.cumsum(low, axis=1)
        place = np.where(low, at[live, None] + rank - 1, 0)
        x[live] = np.where(low, (y << _32) | words[place], y)
        at[live] += rank[:, -1]
    ids = out.reshape(-1)[:block.n_tokens]
    if zlib.crc32(ids.astype("<u4").tobytes()) != block.checksum:
        raise ValueError("a block's checksum differs from its ids")
    return ids


class LibraryEncoder:
    """Ids of a text by the tokenizers library; a chunk between two blanks is encoded once per worker.

    The byte-level pattern attaches one blank to the word behind it. If no chunk of a text is empty or begins or ends
    with white space, the text's ids are those of its chunks, each with the blank that leads it. New chunks
    are encoded thousands at a time as one text: of a chunk's tokens the first alone begins with the blank,
    so the ids tell where a chunk begins. Other texts, and those with one of the special strings, are encoded whole.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        self.tokenizer, self.special = library_tokenizer(path)
        from tokenizers.pre_tokenizers import ByteLevel
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.leads = np.zeros(size, dtype=bool)
        self.leads[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if t[:1] == "\u0120"]] = True
        pattern = self.tokenizer.pre_tokenizer
        self.joins = (self.tokenizer.normalizer is None and isinstance(pattern, ByteLevel) and pattern.use_regex
                      and not pattern.add_prefix_space and not any(" " in s for s in self.special))
        self.limit = limit
        self._forget()

    def _forget(self, kept: np.ndarray | None = None) -> None:
        """Drop all chunks but those of the numbers ``kept``."""
        keys = [] if kept is None or not len(kept) else [c for c, again in zip(self.number, self.again.tolist()) if again]
        held = [np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, dtype=bool)]
        if keys:
            held = [self._put_together(kept), self.size[kept], self.odd[kept]]
        #: number of a chunk; the first one of a text, which no blank leads, has a blank at its end here
        self.number: defaultdict[str, int] = defaultdict(count(len(keys)).__next__, zip(keys, range(len(keys))))
        self.flat, self.size, self.odd = held
        self.start, self.again = np.cumsum(self.size) - self.size, np.zeros(len(keys), dtype=bool)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each encoded by itself, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.kind, int(size.sum())), size

    def _led(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of chunks, each led by a blank."""
        if self.joins and chunks:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, dtype=self.kind)
            first = np.flatnonzero(self.leads[ids])
            if len(first) == len(chunks) and first[0] == 0:
                return ids, np.diff(first, append=len(ids))
        return self._alone([" " + c for c in chunks])

    def _learn(self) -> None:
        """Encode the chunks that have a number but no ids yet."""
        known = len(self.start)
        fresh = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        odd, led, alone = np.zeros(len(fresh), dtype=bool), [], []
        for i, c in enumerate(fresh):
            head = c[-1:] == " "
            if head:
                c = c[:-1]
            if not c or c[0].isspace() or c[-1].isspace() or any(s in c for s in self.special):
                odd[i] = True
            else:
                (alone if head else led).append((i, c))
        size, ids, order = np.zeros(len(fresh), np.int64), [self.flat], []
        for group, encode in ((led, self._led), (alone, self._alone)):
            for at in range(0, len(group), 4096):
                place, chunks = zip(*group[at:at + 4096])
                found, sizes = encode(list(chunks))
                ids.append(found)
                order.append(np.array(place))
                size[order[-1]] = sizes
        place = np.concatenate(order) if order else np.zeros(0, np.int64)
        start = np.zeros(len(fresh), np.int64)
        start[place] = len(self.flat) + np.cumsum(size[place]) - size[place]
        self.flat = np.concatenate(ids)
        self.start, self.size, self.odd = (np.concatenate(x) for x in ((self.start, start), (self.size, size), (self.odd, odd)))

    def _put_together(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.start[numbers] - end + size, size) + np.arange(end[-1])]

    def encode_many(self, texts: list[str], end: int) -> Iterator[bytes]:
        tail = np.array([end], dtype=self.kind).tobytes()
        if len(self.number) > self.limit:  # what came once seldom comes again; words in use stay
            kept = np.flatnonzero(self.again)
            self._forget(kept if 2 * len(kept) < self.limit else None)
        look, found, parts = self.number.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            chunks = text.split(" ")
            chunks[0] += " "
            found.append(np.fromiter(map(look, chunks), np.int64, len(chunks)))
            parts[i + 1] = parts[i] + len(chunks)
        if not texts:
            return
        numbers, known = np.concatenate(found), len(self.start)
        self._learn()
        self.again = np.concatenate([self.again, np.zeros(len(self.start) - known, dtype=bool)])
        self.again[numbers[numbers < known]] = True
        odd = np.logical_or.reduceat(self.odd[numbers], parts[:-1])
        to = np.concatenate([[0], np.cumsum(self.size[numbers])])[parts]
        ids = np.concatenate([self._put_together(numbers[at:at + (1 << 18)]) for at in range(0, len(numbers), 1 << 18)])
        for i, text in enumerate(texts):
            if text and (odd[i] or any(s in text for s in self.special)):
                yield self._alone([text])[0].tobytes() + tail
            else:
                yield ids[to[i]:to[i + 1]].tobytes() + tail


_WORKER: dict[str, LibraryEncoder] = {}


def worker_encoder(path: str) -> LibraryEncoder:
    if path not in _WORKER:
        _WORKER[path] = LibraryEncoder(path)
    return _WORKER[path]


def encoded(docs: DataFrame, tokenizer: str, key: str, end: int) -> DataFrame:
    """Key, n_tokens and the ids of each document (zstandard over packed integers), stored."""
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm.token_blocks import worker_encoder
        coder, press = worker_encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, run in slices(batch, 1):
                packed = list(coder.encode_many([t.decode("utf-8") for t in run], end))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(run)), pa.array([len(p) // coder.kind.itemsize for p in packed], pa.int64()),
                     pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array([press.compress(p) for p in packed], pa.binary())],
                    names=[key, "n_tokens", "tie", "ids"])

    return stored(docs.select(key, text_bytes().alias("_text")).mapInArrow(
        encode, f"`{key}` {kind}, n_tokens long, tie long, ids binary"), "token-ids")


def id_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus; one number per id of the vocabulary reaches the driver."""
    item = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, press = np.zeros(size, dtype=np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for _, run in slices(batch, 0):
                total += np.bincount(np.frombuffer(b"".join(map(press.decompress, run)), dtype=item), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in rows.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


BLOCK_COLUMNS = ("part int, block int, doc_ids array<{kind}>, lengths array<long>, n_tokens long, rows int, checksum long, "
                 "states binary, at array<long>, words binary")


def write_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", end: int = 0, part_tokens: int = 8_000_000) -> str:
    """Encode whole texts, append ``end`` to each, and write all ids in ascending key order; the path.

    Missing texts count as empty and have the end id alone. Repeated keys stand next to each other
    in the order of a checksum of their ids; a missing key comes first. A document is never cut: a
    very long one has a block of its own, and many stretches to decode side by side.
    """
    spark, kind = ship(docs.sparkSession), dict(docs.dtypes)[key]
    size = library_tokenizer(tokenizer)[0].get_vocab_size(with_added_tokens=True)
    item = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
    rows = encoded(docs, tokenizer, key, end)
    counts = id_counts(rows, size)
    table = Table.from_counts(counts)
    path = new_path(spark, "token-blocks")
    spark.createDataFrame(pa.table({"symbol": pa.array(np.arange(size, dtype=np.int32)),
                                    "frequency": pa.array(table.frequency.astype(np.int64))})).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(table.frequency.astype(np.int64))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = Table.of(shared.value), zstandard.ZstdDecompressor()
        part, number, held, keys, total = TaskContext.get().partitionId(), 0, [], [], 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(key_type)), ("lengths", pa.list_(pa.int64())),
                            ("n_tokens", pa.int64()), ("rows", pa.int32()), ("checksum", pa.int64()), ("states", pa.binary()),
                            ("at", pa.list_(pa.int64())), ("words", pa.binary())])

        def row() -> pa.RecordBatch:
            b = write_block(np.concatenate(held), coder)
            value = {"part": part, "block": number, "doc_ids": keys, "lengths": [len(h) for h in held], "n_tokens": b.n_tokens,
                     "rows": b.rows, "checksum": b.checksum, "states": b.states, "at": b.at, "words": b.words}
            return pa.RecordBatch.from_pylist([value], schema=schema)

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(press.decompress(value.as_py()), dtype=item)
                held.append(ids)
                keys.append(k)
                total += len(ids)
                if total >= BLOCK_TOKENS:
                    yield row()
                    number, held, keys, total = number + 1, [], [], 0
        if held:
            yield row()

    key_type = arrow_type(docs, key)
    parts = int(max(1, -(-int(counts.sum()) // part_tokens)))
    ordered = rows.select(key, "tie", "ids").repartitionByRange(parts, F.col(key).asc_nulls_first(), F.col("tie"))
    ordered = ordered.sortWithinPartitions(F.col(key).asc_nulls_first(), "tie").select(key, "ids")
    ordered.mapInArrow(write, BLOCK_COLUMNS.format(kind=kind)).write.parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint", keep_ids: bool = False) -> DataFrame:
    """Per document, from the files alone: key, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit integers), and the ids if asked for."""
    ship(spark)
    frequency = np.array([r["frequency"] for r in spark.read.parquet(f"{path}/table").orderBy("symbol").toLocalIterator()])
    shared = spark.sparkContext.broadcast(frequency)
    blocks = spark.read.schema(BLOCK_COLUMNS.format(kind=kind)).parquet(f"{path}/blocks")
    # parts hold a bounded number of tokens, so one row each is a small table; blocks are summed within a part
    before = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block")
    places = blocks.select("part", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("block_start"))
    schema = f"part int, block int, `{key}` {kind}, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = read_block(Block(r["n_tokens"], r["rows"], r["checksum"], r["states"], r["at"], r["words"]), table).astype("<u4")
                ends = np.cumsum(r["lengths"])
                cuts = list(zip((ends - r["lengths"]).tolist(), ends.tolist()))
                n = len(cuts)
                arrays = [pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()),
                          pa.array(r["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array([a for a, _ in cuts], pa.int64()),
                          pa.array([b - a for a, b in cuts], pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64())]
                if keep_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int64) for a, b in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "block", key, "offset", "n_tokens", "ids_crc32", "ids"][:len(arrays)])

    rows = blocks.mapInArrow(read, schema)
    start = F.col("part_start") + F.col("block_start") + F.col("offset")
    kept = [key, start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return rows.join(places, ["part", "block"]).join(before, "part").select(*kept)
