"""Compression bands: zstandard ratios of whole documents and of fixed chunks.

Repetitive text compresses too well, random characters too badly. What is normal depends on
the length, as short texts give the compressor no history, so the limits are a table by size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from panelspark.llm.common import Tidied, ship, text_bytes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / raw bytes. ``limits``: (from so many bytes, least, most)."""

    limits: tuple = field(default=((0, 0.0, 9.0), (96, 0.28, 1.15), (192, 0.28, 0.98), (384, 0.27, 0.88), (768, 0.26, 0.80),
                                   (1536, 0.24, 0.74), (3072, 0.22, 0.70), (6144, 0.20, 0.68), (12288, 0.18, 0.66)))
    chunk_bytes: int = 2048
    chunk_least: float = 0.20
    chunk_most: float = 0.80
    chunk_share: float = 0.34
    level: int = 3

    def of(self, size: int) -> tuple[float, float]:
        return next(((low, high) for start, low, high in reversed(self.limits) if size >= start))


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by windows of ``width`` words that occur at least twice, exactly.

    Windows get exact codes by pairing numbers step by step: no hash, no collision.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    size, code = len(number), ids[:n]
    room = size
    for k in range(1, width):
        if room * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            room = int(code.max()) + 1
        code, room = code * size + ids[k:n + k], room * size
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[width:width + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.split()
    joined = b"".join(words)
    points = len(joined) - sum(np.bincount(np.frombuffer(joined, dtype=np.uint8) >> 6, minlength=4)[2:3].tolist()) if joined else 0
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else []
    return (len(words), points, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)),
            repeated_window_words(words))


def compression_verdict(text: bytes, press: zstandard.ZstdCompressor, bands: Bands) -> tuple[float, float, bool]:
    """(ratio, share of chunks outside their limits, kept). An empty text has ratio 0 and is not kept.

    The last chunk ends with the text and may overlap the one before. A text below one chunk has none:
    its whole ratio is held against the limits of its length.
    """
    if not text:
        return 0.0, 0.0, False
    ratio = len(press.compress(text)) / len(text)
    low, high = bands.of(len(text))
    off = n = 0
    if len(text) >= bands.chunk_bytes:
        last = len(text) - bands.chunk_bytes
        for at in (*range(0, last, bands.chunk_bytes), last):
            r = len(press.compress(text[at:at + bands.chunk_bytes])) / bands.chunk_bytes
            off += not bands.chunk_least <= r <= bands.chunk_most
            n += 1
    share = off / n if n else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.chunk_share


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, ratio double, chunk_share double")


def compression_bands(docs: DataFrame, key: str = "doc_id", bands: Bands = Bands()) -> DataFrame:
    """One row per input row: the key, the base counts and the verdict of the compression bands.

    A missing or empty text has no words: ``base_failed``, not kept. Repeated rows and rows
    without a key are judged like any other. Nothing is shuffled.
    """
    kind = dict(docs.dtypes)[key]
    ship(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text in batch.column(1):
                raw = text.as_py()
                n, chars, symbols, dup, rep = base_counts(raw)
                failed = n < 10 or 100 * rep > 20 * n
                ratio, share, fine = compression_verdict(raw, press, bands)
                for column, value in zip(out, (n, chars, symbols, dup, rep, failed, fine and not failed, ratio, share)):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))],
                                             names=[key, *names])

    return docs.select(key, text_bytes().alias("_text")).mapInArrow(Tidied(judge), f"`{key}` {kind}, {RESULT}")
