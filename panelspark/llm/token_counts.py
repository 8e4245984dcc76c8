"""Token counts without token ids.

A block of documents becomes a table of pre-token frequencies, one row per document and distinct
pre-token. The pieces of a pre-token are counted once, joined to the frequencies by the pre-token's
number, and summed per document. The join runs inside the block: shuffling the pairs (pre-token,
document) would move several times the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import library_tokenizer, ship, slices, text_bytes

#: a blank between two words always begins a pre-token; other white space may join its neighbours
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
LIMIT = 1_200_000


class PieceCounts:
    """Numbers of pre-tokens and their pieces by the library's own encoder, kept for the worker's next blocks."""

    def __init__(self, path: str):
        self.tokenizer, self.special = library_tokenizer(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pieces = np.zeros(0, np.int64)
        #: pre-token numbers of a segment, with the blank that leads it
        self.segments: dict[str, tuple[int, ...]] = {}

    def _learn(self, segments: Iterable[str]) -> None:
        """Cut new segments into pre-tokens, and count the pieces of pre-tokens that are new."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        number = self.number
        for s in segments:
            word = s[1:] if s[:1] == " " else s
            if word.isalpha():
                parts = [s]
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                parts = [s[:-1], s[-1]]
            else:
                parts = [s[a:b] for _, (a, b) in cut(s)]
            self.segments[s] = tuple([number.setdefault(p, len(number)) for p in parts])
        fresh = list(number)[len(self.pieces):]
        found = [len(e) for at in range(0, len(fresh), 4096) for e in self.tokenizer.encode_batch_fast(fresh[at:at + 4096], add_special_tokens=False)]
        self.pieces = np.concatenate([self.pieces, np.array(found, np.int64)])

    @staticmethod
    def _segments(text: str) -> list[str]:
        first, *others = SAFE_BLANK.split(text)
        return [first, *(" " + s for s in others)] if text else []

    def frequencies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pre-token number, times), one row per pair that occurs."""
        cut = list(map(self._segments, texts))
        self._learn(set().union(*cut).difference(self.segments))
        found = [list(chain.from_iterable(map(self.segments.__getitem__, c))) for c in cut]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        width = max(1, len(self.number))
        pair, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * width + flat, return_counts=True)
        return pair // width, pair % width, times

    def block(self, texts: list[str]) -> list[int]:
        """Tokens of each text. One of the library's special strings in a text leaves that text to the library."""
        if len(self.segments) > LIMIT:
            self.forget()
        special = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        rest = list(texts)
        for i in special:
            rest[i] = ""
        doc, pre, times = self.frequencies(rest)
        out = np.bincount(doc, weights=times * self.pieces[pre], minlength=len(texts)).astype(np.int64).tolist()
        for i in special:
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False))
        return out


_WORKER: dict[str, PieceCounts] = {}


def worker_counts(path: str) -> PieceCounts:
    if path not in _WORKER:
        _WORKER[path] = PieceCounts(path)
    return _WORKER[path]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Missing and empty texts have no tokens. Special strings inside a text count as the library
    counts them. Nothing is shuffled; a long text is one block of its own.
    """
    kind = dict(docs.dtypes)[key]
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm.token_counts import worker_counts
        counts = worker_counts(path)
        for batch in batches:
            sizes, tokens = [], []
            for _, run in slices(batch, 1):
                sizes += map(len, run)
                tokens += counts.block([t.decode("utf-8") for t in run])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=[key, "n_bytes", "n_tokens"])

    rows = docs.select(key, text_bytes().alias("_text")).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
