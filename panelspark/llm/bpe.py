"""Byte-level BPE by rank files: a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash, displace, compare) resolves a pre-token
that is a token as a whole. Tier 2: the rest is merged with a heap of ranks over linked bytes.
Pre-tokens repeat, so each worker keeps the results of recent ones.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from panelspark.llm.common import ChunkMemo, Tidied, ship, slices, text_bytes, worker_state

_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _spot(h: int, d: int, n: int) -> int:
    x = ((h ^ (d * _MIX)) * 0xD6E8FEB86659FD93) & _MASK
    return ((x >> 32) * n) >> 32


@dataclass(frozen=True)
class PerfectHash:
    """Slot of every key, n slots for n keys. A lookup hashes once and compares one key."""

    shift: tuple[int, ...]  # per bucket: a displacement, or -1 - slot
    keys: tuple[bytes, ...]
    values: tuple[int, ...]

    @classmethod
    def build(cls, table: dict[bytes, int], per_bucket: int = 4) -> PerfectHash:
        n = len(table)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        many = max(1, n // per_bucket)
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % many, []).append((h, key))
        shift, keys = [0] * many, [None] * n
        free = np.ones(n, dtype=bool)
        for b, held in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(held) == 1:
                break
            h = np.array([x for x, _ in held], dtype=np.uint64)
            first, many_tries = 1, 64
            while True:
                with np.errstate(over="ignore"):
                    d = np.arange(first, first + many_tries, dtype=np.uint64) * np.uint64(_MIX)
                    x = (h[None, :] ^ d[:, None]) * np.uint64(0xD6E8FEB86659FD93)
                spots = (((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
                fits = np.flatnonzero(free[spots].all(axis=1))
                fits = next((f for f in fits.tolist() if len(set(spots[f].tolist())) == len(held)), None)
                if fits is not None:
                    break
                first, many_tries = first + many_tries, min(4096, 4 * many_tries)
            shift[b] = first + fits
            for (_, key), spot in zip(held, spots[fits]):
                keys[spot] = key
                free[spot] = False
        empty = iter(np.flatnonzero(free).tolist())
        for b, held in sorted(buckets.items()):
            if len(held) == 1:
                spot = next(empty)
                shift[b], keys[spot] = -1 - spot, held[0][1]
        return cls(tuple(shift), tuple(keys), tuple(table[k] for k in keys))

    def get(self, key: bytes) -> int | None:
        if not self.keys:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % len(self.shift)]
        spot = -1 - d if d < 0 else _spot(h, d, len(self.keys))
        return self.values[spot] if self.keys[spot] == key else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a piece: the pair of lowest rank, leftmost first, is joined until none is left.

    ``after[i]`` is where the part at i ends, 0 once it is swallowed. A heap entry packs (rank, i,
    end); it holds while the part at i is there and the part behind it ends at ``end``.
    """
    n, get = len(piece), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n))
    wide = n.bit_length() + 1
    low = (1 << wide) - 1
    heap = []
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            heap.append((r << wide | i) << wide | (i + 2))
    heapify(heap)
    while heap:
        entry = heappop(heap)
        end, i = entry & low, entry >> wide & low
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue
        after[i], after[j], before[end] = end, 0, i
        if end < n:
            stop = after[end]
            r = get(piece[i:stop])
            if r is not None:
                heappush(heap, (r << wide | i) << wide | stop)
        p = before[i]
        if p >= 0:
            r = get(piece[p:end])
            if r is not None:
                heappush(heap, (r << wide | p) << wide | end)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[piece[i:j]])
        i = j
    return out


class ByteBpe:
    """Encoder and decoder of one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, whole_tokens: PerfectHash | None = None):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.whole_tokens = whole_tokens or PerfectHash.build(ranks)
        self.tokens = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in ranks.values()}
        self.kind = np.dtype("<u2") if max(self.tokens, default=0) < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo = ChunkMemo(self.pattern.findall, lambda pre: [self._packed(self.piece(p)) for p in pre], b"".join,
                              lambda text: self._packed(self.encode(text)))

    def piece(self, pre_token: str) -> list[int]:
        raw = pre_token.encode("utf-8")
        one = self.whole_tokens.get(raw)
        return merge(raw, self.ranks) if one is None else [one]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.piece(p)]

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Per text its ids as packed integers."""
        return map(b"".join, self.memo.values(texts))

    def read(self, packed: bytes) -> Iterator[list[int]]:
        """The ids, a million at a time."""
        ids = np.frombuffer(packed, dtype=self.kind)
        return (ids[i:i + (1 << 20)].tolist() for i in range(0, len(ids), 1 << 20))

    def hashes(self, packed: bytes) -> tuple[str, str]:
        """sha256 of the ids as decimals joined by commas, and of the decoded bytes."""
        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
        for k, ids in enumerate(self.read(packed)):
            of_ids.update(("," * (k > 0) + ",".join(map(self.decimal.__getitem__, ids))).encode())
            of_text.update(b"".join(map(self.tokens.__getitem__, ids)))
        return of_ids.hexdigest(), of_text.hexdigest()

    def decode(self, packed: bytes) -> bytes:
        return b"".join(b"".join(map(self.tokens.__getitem__, ids)) for ids in self.read(packed))


def worker_bpe(tag: str, shared: Broadcast) -> ByteBpe:
    """This worker's encoder; ``tag`` names the vocabulary."""
    return worker_state(tag, lambda: ByteBpe(*shared.value))


def bpe_columns(docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", keep_ids: bool = False,
                ) -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256, and the packed ids if asked for.

    A missing text counts as empty: no ids, the hashes of nothing. The vocabulary and its perfect
    hash travel once per executor; their size is the rank file's, whatever the input. Nothing is
    shuffled; repeated rows give repeated results.
    """
    kind = dict(docs.dtypes)[key]
    shared = ship(docs.sparkSession).sparkContext.broadcast((ranks, pattern, PerfectHash.build(ranks)))
    tag = uuid.uuid4().hex  # names this vocabulary in the workers
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm.bpe import worker_bpe
        bpe = worker_bpe(tag, shared)
        width = bpe.kind.itemsize
        for batch in batches:
            count, ids_hash, text_hash, kept = [], [], [], []
            for _, run in slices(batch, 1):
                for packed in bpe.encode_many([t.decode("utf-8") for t in run]):
                    count.append(len(packed) // width)
                    of_ids, of_text = bpe.hashes(packed)
                    ids_hash.append(of_ids)
                    text_hash.append(of_text)
                    if keep_ids:
                        kept.append(packed)
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            if keep_ids:
                arrays.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][:len(arrays)])

    return docs.select(key, text_bytes().alias("_text")).mapInArrow(Tidied(encode), schema)
