"""N-gram Jaccard join: pigeonhole over a partitioned universe, exact.

Two sets of sizes s >= l with 100 |A n B| >= 80 |A u B| differ in at most (s + l) / 9 elements. The
universe of shingles is hashed into m segments, m set by the size band. If the larger set gives
its segments weights v (0 skip, 1 exact match, 2 match up to one element) that sum to more than that
bound, some segment of weight v differs in fewer than v elements: the pair meets there. Every set is
indexed in its own band by its segments and, in a subset of them, by the neighbourhoods with one
element deleted; it probes its own band and the one below. Weights go to the cheapest segments:
those with rare shingles first, 2 instead of a frequent one where deletions are indexed.

Segments hash to the sum of their elements' hashes, so a deletion is a subtraction.

Groups of copies never produce all pairs. Equal sets are one node. In a bucket every member meets the
eight least nodes; after their components are known, only members of different components
of a bucket are compared. Links inside a component change nothing. No text is fetched for a pair
whose sizes or parity sketches rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Tidied, arrow_type, ship, slices, stored, text_bytes
from panelspark.llm.components import components

WIDTH, LEADERS, HOT_BITS, HOT_SHARE, BLOCK = 5, 8, 20, 1 << 14, 4096
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S30)) * _B
    x = (x ^ (x >> _S27)) * _C
    return x ^ (x >> _S31)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - WIDTH + 1)
    code = h[:n].copy()
    for k in range(1, min(WIDTH, len(h))):
        code = mix(code) + h[k:k + n]
    return np.unique(mix(code + np.uint64(min(len(h), WIDTH))))


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


@dataclass(frozen=True)
class Band:
    number: int
    low: int
    high: int

    @property
    def segments(self) -> int:
        return self.high // 4 + 2 + -(-self.high // 32)

    @property
    def deletions(self) -> int:
        """The first so many segments are also indexed by their one-deletion neighbourhoods."""
        return min(self.segments, max(2, self.segments // 32))


@lru_cache
def band_of(size: int) -> Band:
    low, k = 4, 0
    while True:
        high = max(low, int(low * 1.4))
        if size <= high:
            return Band(k, low, high)
        low, k = high + 1, k + 1


@lru_cache
def band_below(size: int) -> Band | None:
    """The lower band that may hold a set similar to one of this size, if any."""
    band = band_of(size)
    least = -(-4 * size // 5)
    return band_of(band.low - 1) if band.low > 4 and least < band.low else None


def signature(s: np.ndarray, cost: np.ndarray, band: Band, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a set in a band and whether it probes them. ``cost``: of each shingle.

    In its own band a set is indexed under all keys; in the band below it has only its probes.
    """
    m, size = band.segments, len(s)
    spot = ((mix(s ^ _A) >> _S32) * np.uint64(m) >> _S32).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    spot, code = spot[order], mix(s[order] + _B)
    first = np.flatnonzero(np.concatenate([[True], spot[1:] != spot[:-1]]))
    total, price, count = np.zeros(m, np.uint64), np.full(m, 1 << 40, np.int64), np.bincount(spot, minlength=m)
    total[spot[first]] = np.add.reduceat(code, first)
    price[spot[first]] = np.minimum.reduceat(cost[order], first)
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band.number << 24) + _C)
    keys = mix(total ^ salt)
    # weights: sum above the greatest possible difference
    need = (size + min(size, band.high)) // 9 + 1
    ranked = np.lexsort((-count, price))
    free = int((price == 0).sum())
    probe, twice = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    probe[ranked[:min(need, free)]] = True
    short = need - min(need, free)
    if short:
        able = np.flatnonzero((np.arange(m) < band.deletions) & (price == 0))[:short]
        twice[able] = True
        short -= len(able)
        more = min(short, m - free)
        probe[ranked[free:free + more]] = True
        short -= more
        if short:  # nothing left to skip: 2 wherever deletions are indexed
            rest = np.flatnonzero((np.arange(m) < band.deletions) & ~twice)[:short]
            twice[rest] = True
    part = spot < band.deletions
    less = mix((total[spot[part]] - code[part]) ^ salt[spot[part]])
    lean = twice[spot[part]]
    if own:
        return np.concatenate([keys, less]), np.concatenate([probe | twice, lean])
    kept = np.concatenate([keys[probe | twice], less[lean]])
    return kept, np.ones(len(kept), dtype=bool)


def sketch(s: np.ndarray) -> bytes:
    """512 parities of hashed elements: two sets' sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((mix(s + _C) >> np.uint64(55)).astype(np.int64), minlength=512) & 1).tobytes()


def read_sets(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, n_shingles, node, sketch) of every row, and (bucket, n): frequent buckets of shingle hashes."""
    kind, key_type = dict(docs.dtypes)[key], arrow_type(docs, key)
    names = [key, "n_shingles", "node", "sketch", "bucket"]
    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(1 << HOT_BITS, dtype=np.int64), 0
        for batch in batches:
            sizes, nodes, bits = [], [], []
            for value in batch.column(1):
                s = shingles(value.as_py())
                sizes.append(len(s))
                nodes.append(set_id(s))
                bits.append(sketch(s) if len(s) else None)
                np.add.at(seen, (s & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64), 1)
                total += len(s)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                                              pa.array(bits, pa.binary()), none], names=names)
        # shares of the task's shingles, so at most 2 * HOT_SHARE rows whatever the task read
        hot = np.flatnonzero(seen >= max(2, total // (2 * HOT_SHARE)))
        hot = hot[np.argsort(-seen[hot], kind="stable")][:2 * HOT_SHARE]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), key_type), pa.array(seen[hot]), pa.nulls(len(hot), pa.int64()),
                                          pa.nulls(len(hot), pa.binary()), pa.array(hot)], names=names)

    rows = docs.select(key, text_bytes().alias("_text")).mapInArrow(
        Tidied(measure), f"`{key}` {kind}, n_shingles long, node long, sketch binary, bucket long")
    rows = stored(rows, "sets")
    return (rows.where("bucket is null").drop("bucket"),
            rows.where("bucket is not null").groupBy("bucket").agg(F.sum("n_shingles").alias("n")))


def hot_costs(hot: DataFrame, total: int) -> np.ndarray:
    """Cost by shingle bucket: its count where that is over 1 / HOT_SHARE of all, which can hold for
    HOT_SHARE buckets at most (and over 16, so that small corpora have none for chance)."""
    cost = np.zeros(1 << HOT_BITS, dtype=np.int64)
    for r in hot.where(F.col("n") > max(16, total // HOT_SHARE)).collect():
        cost[r["bucket"]] = r["n"]
    return cost


def bucket_rows(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """(key, node, probe) of every distinct set of at least four shingles; a task states an equal set once."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(cost)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            keys, nodes, probes, size = [], [], [], 0
            for value in batch.column(0):
                s = shingles(value.as_py())
                node = set_id(s)
                if len(s) < 4 or node in done:
                    continue
                done.add(node)
                price = shared.value[(s & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)]
                below = band_below(len(s))
                for band, own in ((band_of(len(s)), True), *(((below, False),) if below else ())):
                    k, p = signature(s, price, band, own)
                    keys.append(k)
                    probes.append(p)
                    nodes.append(np.full(len(k), node))
                    size += len(k)
                if size > 1 << 18:
                    yield rows(keys, nodes, probes)
                    keys, nodes, probes, size = [], [], [], 0
            if keys:
                yield rows(keys, nodes, probes)

    def rows(keys: list, nodes: list, probes: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)),
                                           pa.array(np.concatenate(probes))], names=["key", "node", "probe"])

    return docs.select(text_bytes().alias("_text")).mapInArrow(Tidied(sign), "key long, node long, probe boolean")


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[bool, bool, list[np.ndarray]]]:
    """Rows sorted by key as (the key goes on from the piece before, it may go on in the next, columns);
    single rows are left out.

    A key's rows come in pieces of a batch at most, so a frequent key needs no memory of its own.
    """
    last, held = None, None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(key):
            continue
        data = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.concatenate([first[1:], [len(key)]])
        goes_on = last is not None and key[0] == last
        if goes_on and held is not None:  # a single row waits for the next batch
            yield False, True, held
        several = (end - first > 1) | ((first == 0) & goes_on)
        for a, b in zip(first[several].tolist(), end[several].tolist()):
            yield goes_on and a == 0, b == len(key), [key[a:b], *(d[a:b] for d in data)]
        held = [x[-1:] for x in (key, *data)] if end[-1] - first[-1] == 1 and not (goes_on and len(first) == 1) else None
        last = key[-1]


def first_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of every bucket with its LEADERS least nodes, and the buckets (key, node,
    probe) that have more nodes than these pairs settle."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = []
        size = 0
        lead: list[tuple[int, bool]] = []
        is_open = False

        def emit(a, b, key=None, probe=None) -> None:
            nonlocal size
            n = len(a)
            out.append([np.asarray(a, np.int64), np.asarray(b, np.int64), np.zeros(n, np.int64) if key is None else key,
                        np.zeros(n, bool) if probe is None else probe, np.full(n, key is not None)])
            size += n

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            columns = [np.concatenate(c) for c in zip(*out)]
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "key", "probe", "open"])

        for goes_on, may_go_on, (key, node, probe) in _runs(batches, ["node", "probe"]):
            if not (goes_on or may_go_on or probe.any()):
                continue  # nobody looks for partners here
            if not goes_on:
                lead, is_open = [], False
            # one row per node: its rows stand together
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            node, probe = node[start], np.logical_or.reduceat(probe.astype(bool), start)
            if lead and node[0] == lead[-1][0] and len(lead) < LEADERS:
                node, probe = node[1:], probe[1:]
            at = 0
            while at < len(node) and len(lead) < LEADERS:
                n, p = int(node[at]), bool(probe[at])
                a = [m for m, q in lead if (p or q) and m != n]
                if a:
                    emit(a, [n] * len(a))
                lead.append((n, p))
                at += 1
            rest, flags = node[at:], probe[at:]
            if len(rest):
                for m, q in lead:
                    hit = rest[(flags | q) & (rest != m)]
                    if len(hit):
                        emit(np.full(len(hit), m), hit)
                if not is_open and (is_open := True):
                    names = np.array([m for m, _ in lead])
                    emit(names, names, np.full(len(names), key[0]), np.array([q for _, q in lead]))
                emit(rest, rest, np.full(len(rest), key[0]), flags)
            if size > 1 << 17:
                yield flush()
        if size:
            yield flush()

    sorted_rows = rows.repartition(F.col("key")).sortWithinPartitions("key", "node").select("key", "node", "probe")
    found = stored(sorted_rows.mapInArrow(Tidied(meet), "a long, b long, key long, probe boolean, open boolean"), "buckets")
    pairs = found.where("not open").select("a", "b").distinct()
    return pairs, found.where("open").select("key", F.col("a").alias("node"), "probe")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(place, asks, node, component, n, sketch) of ``rows`` with their bucket's size: each row stands in one
    block of about ``block`` rows of its bucket, and a row that probes also asks in every block."""
    columns = ["node", "component", "n", "sketch"]
    blocks = F.expr(f"(size + {block} - 1) div {block}")
    held = rows.select("key", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.lit(False).alias("asks"), *columns)
    asking = rows.where("probe").select("key", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("asks"), *columns)
    # two blocks of one hash only compare more
    return held.unionByName(asking).select(F.xxhash64("key", "block").alias("place"), "asks", *columns)


def second_pairs(open_rows: DataFrame, parts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of one bucket that are in different components: all whose sizes and sketches allow a link.

    A task holds one block of a bucket while the bucket's probing rows pass by; rows that do not probe
    are not compared with each other.
    """
    rows = open_rows.join(parts, "node", "left").select("key", "node", "probe", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("probe").alias("p"),
                                    F.count(F.lit(1)).alias("size")).where("x <> y and p").select("key", "size")
    rows = rows.join(mixed, "key").join(sketches.select("node", "n", "sketch"), "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for goes_on, _, (_, asks, node, part, n, bits) in _runs(batches, ["asks", "node", "component", "n", "sketch"]):
            if not goes_on:
                held = []
            asks, bits = asks.astype(bool), np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(-1, 8)
            stands = int(np.count_nonzero(~asks))  # these come first
            if stands:
                held.append((node[:stands], part[:stands], n[:stands], bits[:stands]))
            if stands == len(node) or not held:
                continue
            if len(held) > 1:
                held = [tuple(np.concatenate(c) for c in zip(*held))]
            o, c, m, b = held[0]
            found: list[np.ndarray] = []
            for i in range(stands, len(node)):
                near = np.flatnonzero((c != part[i]) & (100 * np.minimum(m, n[i]) >= 80 * np.maximum(m, n[i])))
                if len(near):
                    apart = np.bitwise_count(b[near] ^ bits[i]).sum(axis=1, dtype=np.int64)
                    near = near[9 * apart <= m[near] + n[i]]
                    found.append(np.stack([np.minimum(o[near], node[i]), np.maximum(o[near], node[i])]))
            if found:
                both = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    placed = in_blocks(rows, BLOCK).repartition(F.col("place")).sortWithinPartitions("place", "asks", "node")
    return placed.select("place", "asks", "node", "component", "n", "sketch").mapInArrow(Tidied(meet), "a long, b long").where("a <> b").distinct()


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    left, right = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(-1, 8) for i in (4, 5))
            apart = np.bitwise_count(s ^ t).sum(axis=1, dtype=np.int64)
            good = pa.array((100 * np.minimum(m, n) >= 80 * np.maximum(m, n)) & (9 * apart <= m + n))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    return rows.mapInArrow(Tidied(near), "a long, b long")


def texts_of(docs: DataFrame, key: str, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, packed text) of the given nodes, one document each.

    A bitmap over hashed ids, 16 bits an id up to 32 MB, drops most other documents before their
    texts are shuffled; what it lets through the join removes.
    """
    spark = ship(docs.sparkSession)
    chosen = stored(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(key).alias(key)), "chosen")
    width = min(1 << 28, max(1 << 22, 1 << (16 * chosen.count()).bit_length()))
    spot = F.pmod(F.xxhash64(F.col(key)), F.lit(width))
    word = chosen.select(spot.alias("spot")).selectExpr("cast(spot div 32 as int) AS w", "shiftleft(1L, cast(spot % 32 as int)) AS bit")
    bits = np.zeros(width // 32, dtype=np.uint32)
    for r in word.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["w"]] = r["bits"]
    shared, kind = spark.sparkContext.broadcast(bits), dict(docs.dtypes)[key]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            place = batch.column(2).to_numpy()
            hit = np.flatnonzero(shared.value[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1))
            found = pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(hit)) for i in (0, 1)], names=[key, "text"])
            for first, texts in slices(found, 1):
                yield pa.RecordBatch.from_arrays(
                    [found.column(0).slice(first, len(texts)), pa.array((set_id(shingles(t)) for t in texts), pa.int64()),
                     pa.array(map(press.compress, texts), pa.binary())], names=[key, "node", "packed"])

    rows = docs.where(F.col(key).isNotNull()).select(key, text_bytes().alias("_text"), spot.alias("_spot"))
    rows = rows.mapInArrow(Tidied(pick), f"`{key}` {kind}, node long, packed binary").dropDuplicates([key, "node"])
    return stored(rows.join(chosen, [key, "node"]).select("node", "packed"), "texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets link. Each pair carries one text; the other stands before the pairs of its node.

    A node with very many pairs is cut into stretches of about 256 pairs, each behind its own copy of the text.
    """
    many = pairs.groupBy("a").agg(F.expr("(count(1) + 255) div 256").alias("cuts")).where("cuts > 1")
    salted = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("cuts", F.lit(1))).alias("salt"))
    right = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "packed")
    left = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a")
    rows = right.unionByName(left.select("a", "salt", F.lit(None).cast("long").alias("b"), "packed"))
    rows = rows.repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, mine = zstandard.ZstdDecompressor(), np.zeros(0, np.uint64)
        for batch in batches:
            good: list[tuple[int, int]] = []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(opener.decompress(packed.as_py()))
                if b is None:
                    mine = s
                    continue
                if 100 * min(len(s), len(mine)) >= 80 * max(len(s), len(mine)):
                    both = int(np.isin(s, mine, assume_unique=True, kind="sort").sum())
                    if 100 * both >= 80 * (len(s) + len(mine) - both):
                        good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in good], pa.int64()), pa.array([g[1] for g in good], pa.int64())], names=["a", "b"])

    return stored(rows.select("a", "b", "packed").mapInArrow(Tidied(compare), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per input row: key, n_shingles, component_id (the least key reachable by links).

    Sets are equal or linked by their shingles alone; repeated rows and equal sets share a component.
    A text without words has no shingles and is linked with nothing, itself alone. A row without a key
    keeps its count and has no component. Similarity is compared on 64-bit hashes of shingles.
    """
    rows, hot = read_sets(docs, key)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = bucket_rows(docs.where(F.col(key).isNotNull()), hot_costs(hot, total))
    pairs, open_rows = first_pairs(buckets)
    keyed = rows.where(F.col(key).isNotNull())
    sketches = stored(keyed.where("n_shingles > 3").dropDuplicates(["node"]).select("node", F.col("n_shingles").alias("n"), "sketch"), "sketches")

    def linked(found: DataFrame) -> DataFrame:
        found = stored(found, "pairs")
        nodes = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
        return verified(found, texts_of(docs, key, keyed, nodes))

    parts = components(linked(possible(pairs, sketches)))
    more = linked(second_pairs(open_rows, parts, sketches))
    parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = rows.where("n_shingles > 0").groupBy("node").agg(F.min(key).alias("least"))
    placed = named.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    # only sets in a component of several need a second look-up
    final = placed.join(lowest, "component").select("node", "component_id")
    out = rows.join(final, "node", "left")
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") == 0, F.col(key)).when(F.col(key).isNotNull(), F.col("component_id"))
                      .alias("component_id"))
