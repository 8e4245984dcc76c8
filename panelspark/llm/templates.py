"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names and units are replaced by typed placeholders, the rest
is lower-cased and stripped of outer punctuation. Windows of template tokens are hash-joined with
those of the benchmark, so an item is found again after its numbers or names were changed. The
replaced words are the slots: along one alignment of document and item a slot value of the item must
always have become the same value, else the windows that hold this value do not count.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Tidied, arrow_type, ship, stored, text_bytes, worker_state

_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_NUMBER_WORDS = frozenset(("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred "
                           "thousand million billion").split())
_UNITS = frozenset(("mm cm m km inch inches ft feet yard yards mile miles g kg mg lb lbs oz ton tons ml l litre litres liter liters "
                    "gallon gallons s sec seconds minute minutes hour hours day days week weeks month months year years "
                    "usd eur gbp dollar dollars euro euros cent cents pound pounds percent mph kmh km/h hz khz mhz ghz kb mb gb tb "
                    "w kw mw kwh v volt volts c f celsius fahrenheit degree degrees").split())
_EDGE = re.compile(r"^\W+|\W+$")
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_PLACE = {k: xxhash.xxh3_64_intdigest(name) for k, name in ((NUMBER, b"\0number"), (NAME, b"\0name"), (UNIT, b"\0unit"))}
BITS = 24


@dataclass(frozen=True)
class Rule:
    """A window has ``window`` template tokens (or the whole item, if it is shorter), ``literals`` of them
    literal at least (or all). A document holds an item if ``enough`` windows of it (or all, if it has
    fewer) stand in it along one alignment. Templates of an item without any such window say too
    little: its windows are compared word by word, with the values of their slots."""

    window: int = 8
    literals: int = 5
    enough: int = 4


def kind_of(bare: str, opens: bool) -> int:
    lower = bare.lower()
    if lower in _NUMBER_WORDS or not bare.isalpha() and _NUMBER.fullmatch(bare):
        return NUMBER
    if lower in _UNITS and len(bare) > 1:
        return UNIT
    if not opens and bare[:1].isupper() and len(bare) > 1:
        return NAME
    return LITERAL


class _Seen(dict):
    """Number of each word; a new word's properties go to the end of the columns."""

    def __init__(self):
        super().__init__()
        #: template hash and kind inside a sentence, the same at its start, value hash, ends a sentence, has a letter or digit
        self.columns: tuple[array, ...] = tuple(array(c) for c in "QbQbQbb")

    def __missing__(self, raw: bytes) -> int:
        word = raw.decode("utf-8", "replace")
        # most words are letters, perhaps with a full stop or comma: nothing else to strip
        bare = word if word.isalnum() else word[:-1] if word[-1] in ".," and word[:-1].isalnum() else _EDGE.sub("", word)
        value = xxhash.xxh3_64_intdigest(bare.lower().encode())
        opening = kind_of(bare, True)
        inside = kind_of(bare, False) if opening == LITERAL else opening
        for column, v in zip(self.columns, (_PLACE.get(inside, value), inside, _PLACE.get(opening, value), opening, value, word[-1] in ".!?", bool(bare))):
            column.append(v)
        found = self[raw] = len(self)
        return found


@dataclass(frozen=True)
class Tokens:
    """Per token of a text: template hash, kind, hash of the word, template hash and kind at a sentence's start."""

    code: np.ndarray
    kind: np.ndarray
    value: np.ndarray
    opening_code: np.ndarray
    opening: np.ndarray


class Canonical:
    """Template tokens of texts; what depends on the word alone is kept per worker."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.words = _Seen()

    def tokens(self, text: bytes) -> Tokens:
        """Words of punctuation alone are left out."""
        if len(self.words) > self.limit:
            self.words = _Seen()
        words = text.split()
        if not words:
            return Tokens(*(np.zeros(0, t) for t in (np.uint64, np.int8, np.uint64, np.uint64, np.int8)))
        at = np.fromiter(map(self.words.__getitem__, words), dtype=np.int64, count=len(words))
        code, kind, opening_code, opening, value, ends, real = (np.frombuffer(c, dtype=c.typecode)[at] for c in self.words.columns)
        opens = np.concatenate([[True], ends[:-1] > 0])
        real = real > 0
        return Tokens(np.where(opens, opening_code, code)[real], np.where(opens, opening, kind)[real], value[real],
                      opening_code[real], opening[real])


def _mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(columns[0]), salt, dtype=np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def window_hashes(t: Tokens, rule: Rule, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` tokens with enough literals, where they begin, and whether their
    first word is taken as one that opens a sentence. A negative width: all windows, by their words.

    An item's first word opens a sentence, the same word inside a document's sentence may be a name:
    such a place has a second window, with the word as it is at a sentence's start.
    """
    exact, width = width < 0, abs(width)
    n = len(t.code) - width + 1
    if n < 1 or width < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    salt = 2 * (rule.window - width) + exact
    if exact:
        return _mixed([t.value[k:k + n] for k in range(width)], salt), np.arange(n), np.zeros(n, bool)
    h = _mixed([t.code[k:k + n] for k in range(width)], salt)
    literal = np.concatenate([[0], np.cumsum(t.kind == LITERAL)])
    literals = literal[width:] - literal[:n]
    least = min(rule.literals, width)
    keep = np.flatnonzero(literals >= least)
    named = np.flatnonzero((t.kind[:n] == NAME) & (t.opening[:n] == LITERAL) & (literals + 1 >= least))
    if not len(named):
        return h[keep], keep, np.zeros(len(keep), bool)
    second = _mixed([t.opening_code[named], *(t.code[named + k] for k in range(1, width))], salt)
    return (np.concatenate([h[keep], second]), np.concatenate([keep, named]),
            np.concatenate([np.zeros(len(keep), bool), np.ones(len(named), bool)]))


def item_width(t: Tokens, rule: Rule) -> int:
    """The width of an item's windows; negative if they are compared by their words."""
    width = min(rule.window, len(t.code))
    return width if (~window_hashes(t, rule, width)[2]).any() else -width


def worker_canonical() -> Canonical:
    return worker_state("templates", Canonical)


def windows(rows: DataFrame, key: str, rule: Rule, bits: np.ndarray | None, widths: tuple[int, ...] = ()) -> DataFrame:
    """(key, row, windows, width, hash, place, slots): windows of every text. With ``bits``, those of ``widths``
    that may be in the benchmark; without, each text is an item and has the width its length asks for.
    ``row`` numbers the texts, as a key may be missing or repeated, and is fixed by storing the windows;
    ``windows`` is how many of its width the text has (with ``bits``, of those that may match).

    A window below ``rule.window`` is a whole item, so a document needs it only where it first stands.
    """
    kind_of_key = dict(rows.dtypes)[key]
    shared = ship(rows.sparkSession).sparkContext.broadcast(bits)
    key_type = arrow_type(rows, key)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm.templates import worker_canonical
        canonical, mask = worker_canonical(), shared.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                row += 1
                t = canonical.tokens(value.as_py())
                for width in widths if mask is not None else (item_width(t, rule),):
                    h, at, second = window_hashes(t, rule, width)
                    if mask is not None and len(h):
                        spot = (h >> np.uint64(64 - BITS)).astype(np.int64)
                        hit = (mask[spot >> 3] >> (spot & 7)) & 1 > 0
                        h, at, second = h[hit], at[hit], second[hit]
                    elif len(h):  # an item's first word opens it
                        h, at, second = h[~second], at[~second], second[~second]
                    n = len(h)
                    once: set | None = set() if abs(width) < rule.window else None
                    for x, p, o in zip(h.view(np.int64).tolist(), at.tolist(), second.tolist()):
                        slot = np.flatnonzero(t.kind[p + o:max(p + width, p)] != LITERAL) + o
                        slots = t.value[p + slot].view(np.int64).tolist()
                        if once is not None:
                            if (x, *slots) in once:
                                continue
                            once.add((x, *slots))
                        for column, v in zip(out, (k, row, n, width, x, p, slots)):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], key_type), *(pa.array(c, pa.int64()) for c in out[1:6]),
                                              pa.array(out[6], pa.list_(pa.int64()))],
                                             names=[key, "row", "windows", "width", "hash", "place", "slots"])

    return rows.select(key, text_bytes().alias("_text")).mapInArrow(
        Tidied(cut), f"`{key}` {kind_of_key}, row long, windows long, width long, hash long, place long, slots array<long>")


def consistent(matched: DataFrame, rule: Rule) -> DataFrame:
    """The alignments with enough windows, without those that hold a slot value of the item that became
    several: the same columns but the last two, n_windows, n_slots (values that became one), changed (any did)."""
    schema = matched.drop("item_windows", "w").schema.add("n_windows", "long").add("n_slots", "long").add("changed", "boolean")
    places = len(matched.columns) - 2

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, columns = [], [[], [], []]
            for i, (size, pairs) in enumerate(zip(batch.column(places).to_pylist(), batch.column(places + 1).to_pylist())):
                became: dict[int, int] = {}
                torn: set[int] = set()
                for w in pairs:
                    torn.update(x for x, y in zip(w["item_slots"], w["slots"]) if became.setdefault(x, y) != y)
                n = sum(torn.isdisjoint(w["item_slots"]) for w in pairs)
                if n >= min(rule.enough, size):
                    kept.append(i)
                    for column, v in zip(columns, (n, len(became) - len(torn), bool(torn) or any(x != y for x, y in became.items()))):
                        column.append(v)
            held = [batch.column(c).take(pa.array(kept, pa.int64())) for c in range(places)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())],
                                             names=schema.names)

    return matched.mapInArrow(judge, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", rule: Rule = Rule()) -> DataFrame:
    """(key, item, n_windows, n_slots, reparameterised): the documents that hold a benchmark item.

    One row per document and item, for the alignment with the most windows; ``n_slots`` is 0 where
    windows were compared word by word. Documents without words, items without words and missing
    texts match nothing. Each row is looked at by itself; of rows that share a key, or have none, the
    one with the most windows is stated. A bitmap of 2^24 bits over the benchmark's window hashes, of
    fixed size whatever the benchmark, keeps most windows from the shuffle; the hash join decides.
    """
    items = stored(windows(benchmark, item, rule, None), "benchmark-windows")
    words = items.selectExpr(f"shiftrightunsigned(hash, {64 - BITS}) AS spot").selectExpr("cast(spot div 32 as int) AS w",
                                                                                        "shiftleft(1L, cast(spot % 32 as int)) AS bit")
    bits = np.zeros(1 << (BITS - 5), dtype="<u4")
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # 2^19 rows at most
        bits[r["w"]] = r["bits"] & 0xFFFFFFFF
    widths = tuple(r["width"] for r in items.select("width").distinct().collect())  # 2 * rule.window at most
    found = stored(windows(docs, key, rule, bits.view(np.uint8), widths), "document-windows")
    held = items.select(F.col(item).alias("_item"), F.col("row").alias("item_row"), F.col("windows").alias("item_windows"), "hash",
                        F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    joined = found.drop("windows", "width").join(held, "hash")
    joined = joined.where(F.size("slots") == F.size("item_slots")).withColumn("shift", F.col("place") - F.col("item_place"))
    # an alignment has a row for each window of its item at most
    matched = joined.groupBy("row", "item_row", "shift").agg(
        F.first(key).alias(key), F.first("_item").alias(item), F.first("item_windows").alias("item_windows"),
        F.collect_list(F.struct("item_slots", "slots")).alias("w"))
    matched = matched.where(F.size("w") >= F.least(F.lit(rule.enough), F.col("item_windows")))
    fits = consistent(matched.select(key, item, "shift", "item_windows", "w"), rule)
    best = fits.groupBy(key, item).agg(F.max(F.struct("n_windows", (-F.abs("shift")).alias("near"), "n_slots", "changed")).alias("b"))
    return best.select(key, item, "b.n_windows", F.col("b.n_slots").alias("n_slots"), F.col("b.changed").alias("reparameterised"))
