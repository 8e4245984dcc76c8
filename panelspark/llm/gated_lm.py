"""A gated recurrent language model with a class-factored output, in numpy inside Spark tasks.

Words with the highest counts are the model's own; they are dealt to classes by frequency. All
other words are in tail classes by their shape, and inside a tail class a word has its smoothed
corpus share: P(word) = P(class | state) * P(word | class[, state]). One unit (gated, ``HIDDEN`` wide)
reads the words; a document starts from the zero state and keeps its state to its end, window after
window. Training is truncated backpropagation over windows, one pass over all training documents in
``rounds`` parts by a hash of the row: in each round every lane of documents trains from the shared weights,
and the weights are averaged by the lanes' tokens. Lanes and their order come from hashes too, not from the
layout of the input. Texts are read twice, for the counts and for their numbers; training and scoring read
the stored numbers, two bytes a token.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_type, ship, slices, stored, text_bytes

HEAD, CLASS_SIZE, TAILS, HIDDEN, WINDOW, STREAMS = 1024, 64, 16, 12, 20, 512
END = b"\n"  # no word has white space in it
SLICES = 16  # of the weights, when lanes are summed
HEAVY = 1 << 20  # a word with over 1 / HEAVY of all tokens is heavy; there are fewer than HEAVY


def tail_class(word: bytes) -> int:
    """Shape of a word: letters outside ASCII, punctuation at its end, length."""
    return 8 * (not word.isascii()) + 4 * (word[-1:] in b".,;:!?") + min(3, len(word) // 4)


def word_counts(docs: DataFrame, trains: str = "train") -> DataFrame:
    """(word, n): tokens of the training rows, every end included; partial counts are made in the tasks."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                words = value.as_py().lower().split()
                seen.update(words)
                seen[END] += 1
                if len(seen) > 300_000:
                    yield rows(seen)
                    seen = Counter()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    part = docs.where(trains).select(text_bytes().alias("_text")).mapInArrow(count, "word binary, n long")
    return stored(part.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass(frozen=True)
class Lexicon:
    """Heavy words with their counts, the model's words first; and what the tail classes hold."""

    words: tuple[bytes, ...]
    counts: np.ndarray
    tokens: int
    distinct: int
    tail_tokens: np.ndarray  # per tail class
    tail_distinct: np.ndarray

    @property
    def head(self) -> int:
        return min(HEAD, len(self.words))

    @property
    def classes(self) -> int:
        return -(-HEAD // CLASS_SIZE) + TAILS


def lexicon(counts: DataFrame) -> Lexicon:
    """From the counts table; fewer than HEAVY words and 16 sums come to the driver."""
    total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    found = counts.where(F.col("n") * HEAVY > tokens).toArrow()
    heavy = sorted(zip(found["word"].to_pylist(), found["n"].to_pylist()), key=lambda x: (-x[1], x[0]))
    tail_tokens, tail_distinct = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    size = F.octet_length("word")
    last = F.substring(F.col("word"), -1, 1)
    plain = F.col("word").cast("string").rlike(r"^\p{ASCII}*$")
    shape = (F.when(plain, 0).otherwise(8) + F.when(last.isin(*(F.lit(bytes([c])) for c in b".,;:!?")), 4).otherwise(0)
             + F.least(F.lit(3), F.floor(size / 4)))
    for r in counts.groupBy(shape.cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect():
        tail_tokens[r["c"]], tail_distinct[r["c"]] = r["n"], r["d"]
    for w, n in heavy[:HEAD]:
        tail_tokens[tail_class(w)] -= n
        tail_distinct[tail_class(w)] -= 1
    return Lexicon(tuple(w for w, _ in heavy), np.array([n for _, n in heavy], dtype=np.int64), tokens, distinct, tail_tokens, tail_distinct)


def sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1.0
    np.reciprocal(x, out=x)


def thirds(x: np.ndarray) -> list[np.ndarray]:
    """The columns of the update gate, the reset gate and the candidate, each contiguous."""
    return [np.ascontiguousarray(x[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3)]


def softmax_parts(logits: np.ndarray, chosen: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each row's chosen column, and the row sums; the logits become their exponentials."""
    if not small and len(logits):
        logits -= logits.max(1, keepdims=True)
    value = logits[np.arange(len(logits)), chosen]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], np.float32)
    return value - np.log(total), total


@dataclass
class Weights:
    """All weights as one vector of float32, with named views."""

    flat: np.ndarray
    classes: int

    def __post_init__(self):
        h, v, c = HIDDEN, HEAD + TAILS, self.classes
        self.shapes = {"x": (v, 3 * h), "u": (h, 3 * h), "c": (h, c), "cb": (c,), "w": (HEAD // CLASS_SIZE, h, CLASS_SIZE),
                       "wb": (HEAD // CLASS_SIZE, CLASS_SIZE)}
        at = 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + size].reshape(shape))
            at += size

    @classmethod
    def start(cls, lex: Lexicon) -> Weights:
        c = lex.classes
        size = (HEAD + TAILS) * 3 * HIDDEN + 3 * HIDDEN * HIDDEN + HIDDEN * c + c + HEAD * HIDDEN + HEAD
        out = cls((np.random.default_rng(11).standard_normal(size) * 0.08).astype(np.float32), c)
        head = np.zeros(HEAD)
        head[:lex.head] = lex.counts[:lex.head]
        by = np.concatenate([head.reshape(-1, CLASS_SIZE).sum(1), lex.tail_tokens])
        out.cb[:] = np.log((by + 1.0) / (by.sum() + c))
        out.wb[:] = np.log((head + 1e-3)).reshape(-1, CLASS_SIZE)
        return out


class Network:
    def __init__(self, weights: Weights):
        self.w = weights

    def window(self, ids: np.ndarray, target: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Run (steps, streams) of input ids; natural log probability of each target's class and, for the
        model's words, of the word in it; the last state; what backpropagation needs."""
        w, (steps, n) = self.w, ids.shape
        hs = np.empty((steps + 1, n, HIDDEN), np.float32)
        hs[0] = state
        # each gate has an array of its own, so that a step works on contiguous memory; it starts as the input's part
        gates = [np.take(x, ids, axis=0) for x in thirds(w.x)]
        uz, ur, un = thirds(w.u)
        for t in range(steps):
            h, (z, r, c) = hs[t], (g[t] for g in gates)
            z += h @ uz
            sigmoid(z)
            r += h @ ur
            sigmoid(r)
            c += (r * h) @ un
            np.tanh(c, out=c)
            hs[t + 1] = h + z * (c - h)
        out, goal = hs[1:].reshape(-1, HIDDEN), target.reshape(-1)
        kind = np.where(goal < HEAD, goal // CLASS_SIZE, HEAD // CLASS_SIZE + goal - HEAD)
        share = out @ w.c + w.cb
        value, total = softmax_parts(share, np.maximum(kind, 0), self._small(w.c, w.cb))
        inner = np.flatnonzero((goal >= 0) & (goal < HEAD))
        inner = inner[np.argsort(kind[inner].astype(np.int16), kind="stable")]
        words = self._inside(out[inner], kind[inner])
        gain, inner_total = softmax_parts(words, goal[inner] % CLASS_SIZE, self._small(w.w.transpose(1, 0, 2), w.wb))
        value[inner] += gain
        return value.reshape(steps, n), hs[-1], (ids, hs, gates, kind, goal, share, total, inner, words, inner_total)

    @staticmethod
    def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
        """Whether no logit can leave the range of exp in float32, as a state's entries are within one."""
        return float((np.abs(weights).sum(0) + np.abs(bias)).max()) < 60.0

    def _inside(self, out: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Logits inside the class; rows are sorted by class."""
        words = np.empty((len(out), CLASS_SIZE), np.float32)
        edge = np.searchsorted(kind, np.arange(HEAD // CLASS_SIZE + 1))
        for c in np.flatnonzero(np.diff(edge)):
            words[edge[c]:edge[c + 1]] = out[edge[c]:edge[c + 1]] @ self.w.w[c] + self.w.wb[c]
        return words

    def gradient(self, kept: tuple) -> np.ndarray:
        """Gradient of the window's mean negative log probability; positions without a target (-1) count nothing."""
        ids, hs, gates, kind, goal, share, total, inner, words, inner_total = kept
        w, (steps, n) = self.w, ids.shape
        g = Weights(np.zeros_like(w.flat), w.classes)
        out, live = hs[1:].reshape(-1, HIDDEN), goal >= 0
        share *= (live / total)[:, None].astype(np.float32)
        share[np.flatnonzero(live), kind[live]] -= 1.0
        g.c[:] = out.T @ share
        g.cb[:] = np.ones(len(share), np.float32) @ share
        back = share @ w.c.T
        words *= (1.0 / inner_total)[:, None]
        words[np.arange(len(inner)), goal[inner] % CLASS_SIZE] -= 1.0
        edge = np.searchsorted(kind[inner], np.arange(HEAD // CLASS_SIZE + 1))
        for c in np.flatnonzero(np.diff(edge)):
            rows = inner[edge[c]:edge[c + 1]]
            part = words[edge[c]:edge[c + 1]]
            g.w[c] = out[rows].T @ part
            g.wb[c] = part.sum(0)
            back[rows] += part @ w.w[c].T
        back = back.reshape(steps, n, HIDDEN)
        into = [np.empty((steps, n, HIDDEN), np.float32) for _ in range(3)]
        carry = np.zeros((n, HIDDEN), np.float32)
        uz, ur, un = (np.ascontiguousarray(u.T) for u in thirds(w.u))
        for t in range(steps - 1, -1, -1):
            h, (z, r, c), (dz, dr, dc) = hs[t], (x[t] for x in gates), (x[t] for x in into)
            d = back[t] + carry
            np.multiply(d * z, 1 - c * c, out=dc)
            rh = dc @ un
            past = 1 - z
            np.multiply(d * (c - h), z * past, out=dz)
            rh *= r
            np.multiply(rh * h, 1 - r, out=dr)
            carry = d * past + rh + dz @ uz + dr @ ur
        before = hs[:-1].reshape(-1, HIDDEN)
        read = (before, before, gates[1].reshape(-1, HIDDEN) * before)
        order = np.argsort(ids.reshape(-1).astype(np.int16), kind="stable")
        seen = ids.reshape(-1)[order]
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        for k, part in enumerate(x.reshape(-1, HIDDEN) for x in into):
            at = slice(k * HIDDEN, (k + 1) * HIDDEN)
            g.u[:, at] = read[k].T @ part
            g.x[seen[first], at] = np.add.reduceat(np.take(part, order, axis=0), first, axis=0)
        g.flat /= max(1, int(live.sum()))
        return g.flat


class _Numbers(dict):
    """Numbers of words seen so far; a new word is looked up once."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.known.get(word, -1 - tail_class(word))
        return found


class Reader:
    """Model ids of words, and what the lexicon alone says of them."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        self.number = {w: i for i, w in enumerate(lex.words)}
        self.memo = _Numbers(self.number)
        late = [HEAD + tail_class(w) for w in lex.words[lex.head:]]
        #: model id by number; -1 - class of another word counts from the end
        self.model = np.array([*range(lex.head), *late, *range(HEAD + TAILS - 1, HEAD - 1, -1)], dtype=np.int16)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Number of a heavy word; -1 - class of another."""
        if len(self.memo) > 400_000:
            self.memo = _Numbers(self.number)
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))

    def model_ids(self, ids: np.ndarray) -> np.ndarray:
        """Below HEAD: the model's words; from HEAD: tail classes."""
        return self.model[ids]


def in_streams(texts: list[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in at most STREAMS lanes, a window at a time: (lanes, their documents, whether a document
    begins, inputs, targets). Each document goes on in one lane, the next begins at a window's edge; longest
    first to the emptiest lane. A document's input begins with the end word, and its last target is the end."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    height = [-(-len(texts[i]) // WINDOW) for i in order]
    width = min(STREAMS, -(-sum(height) // max(height)))
    heap, place = [(0, lane) for lane in range(width)], []
    for h in height:
        used, lane = heap[0]
        place.append((used, lane))
        heapq.heapreplace(heap, (used + h, lane))
    rows = max(used for used, _ in heap)
    goal = np.full((rows * WINDOW, width), -1, np.int16)
    ids = np.zeros((rows * WINDOW, width), np.int16)
    owner, fresh = np.full((rows, width), -1, np.int64), np.zeros((rows, width), bool)
    for i, h, (used, lane) in zip(order, height, place):
        at, text = used * WINDOW, texts[i]
        goal[at:at + len(text), lane] = text
        ids[at, lane] = end
        ids[at + 1:at + len(text), lane] = text[:-1]
        owner[used:used + h, lane] = i
        fresh[used, lane] = True
    for t in range(rows):
        lanes, steps = np.flatnonzero(owner[t] >= 0), slice(t * WINDOW, (t + 1) * WINDOW)
        yield lanes, owner[t, lanes], fresh[t, lanes], ids[steps, lanes], goal[steps, lanes]


def _run(net: Network, texts: list[np.ndarray], end: int):
    """All windows of a set of documents: (documents, log probabilities, targets, kept), state carried along."""
    state = np.zeros((STREAMS, HIDDEN), np.float32)
    for lanes, group, fresh, ids, goal in in_streams(texts, end):
        state[lanes[fresh]] = 0.0
        value, state[lanes], kept = net.window(ids, goal, state[lanes])
        yield group, value, goal, kept


_WORKER: dict[str, Reader] = {}


def worker_reader(tag: str, shared: Broadcast) -> Reader:
    if tag not in _WORKER:
        _WORKER.clear()
        _WORKER[tag] = Reader(shared.value)
    return _WORKER[tag]


ROW_COLUMNS = ("`{key}` {kind}, train boolean, n_tokens long, n_known long, base_score double, rest double, "
               "block long, light binary, times binary, words binary, ids binary")


def word_hash(word: bytes) -> int:
    """What ``F.xxhash64`` gives for the word, unsigned."""
    return xxhash.xxh64_intdigest(word, 42)


def numbered(docs: DataFrame, shared: Broadcast, tag: str, key: str, block_bytes: int = 1 << 24) -> DataFrame:
    """Per row, stored: the model ids of its tokens, and what the lexicon alone gives as sums over heavy words.

    Rows stand in blocks of about ``block_bytes`` of text. The distinct other words of a block are its dictionary,
    sorted hashes in ``words`` of its first row; a row has its words' places in it (``light``) and how often each
    occurs (``times``). ``rest`` is what a model's class leaves open: a tail word's share of its class, in log10."""
    kind, key_type = dict(docs.dtypes)[key], arrow_type(docs, key)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm import gated_lm as lm
        reader = lm.worker_reader(tag, shared)
        lex = reader.lex
        base = np.log10((lex.counts + 1.0) / (lex.tokens + lex.distinct + 1.0)) if len(lex.words) else np.zeros(0)
        room = np.log10(lex.tail_tokens + lex.tail_distinct + 1.0)
        #: by number, the classes of other words from the end
        rest = np.concatenate([np.zeros(lex.head), np.log10(lex.counts[lex.head:] + 1.0), np.zeros(lm.TAILS)])
        late = np.flatnonzero(reader.model >= lm.HEAD)
        rest[late] -= room[reader.model[late] - lm.HEAD]
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, texts in slices(batch, 2, block_bytes):
                count, known, base_sum, rest_sum, packed, rows = [], [], [], [], [], []
                place: dict[bytes, int] = {}
                for value in texts:
                    words = [*value.lower().split(), lm.END]
                    n = reader.ids(words)
                    light = Counter(words[i] for i in np.flatnonzero(n < 0).tolist())
                    heavy = n[n >= 0]
                    count.append(len(n))
                    known.append(len(heavy))
                    base_sum.append(float(base[heavy].sum()))
                    rest_sum.append(float(rest[n].sum()))
                    rows.append((np.array([place.setdefault(w, len(place)) for w in light], np.int64), np.array(list(light.values()), "<u4")))
                    packed.append(reader.model_ids(n).astype("<i2").tobytes())
                hashes, where = np.unique(np.fromiter(map(lm.word_hash, place), np.uint64, len(place)), return_inverse=True)
                own = [batch.column(i).slice(first, len(texts)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [own[0].cast(key_type), own[1], pa.array(count, pa.int64()), pa.array(known, pa.int64()), pa.array(base_sum, pa.float64()),
                     pa.array(rest_sum, pa.float64()), pa.array([block] * len(texts), pa.int64()),
                     pa.array([where[i].astype("<u4").tobytes() for i, _ in rows], pa.binary()), pa.array([t.tobytes() for _, t in rows], pa.binary()),
                     pa.array([hashes.astype("<u8").tobytes()] + [None] * (len(texts) - 1), pa.binary()), pa.array(packed, pa.binary())],
                    names=[key, "train", "n_tokens", "n_known", "base_score", "rest", "block", "light", "times", "words", "ids"])
                block += 1

    rows = docs.select(key, "train", text_bytes().alias("_text")).mapInArrow(number, ROW_COLUMNS.format(key=key, kind=kind))
    return stored(rows, "lm-rows")


def id_runs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 23) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Model ids (the first column) of runs of rows with about ``limit`` tokens, and their other columns; the
    more rows stand side by side, the fuller the windows."""
    texts, other, size = [], [], 0
    for batch in batches:
        other.append(batch.select(batch.schema.names[1:]))
        for value in batch.column(0):
            texts.append(np.frombuffer(value.as_py(), dtype="<i2"))
            size += len(texts[-1])
        if size > limit:
            yield texts, pa.Table.from_batches(other)
            texts, other, size = [], [], 0
    if texts:
        yield texts, pa.Table.from_batches(other)


def end_id(lex: Lexicon) -> int:
    return lex.words.index(END) if END in lex.words[:lex.head] else HEAD + tail_class(END)


def lane_runs(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(lane, model ids of a run of its rows): rows come sorted by lane, each repeated ``times`` times. A run ends
    with the row that fills it, so that it does not depend on how rows are batched."""
    texts, size, current = [], 0, None
    for batch in batches:
        for lane, times, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if texts and lane != current:
                yield current, texts
                texts, size = [], 0
            current, text = lane, np.frombuffer(value.as_py(), dtype="<i2")
            for _ in range(times):
                texts.append(text)
                size += len(text)
                if size > limit:
                    yield current, texts
                    texts, size = [], 0
    if texts:
        yield current, texts


def training_lanes(rows: DataFrame, lanes: int, key: str, rounds: int, r: int) -> DataFrame:
    """(lane, times, ids) of one part of the training rows, a lane whole and in hash order inside one partition.

    Part, lane and order come from a hash of the row's key and ids alone. Equal rows are counted first and
    dealt out evenly over the lanes."""
    mark = F.xxhash64(F.lit(17), F.col(key), F.col("ids"))
    part = rows.where(F.col("train") & (F.pmod(mark, F.lit(rounds)) == r)).groupBy(key, "ids").agg(F.count(F.lit(1)).alias("n"))
    part = part.select("ids", "n", mark.alias("mark"), F.explode(F.sequence(F.lit(0), F.least("n", F.lit(lanes)).cast("int") - 1)).alias("i"))
    lane = F.pmod(F.shiftright("mark", 20) + F.col("i"), F.lit(lanes)).cast("int")
    times = (F.floor(F.col("n") / lanes) + (F.col("i") < F.col("n") % lanes).cast("long")).cast("int")
    dealt = part.select(lane.alias("lane"), times.alias("times"), "ids", "mark")
    return dealt.repartitionById(lanes, F.col("lane")).sortWithinPartitions("lane", "mark", "ids").select("lane", "times", "ids")


def summed(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the vectors (slice, v) and of the tokens of each group."""
    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table["v"][0].as_py()) // 8, np.int64)
        for v in table["v"]:
            total += np.frombuffer(v.as_py(), "<i8")
        tokens = int(np.sum(table["tokens"].to_numpy()))
        return pa.table({"slice": table["slice"][:1], "band": table["band"][:1], "v": pa.array([total.tobytes()], pa.binary()),
                         "tokens": pa.array([tokens], pa.int64())})

    return parts.groupBy(*by).applyInArrow(add, "slice int, band int, v binary, tokens long")


def train_round(dealt: DataFrame, end: int, flat: np.ndarray, classes: int, rate: float) -> np.ndarray:
    """Weights after one part of the documents: lanes train from the same start; the average by tokens.

    Sums are of whole numbers (weights times 2^20, by thousands of tokens), so they do not depend on the order of
    lanes. A lane gives its vector in slices, and 512 lanes are summed at a time before all are."""
    start = dealt.sparkSession.sparkContext.broadcast(flat)
    step = -(-len(flat) // SLICES)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm import gated_lm as lm

        def rows() -> pa.RecordBatch:
            weight = -(-tokens // 1024)
            moved = np.rint((w.flat - start.value).astype(np.float64) * (1 << 20)).astype("<i8") * weight
            return pa.RecordBatch.from_arrays(
                [pa.array(range(lm.SLICES), pa.int32()), pa.array([lane // 512] * lm.SLICES, pa.int32()),
                 pa.array([moved[i * step:(i + 1) * step].tobytes() for i in range(lm.SLICES)], pa.binary()), pa.array([weight] * lm.SLICES, pa.int64())],
                names=["slice", "band", "v", "tokens"])

        lane = None
        for found, texts in lm.lane_runs(batches):
            if found != lane:
                if lane is not None:
                    yield rows()
                w = lm.Weights(start.value.copy(), classes)
                net, power, tokens, lane = lm.Network(w), np.full(len(w.flat), 1e-6, np.float32), 0, found
            tokens += sum(map(len, texts))
            for _, _, _, kept in lm._run(net, texts, end):
                g = net.gradient(kept)
                np.clip(g, -0.5, 0.5, out=g)
                power += g * g
                w.flat -= rate * g / np.sqrt(power)
        if lane is not None:
            yield rows()

    moved = dealt.mapInArrow(train, "slice int, band int, v binary, tokens long")
    out = flat.copy()
    for r in summed(summed(moved, ["slice", "band"]), ["slice"]).collect():  # SLICES rows
        at = r["slice"] * step
        v = np.frombuffer(r["v"], "<i8")
        out[at:at + len(v)] += (v / r["tokens"] / (1 << 20)).astype(np.float32)
    return out


def light_counts(rows: DataFrame, counts: DataFrame, tokens: int, bucket_words: int = 1 << 22) -> DataFrame:
    """(block, bucket, counts): the training counts of each block's dictionary, in its order.

    Dictionaries are cut at bucket borders of the hash; a bucket holds about ``bucket_words`` words of all blocks.
    A light word is in a block's dictionary once and has at most a HEAVY-th of the tokens, so no bucket is hot."""
    size = rows.where(F.col("words").isNotNull()).agg(F.sum(F.octet_length("words"))).first()[0] or 0
    buckets = max(64, -(-size // 8 // bucket_words))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = np.frombuffer(value.as_py(), "<u8")
                at = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                first = np.flatnonzero(np.diff(at, prepend=np.uint64(buckets))) if len(at) else []
                edge = [*first, len(words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(first), pa.int64()), pa.array(at[first].astype(np.int64) if len(at) else [], pa.int64()),
                     pa.array([words[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary())], names=["block", "bucket", "words"])

    def answer(asked: pa.Table, light: pa.Table) -> pa.Table:
        hashes, n = light["h"].to_numpy().view(np.uint64), light["n"].to_numpy()
        order = np.argsort(hashes)
        hashes, n = np.append(hashes[order], np.uint64(0)), np.append(n[order], 0)
        found = []
        for value in asked["words"]:
            words = np.frombuffer(value.as_py(), "<u8")
            at = np.searchsorted(hashes[:-1], words)
            found.append(np.where(hashes[at] == words, n[at], 0).astype("<u4").tobytes())
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "counts": pa.array(found, pa.binary())})

    asked = rows.where(F.col("words").isNotNull()).select("block", "words").mapInArrow(cut, "block long, bucket long, words binary")
    h = F.xxhash64("word")
    light = counts.where(F.col("n") * HEAVY <= tokens).select(h.alias("h"), "n").withColumn(
        "bucket", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(buckets).cast("long"), 32))
    return asked.groupBy("bucket").cogroup(light.groupBy("bucket")).applyInArrow(answer, "block long, bucket long, counts binary")


def score_rows(rows: DataFrame, counts: DataFrame, lex: Lexicon, flat: np.ndarray, key: str) -> DataFrame:
    """Per numbered row: key, n_tokens, n_known, base_score and score (log10).

    Words that are not heavy get their counts by block: the block's dictionary goes to the counts and back, and
    meets its rows again in one group of bounded size.
    """
    weights, end, classes = rows.sparkSession.sparkContext.broadcast(flat), end_id(lex), lex.classes
    lost, kind, key_type = float(np.log10(lex.tokens + lex.distinct + 1.0)), dict(rows.dtypes)[key], arrow_type(rows, key)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm import gated_lm as lm
        net = lm.Network(lm.Weights(weights.value, classes))
        for texts, other in lm.id_runs(batches):
            model = np.zeros(len(texts))
            for group, value, goal, _ in lm._run(net, texts, end):
                model[group] += np.where(goal >= 0, value, 0.0).sum(0) / np.log(10.0)
            yield from other.append_column("model", pa.array(model)).combine_chunks().to_batches()

    def gain(own: pa.Table, answers: pa.Table) -> pa.Table:
        """What a light word adds: log10(c + 1) to both scores; the denominators are in the row's own part or lost."""
        found = [v.as_py() for v in answers.sort_by("bucket")["counts"]]
        n = np.frombuffer(b"".join(found), "<u4").astype(np.float64)
        logs = np.log10(n + 1.0)
        known, more = [], []
        for light, times in zip(own["light"], own["times"]):
            at, t = np.frombuffer(light.as_py(), "<u4"), np.frombuffer(times.as_py(), "<u4")
            known.append(int(t[n[at] > 0].sum()))
            more.append(float((t * logs[at]).sum()))
        total, heavy, more = own["n_tokens"].to_numpy(), own["n_known"].to_numpy(), np.array(more)
        return pa.table({key: own[key].cast(key_type), "n_tokens": total, "n_known": heavy + np.array(known, np.int64),
                         "base_score": own["base_score"].to_numpy() - (total - heavy) * lost + more,
                         "score": own["model"].to_numpy() + own["rest"].to_numpy() + more})

    fields = f"block long, `{key}` {kind}, n_tokens long, n_known long, base_score double, rest double, light binary, times binary"
    scored = rows.select("ids", "block", key, "n_tokens", "n_known", "base_score", "rest", "light", "times").mapInArrow(score, fields + ", model double")
    answers = light_counts(rows, counts, lex.tokens)
    return scored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        gain, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double")


def language_model(docs: DataFrame, held, key: str = "doc_id", rounds: int = 3, rate: float = 0.05, lanes: int = 16) -> DataFrame:
    """Train on the rows where ``held`` is not true, score all; one row per input row.

    Missing and empty texts are one end. Repeated rows are counted, trained on and scored each. With
    no training row every word is unknown and the model is its start. Rows without a key train. There are
    ``lanes`` training lanes, and one more for every 2^24 training tokens beyond them, whatever the layout of the
    input: scores differ between layouts by rounding only. A word that is not heavy is known by 64 bits of hash.
    """
    spark = ship(docs.sparkSession)
    docs = docs.select(key, "text", (~held).alias("train"))
    counts = word_counts(docs)
    lex = lexicon(counts)
    shared, tag = spark.sparkContext.broadcast(lex), uuid.uuid4().hex
    weights = Weights.start(lex)
    flat, classes = weights.flat, weights.classes
    rows, end = numbered(docs, shared, tag, key), end_id(lex)
    lanes = max(lanes, lex.tokens >> 24)
    for r in range(rounds):
        flat = train_round(training_lanes(rows, lanes, key, rounds, r), end, flat, classes, rate / (1 + r))
    return score_rows(rows, counts, lex, flat, key).withColumn("train_tokens", F.lit(lex.tokens).cast("long"))
