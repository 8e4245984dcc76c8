"""Quality by a convolutional network over bytes, in numpy.

Learned filters of ``WIDTH`` bytes slide over every byte of a document. Blocks of ``BLOCK`` bytes keep the
highest response of each filter; two neighbouring blocks are a chunk, so chunks overlap by half and cover
the whole text. A hidden layer reads each chunk, and one logistic unit reads the highest and the mean hidden
value over all chunks. A text is laid out with padding no filter can start in, so it has the same result
in any company. Through a maximum only the winning window is to blame, so training scatters gradients
to the bytes of winning windows and costs little more than scoring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import ship, slices, text_bytes
from panelspark.llm.svm import logistic_scale

WIDTH, FILTERS, HIDDEN, BLOCK = 7, 32, 16, 256
PAD = 256
#: a response no real window has, which keeps windows from starting in the padding
NEVER = -1e4
#: blocks measured at a time: their responses stay in the processor's cache
STRIP = 16


def laid_out(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts, each padded to whole blocks; first block of each text and the end)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-(sizes + WIDTH - 1) // BLOCK)  # no window reaches the next text
    first = np.concatenate([[0], np.cumsum(blocks)])
    symbols = np.full(first[-1] * BLOCK + WIDTH - 1, PAD, np.int64)
    for t, f in zip(texts, first):
        symbols[f * BLOCK:f * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return symbols, first


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left block, right block of each chunk; first chunk of each text and the end)."""
    n = np.maximum(1, np.diff(first) - 1)
    start = np.concatenate([[0], np.cumsum(n)])
    left = np.repeat(first[:-1] - start[:-1], n) + np.arange(start[-1])
    return left, np.minimum(left + 1, np.repeat(first[1:] - 1, n)), start


class ByteNetwork:
    def __init__(self, seed: int = 11):
        spin = np.random.default_rng(seed)
        self.filters = spin.normal(0, 0.25, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.fixed()
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = spin.normal(0, (2 / FILTERS) ** 0.5, (FILTERS + 1, HIDDEN)).astype(np.float32)
        self.b1 = np.full(HIDDEN, 0.1, np.float32)
        self.w2 = spin.normal(0, (1 / HIDDEN) ** 0.5, 2 * HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.scale = (1.0, 0.0)

    def fixed(self) -> None:
        self.filters[:, PAD] = 0.0
        self.filters[0, PAD] = NEVER

    def responses(self, symbols: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Highest response of each filter in each block, before bias; with ``where`` also its position."""
        n = (len(symbols) - WIDTH + 1) // BLOCK
        top = np.empty((n, FILTERS), np.float32)
        place = np.empty((n, FILTERS), np.int64) if where else None
        total, part = np.empty((STRIP * BLOCK, FILTERS), np.float32), np.empty((STRIP * BLOCK, FILTERS), np.float32)
        for b in range(0, n, STRIP):
            m = min(STRIP, n - b)
            at, size = b * BLOCK, m * BLOCK
            z, one = total[:size], part[:size]
            np.take(self.filters[0], symbols[at:at + size], axis=0, out=z, mode="clip")
            for k in range(1, WIDTH):
                np.take(self.filters[k], symbols[at + k:at + k + size], axis=0, out=one, mode="clip")
                z += one
            cube = z.reshape(m, BLOCK, FILTERS)
            if where:
                inside = cube.argmax(axis=1)
                top[b:b + m] = np.take_along_axis(cube, inside[:, None], axis=1)[:, 0]
                place[b:b + m] = inside + (b + np.arange(m))[:, None] * BLOCK
            else:
                cube.max(axis=1, out=top[b:b + m])
        return top, place

    def forward(self, texts: Sequence[bytes], where: bool = False) -> dict[str, np.ndarray]:
        symbols, first = laid_out(texts)
        top, place = self.responses(symbols, where)
        left, right, start = chunks_of(first)
        high = np.maximum(top[left], top[right])
        used = np.add.reduceat((symbols[:len(top) * BLOCK] != PAD), np.arange(0, len(top) * BLOCK, BLOCK))
        inside = used[left] + np.where(right != left, used[right], 0)
        x = np.concatenate([np.maximum(high + self.bias, 0), np.log2(1 + inside)[:, None] / 9], axis=1).astype(np.float64)
        hidden = np.maximum(x @ self.w1 + self.b1, 0)
        count = np.diff(start)
        most = np.maximum.reduceat(hidden, start[:-1], axis=0)
        mean = np.add.reduceat(hidden, start[:-1], axis=0) / count[:, None]
        pooled = np.concatenate([most, mean], axis=1)
        return {"symbols": symbols, "top": top, "place": place, "left": left, "right": right, "start": start, "count": count,
                "high": high, "x": x, "hidden": hidden, "most": most, "pooled": pooled, "logit": pooled @ self.w2 + self.b2[0]}

    def gradients(self, texts: Sequence[bytes], goal: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradients of the weighted mean logistic loss, and the loss."""
        s = self.forward(texts, where=True)
        p = 1 / (1 + np.exp(-np.clip(s["logit"], -30, 30)))
        loss = -(weight * (goal * np.log(p + 1e-12) + (1 - goal) * np.log(1 - p + 1e-12))).mean()
        d = weight * (p - goal) / len(goal)
        out = {"w2": s["pooled"].T @ d, "b2": np.array([d.sum()])}
        back = d[:, None] * self.w2
        owner = np.repeat(np.arange(len(goal)), s["count"])
        # the highest chunk of a text, the first among equals, takes the gradient of the maximum
        best = np.zeros_like(s["hidden"])
        winner = s["hidden"] == s["most"][owner]
        rank = np.cumsum(winner, axis=0)
        before = rank[s["start"][:-1]] - winner[s["start"][:-1]]
        best[winner & (rank - before[owner] == 1)] = 1
        dh = best * back[owner, :HIDDEN] + back[owner, HIDDEN:] / s["count"][owner, None]
        dh *= s["hidden"] > 0
        out["w1"], out["b1"] = s["x"].T @ dh, dh.sum(axis=0)
        dx = (dh @ self.w1.T)[:, :FILTERS] * (s["high"] + self.bias > 0)
        out["bias"] = dx.sum(axis=0)
        block = np.where(s["top"][s["left"]] >= s["top"][s["right"]], s["left"][:, None], s["right"][:, None])
        columns = np.broadcast_to(np.arange(FILTERS), block.shape)
        position = s["place"][block, columns]
        grad = np.empty_like(self.filters)
        cells = (PAD + 1) * FILTERS
        for k in range(WIDTH):
            cell = s["symbols"][position + k] * FILTERS + columns
            grad[k] = np.bincount(cell.ravel(), dx.ravel(), cells).reshape(PAD + 1, FILTERS)
        grad[:, PAD] = 0
        out["filters"] = grad
        return out, float(loss)

    def probability(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of quality 1. Rounded, so that the company of a text in a batch cannot show."""
        slope, offset = self.scale
        margin = slope * self.forward(texts)["logit"] + offset
        return np.round(1 / (1 + np.exp(-np.clip(margin, -30, 30))), 6)


def train(texts: Sequence[bytes], labels: np.ndarray, steps: int = 1400, batch: int = 16, rate: float = 4e-3, seed: int = 11) -> ByteNetwork:
    """A network fitted by Adam on balanced classes; every fifth text is kept aside for the logistic scale.

    Passes over the texts are as many as ``steps`` batches need, 8 at least and 40 at most.

    With one class only, the probability is its smoothed share; with no text it is one half.
    """
    net = ByteNetwork(seed)
    labels = np.asarray(labels, np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    if len(set(labels.tolist())) < 2:
        net.scale = (0.0, float(np.log(share / (1 - share))))
        return net
    aside = np.arange(len(texts)) % 5 == 4
    if len(texts) < 50 or len(set(labels[aside].tolist())) < 2:
        aside = np.zeros(len(texts), bool)
    learn = np.flatnonzero(~aside)
    weight = np.where(labels == 1, 0.5 / labels[learn].mean(), 0.5 / (1 - labels[learn]).mean())
    names = ("filters", "bias", "w1", "b1", "w2", "b2")
    mean = {n: np.zeros_like(getattr(net, n)) for n in names}
    square = {n: np.zeros_like(getattr(net, n)) for n in names}
    spin, step = np.random.default_rng(seed), 0
    rounds = -(-len(learn) // batch)
    passes = min(40, max(8, -(-steps // rounds)))
    total = passes * rounds
    for _ in range(passes):
        order = spin.permutation(learn)
        for b in range(0, len(order), batch):
            rows = order[b:b + batch]
            found, _ = net.gradients([texts[i] for i in rows], labels[rows], weight[rows])
            step += 1
            now = rate * min(1.0, step / 50) * (1 - 0.9 * step / total)
            for n in names:
                g = found[n].astype(np.float32)
                mean[n] += 0.1 * (g - mean[n])
                square[n] += 0.001 * (g * g - square[n])
                move = now * (mean[n] / (1 - 0.9 ** step)) / (np.sqrt(square[n] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, n, getattr(net, n) - move.astype(np.float32))
            net.fixed()
    judge = np.flatnonzero(aside) if aside.any() else learn
    margin = np.concatenate([net.forward([texts[i] for i in judge[b:b + 64]])["logit"] for b in range(0, len(judge), 64)])
    net.scale = logistic_scale(margin, labels[judge])
    return net


def fit(sample: DataFrame, longest: int = 20_000, **options) -> ByteNetwork:
    """A network from (text, label) rows, of at most ``longest`` UTF-8 bytes each; the caller bounds their number.

    Rows are sorted before they are used, so the network does not depend on how they arrive.
    """
    rows = sample.select(text_bytes("text").alias("text"), "label").where(F.length("text") <= longest).collect()
    held = sorted((bytes(r["text"]), int(r["label"])) for r in rows)
    order = np.random.default_rng(5).permutation(len(held))
    return train([held[i][0] for i in order], np.array([held[i][1] for i in order]), **options)


def _scored(batches: Iterator[pa.RecordBatch], net: ByteNetwork) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in slices(batch, 1):
            score = net.probability(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(score), pa.array((score >= 0.7).astype(np.int32))],
                                             names=["key", "score", "predicted"])


def score_quality(docs: DataFrame, net: ByteNetwork, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every row. A missing text is empty, an empty one gets the value of no response at all.

    Texts of any length are read whole, one by one. Equal texts have equal scores, whatever else the rows
    hold; other columns are not read. ``predicted`` is 1 from a score of 0.7 on.
    """
    ship(docs.sparkSession)
    shape = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(key).alias("key"), text_bytes(text).alias("_text")).mapInArrow(partial(_scored, net=net), shape).withColumnRenamed("key", key)
