"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over common subsequences of three letters, lambda to the power of
both spans, divided by both strings' norms: one inserted or dropped letter changes a string's
features only in part. A word is read through windows of ``WINDOW`` letters. Nyström features are
kernel values with landmark strings times K_mm^(-1/2). Everything after the kernel is linear, so
the trained machine folds into one weight per letter triple, and a window's score is the weighted
sum of its triples over its norm. A sentence scores as its highest window, a document as its most
toxic sentence.

Labels belong to documents. Training takes the sentences of clean documents as labelled clean, and
in each toxic document the sentence that the current machine finds most toxic as labelled toxic;
it repeats with the clean windows that come out too high.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Tidied, bounded_sample, release_memory, ship, text_bytes, worker_state
from panelspark.llm.svm import logistic_scale, newton_svm

SHORTEST, WINDOW, LAMBDA, SENTENCE = 4, 7, 0.7, 12
_FOLD = str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ@$013457", "aaaaaaceeeeiiiinooooouuuuyyasoieast")
_END = re.compile(r"[.!?]\W*$")


def letters(word: str) -> str:
    """Lower case, accents and look-alike digits folded, all but letters dropped."""
    low = word.lower()
    plain = low if low.isascii() and low.isalpha() else low.translate(_FOLD).replace("ß", "ss")
    return plain if plain.isalpha() else "".join(c for c in plain if c.isalpha())


@lru_cache
def picks(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all triples in a string of this length, and lambda to the power of their spans."""
    at = list(combinations(range(length), 3))
    return np.array(at, dtype=np.int64).reshape(-1, 3), np.array([LAMBDA ** (c - a + 1) for a, _, c in at])


def triples(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of one length, letters as numbers below 32: triple codes, weights, and each string's norm."""
    at, weight = picks(code.shape[1])
    code = (code[:, at[:, 0]] << 10) | (code[:, at[:, 1]] << 5) | code[:, at[:, 2]]
    order = np.argsort(code, axis=1)
    ranked = np.take_along_axis(code, order, axis=1)
    held = np.cumsum(weight[order], axis=1)
    last = np.ones(ranked.shape, dtype=bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    row, col = np.nonzero(last)
    top = held[row, col]
    below = np.concatenate([[0.0], top[:-1]])
    below[np.concatenate([[True], row[1:] != row[:-1]])] = 0.0
    return code, weight, np.sqrt(np.bincount(row, (top - below) ** 2, minlength=len(code)))


def numbered(words: list[str]) -> np.ndarray:
    """Letters of words of one length as numbers below 32."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.int64)
    return np.where((raw >= 97) & (raw <= 122), raw - 96, 27 + raw % 5)


def windows(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All windows of words of SHORTEST letters or more: (word number, letters), a length at a time."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= SHORTEST:
            by.setdefault(len(w), []).append(i)
    for n, group in by.items():
        step = max(1, 8192 // max(1, n - WINDOW + 1))
        for at in range(0, len(group), step):
            part = np.array(group[at:at + step])
            code = numbered([words[i] for i in part])
            if n > WINDOW:
                code = np.lib.stride_tricks.sliding_window_view(code, WINDOW, axis=1)
                part, code = np.repeat(part, code.shape[1]), code.reshape(-1, WINDOW)
            yield part, code


def folded(words: list[str], table: np.ndarray, none: float = 0.0) -> np.ndarray:
    """Each word's highest window: the sum of weight times table row over its triples, over its norm."""
    out = np.full(len(words), -np.inf)
    for part, code in windows(words):
        code, weight, norm = triples(code)
        np.maximum.at(out, part, table[code] @ weight / norm)
    return np.where(np.isneginf(out), none, out)


def sentences(text: str) -> list[list[str]]:
    """Words in sentences of at most SENTENCE words; letters spelled out one by one are also joined."""
    out: list[list[str]] = []
    run: list[str] = []
    single: list[str] = []
    for raw in text.split():
        word = letters(raw)
        if len(word) == 1:
            single.append(word)
        else:
            if len(single) >= 4:
                run.append("".join(single))
            single = []
            if len(word) >= 3:
                run.append(word)
        if len(run) >= SENTENCE or (raw[-1] in ".!?\"')" and _END.search(raw)):
            if len(single) >= 4:
                run.append("".join(single))
                single = []
            if run:
                out.append(run)
            run = []
    if len(single) >= 4:
        run.append("".join(single))
    if run:
        out.append(run)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # one weight per letter triple
    bias: float
    slope: float
    offset: float
    floor: float  # score of a text without words

    def document(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def rows_of(strings: list[str], table: np.ndarray) -> np.ndarray:
    """Kernel values of strings of at most WINDOW letters with the landmarks of ``table``."""
    out = np.zeros((len(strings), table.shape[1]))
    for part, code in windows(strings):
        code, weight, norm = triples(code)
        for at in range(0, len(part), 512):
            to = slice(at, at + 512)
            out[part[to]] = np.einsum("ijk,j->ik", table[code[to]], weight) / norm[to, None]
    return out


def landmark_table(marks: list[str]) -> np.ndarray:
    """Column m: the normalised triple weights of landmark m."""
    table = np.zeros((1 << 15, len(marks)), dtype=np.float32)
    for m, word in enumerate(marks):
        code, weight, norm = triples(numbered([word]))
        np.add.at(table[:, m], code[0], weight / norm[0])
    return table


def stems(word: str) -> set[str]:
    return {word[i:i + n] for n in (4, 5) for i in range(len(word) - n + 1)}


def distinct_stems(ranked: list[str], parts: list[set[str]], most: int) -> list[str]:
    """Stems in order, without those whose words mostly hold an earlier one."""
    held: dict[str, list[int]] = {s: [] for s in ranked}
    for i, p in enumerate(parts):
        for s in p & held.keys():
            held[s].append(i)
    covered, out = np.zeros(len(parts), dtype=bool), []
    for s in ranked:
        if covered[held[s]].mean() < 0.7:
            out.append(s)
            covered[held[s]] = True
            if len(out) == most:
                break
    return out


def fit(labelled: DataFrame, key: str = "doc_id", per_class: int = 1500, most_bytes: int = 20_000, marks: int = 128,
        rounds: int = 5, most_windows: int = 6_000) -> ToxicityModel:
    """Fit on ``labelled`` (key, text, toxic): at most ``per_class`` documents of each label of at most
    ``most_bytes`` bytes, drawn by hash, which bounds what the driver sees."""
    able = labelled.where(F.col("toxic").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes))
    got = bounded_sample(able.select(key, "toxic", "text"), "toxic", per_class, key).select("toxic", "text").collect()
    got = sorted((int(r[0]), r[1]) for r in got)
    release_memory()
    model = fit_texts([t for _, t in got], [y for y, _ in got], marks, rounds, most_windows)
    del got
    release_memory()
    return model


def fit_texts(texts: list[str], toxic: list[int], marks: int = 128, rounds: int = 5, most_windows: int = 6_000) -> ToxicityModel:
    same: dict[str, str] = {}  # a word or stem is one object, however often it occurs: the driver is small
    bags = [(y, w) for y, t in zip(toxic, texts) if (w := sorted({same.setdefault(x, x) for s in sentences(t) for x in s if len(x) >= 3}))]
    label = np.array([y for y, _ in bags])
    if not bags or label.min() == label.max():
        rate = sum(toxic) / len(toxic) if toxic else 0.0
        return ToxicityModel(np.zeros(1 << 15), 0.0, 1.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), rate)
    vocabulary = sorted({w for _, words in bags for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    parts = [{same.setdefault(s, s) for s in stems(w)} or {w} for w in vocabulary]
    del same
    seen = [Counter(), Counter()]
    for y, words in bags:
        seen[y].update(set().union(*(parts[number[w]] for w in words)))
    share = float(label.mean())
    # log-likelihood ratio of a stem against equal rates; a stem counts beyond what chance gives in so many
    odds = {s: c * float(np.log(c / ((c + seen[0][s]) * share))) for s, c in seen[1].items() if c > share * (c + seen[0][s])}
    enough = float(np.log(len(odds) + 1)) + 3.0
    typical = {s for s, g in odds.items() if g >= enough and seen[0][s] * 20 <= seen[1][s]}
    clean_words = np.zeros(len(vocabulary), dtype=bool)
    owner = np.repeat(np.arange(len(bags)), [len(words) for _, words in bags])
    flat = np.array([number[w] for _, words in bags for w in words])
    starts = np.concatenate([[0], np.cumsum([len(words) for _, words in bags])[:-1]]).astype(np.int64)
    clean_words[flat[label[owner] == 0]] = True
    spread = np.bincount(flat[label[owner] == 1], minlength=len(vocabulary))  # toxic documents that hold a word
    sure = np.array([not typical.isdisjoint(p) for p in parts]) & ~clean_words
    rare = {s for s, c in seen[1].items() if c >= 3 and 10 * seen[0][s] <= c}
    pure = np.array([not rare.isdisjoint(p) for p in parts]) & ~clean_words
    # landmarks: the stems most typical of toxic documents, the words they stand in most, and usual clean stems
    chosen = distinct_stems(sorted(odds, key=lambda s: (-odds[s], s))[:16 * marks], parts, marks // 3)
    often = [i for i in np.argsort(-spread, kind="stable") if sure[i]][:marks]
    words_of = _best_windows([vocabulary[i] for i in often], None, odds)
    usual = sorted(seen[0], key=lambda s: (-seen[0][s], s))[:marks // 2]
    landmarks = list(dict.fromkeys(chosen + words_of + usual))
    table = landmark_table(landmarks)
    values, vectors = np.linalg.eigh(rows_of(landmarks, table) + 1e-4 * np.eye(len(landmarks)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    score = np.array([max((odds.get(s, -1.0) for s in p), default=-1.0) for p in parts])  # of words, before any training
    del parts, seen
    release_memory()
    bad = np.random.default_rng(3).permutation(np.flatnonzero(clean_words))[:most_windows // 2]
    w, b = np.zeros(len(landmarks)), -1.0
    for turn in range(rounds):
        spans = [flat[starts[d]:starts[d] + len(bags[d][1])] for d in np.flatnonzero(label == 1)]
        good = np.unique([x[int(np.argmax(score[x]))] for x in spans if not sure[x].any()]).astype(np.int64)
        good = np.union1d(good[pure[good]], np.flatnonzero(sure))
        good = good[np.argsort(-spread[good], kind="stable")][:most_windows]
        machine = None if turn == 0 else table @ (root @ w)
        x = rows_of(_best_windows([vocabulary[i] for i in np.concatenate([good, bad])], machine, odds), table) @ root
        y = np.repeat([1.0, -1.0], [len(good), len(bad)])
        weight = np.sqrt(spread[good])
        w, b = newton_svm(x, y, 10.0, np.concatenate([weight * max(1.0, len(bad) / max(1.0, weight.sum()) / 2), np.ones(len(bad))]))
        score = folded(vocabulary, table @ (root @ w), none=-1.0 - b) + b
        hard = np.flatnonzero(clean_words & (score > -0.7))
        hard = hard[np.argsort(-score[hard], kind="stable")][:most_windows // 2]
        bad = np.union1d(bad, hard)
    margin = np.maximum.reduceat(score[flat], starts)
    slope, offset = logistic_scale(margin, label.astype(float))
    model = ToxicityModel((table @ (root @ w)).astype(np.float64), b, slope, offset, 0.0)
    return ToxicityModel(model.table, b, slope, offset, float(model.document(np.array([-1.0]))[0]))


def _best_windows(words: list[str], table: np.ndarray | None, odds: dict[str, float]) -> list[str]:
    """The highest window of each word, by the machine or, before there is one, by its stems."""
    out = []
    for word in words:
        every = [word[i:i + WINDOW] for i in range(max(1, len(word) - WINDOW + 1))]
        if len(every) > 1:
            value = [sum(odds.get(s, -1.0) for s in stems(e)) for e in every] if table is None else folded(every, table)
            out.append(every[int(np.argmax(value))])
        else:
            out.append(every[0])
    return out


class WordScores:
    """Scores of words, each computed once per task while it fits in the memo."""

    def __init__(self, model: ToxicityModel, limit: int = 600_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        """Forget all words: at the end of a task, so that a worker holds nothing of them for the stages after."""
        self.number: dict[bytes, int] = {}
        self.score, self.flag = np.zeros(0), np.zeros(0, dtype=bool)

    def _learn(self, new: list[bytes]) -> None:
        text = [w.decode("utf-8", "replace") for w in new]
        plain = [letters(w) for w in text]
        flag = [len(p) == 1 for p in plain]
        self.number.update(zip(new, range(len(self.score), len(self.score) + len(new))))
        self.score = np.concatenate([self.score, folded(plain, self.model.table, -1.0 - self.model.bias)])
        self.flag = np.concatenate([self.flag, np.array(flag, dtype=bool)])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """Highest sentence margin of each text; NaN without words."""
        if len(self.number) > self.limit:
            self._clear()
        words = [t.split() for t in texts]
        seen: set[bytes] = set()
        for w in words:
            seen.update(w)
        if new := sorted(seen.difference(self.number)):
            self._learn(new)
        out = np.full(len(texts), np.nan)
        for i, w in enumerate(words):
            if w:
                ids = np.fromiter(map(self.number.__getitem__, w), dtype=np.int64, count=len(w))
                out[i] = self._document(self.score[ids], self.flag[ids], w)
        return out

    def _document(self, value: np.ndarray, flag: np.ndarray, words: list[bytes]) -> float:
        """The highest word, letters spelled out one by one (four or more) read as one word too.

        A sentence scores as its highest window, so cutting the text into sentences changes nothing.
        """
        best = float(value.max())
        if np.count_nonzero(flag) >= 4:
            edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
            joined = ["".join(letters(w.decode("utf-8", "replace")) for w in words[a:b]) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 4]
            if joined:
                best = max(best, float(folded(joined, self.model.table, -1.0 - self.model.bias).max()))
        return best + self.model.bias


def worker_scores(tag: str, shared: Broadcast) -> WordScores:
    """This worker's word scores; ``tag`` names the model."""
    return worker_state(tag, lambda: WordScores(shared.value))


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """One row per input row: key, score (0 to 1), predicted (1 from ``threshold``).

    Missing and empty texts have no sentence and get the score of a sentence without features.
    Only the text is read, nothing is shuffled; repeated rows score alike.
    """
    kind = dict(docs.dtypes)[key]
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    tag = uuid.uuid4().hex  # names this model in the workers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from panelspark.llm.string_kernel import worker_scores
        words = worker_scores(tag, shared)
        for batch in batches:
            margin: list[np.ndarray] = []
            run: list[bytes] = []
            size = 0
            for value in batch.column(1):
                run.append(value.as_py())
                size += len(run[-1])
                if size > 1 << 21:
                    margin.append(words.margins(run))
                    run, size = [], 0
            if run:
                margin.append(words.margins(run))
            m = np.concatenate(margin) if margin else np.zeros(0)
            p = np.where(np.isnan(m), words.model.floor, words.model.document(np.nan_to_num(m)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=[key, "score", "predicted"])
        words._clear()

    return docs.select(key, text_bytes().alias("_text")).mapInArrow(Tidied(score), f"`{key}` {kind}, score double, predicted int")
