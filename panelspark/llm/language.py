"""Language identification in two steps: the family first, then one-versus-one SVMs inside it.

Features are shares of hashed byte trigrams of the lower-cased text. All machines are linear, so
a document's margins are means of table rows: one pass over its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_sample, ship, text_bytes
from panelspark.llm.svm import linear_svm

FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
    "baltic": ("lt", "lv"),
}
BITS = 14
LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIER = np.uint32(2654435761)


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, members in FAMILIES.items() if code in members), f"single:{lang}")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts in turn, and how many each text has."""
    low = [b" " + b" ".join(t.decode("utf-8", "replace").lower().encode().split()) + b" " for t in texts]
    size = np.array([len(t) for t in low], dtype=np.int64)
    raw = np.frombuffer(b"".join(low) + b"  ", dtype=np.uint8).astype(np.uint32)
    code = (((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * _MULTIPLIER) >> np.uint32(32 - BITS)
    return code, size


@dataclass(frozen=True)
class LanguageModel:
    """``table``: one column per machine, first the families (one against the rest), then the pairs."""

    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int, int], ...]  # family, two positions in it
    table: np.ndarray
    bias: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        code, size = trigrams(texts)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        return np.add.reduceat(self.table[code], starts, axis=0) / size[:, None] + self.bias

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and score of each text. The score is the product of both steps' logistic margins."""
        if not self.families:
            return [("und", 0.0)] * len(texts)
        margins = self.margins(texts)
        out = []
        for text, row in zip(texts, margins):
            if not LETTER.search(text.decode("utf-8", "replace")):
                out.append(("und", 0.0))
                continue
            many = len(self.families) > 1
            best = int(np.argmax(row[:len(self.families)])) if many else 0
            score = 1 / (1 + np.exp(-2.0 * row[best])) if many else 1.0
            votes, names = np.zeros(len(self.members[best])), self.members[best]
            total = np.zeros(len(names))
            for k, (f, a, b) in enumerate(self.pairs):
                if f == best:
                    m = row[len(self.families) + k]
                    votes[a if m > 0 else b] += 1
                    total[a] += m
                    total[b] -= m
            win = max(range(len(names)), key=lambda i: (votes[i], total[i], -i))
            if len(names) > 1:
                score *= 1 / (1 + np.exp(-2.0 * total[win] / (len(names) - 1)))
            out.append((names[win], float(min(1.0, max(0.0, score)))))
        return out


def fit(rows: DataFrame, label: str = "lang", key: str = "doc_id", per_class: int = 250, most_bytes: int = 50_000,
        cost: float = 50.0) -> LanguageModel:
    """Fit on at most ``per_class`` documents of each language, drawn by hash among those of at most
    ``most_bytes`` bytes with a letter: the documented bound of what the driver sees."""
    able = rows.where(F.col(label).isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes)
                      & F.col("text").rlike(r"\p{L}"))
    got = bounded_sample(able.select(key, label, "text"), label, per_class, key).select(label, "text").collect()
    got = sorted((r[0], r[1].encode()) for r in got)
    langs = sorted({lang for lang, _ in got})
    families = sorted({family_of(x) for x in langs})
    members = tuple(tuple(x for x in langs if family_of(x) == f) for f in families)
    pairs = tuple((k, a, b) for k, names in enumerate(members) for a, b in combinations(range(len(names)), 2))
    if not got:
        return LanguageModel((), (), (), np.zeros((1 << BITS, 1), np.float32), np.zeros(1))
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, (_, text) in enumerate(got):
        code, _ = trigrams([text])
        x[i] = np.bincount(code, minlength=1 << BITS) / len(code)
    used = np.flatnonzero(x.any(axis=0))
    small = x[:, used]
    del x  # the driver is small
    power = np.einsum("ij,ij->j", small, small) / len(small)
    scale = (1.0 / np.sqrt(power + 1e-7)).astype(np.float32)
    small *= scale
    size = np.float32(1.0 / np.sqrt(np.einsum("ij,ij->i", small, small).mean()))
    small *= size
    scale = scale * size
    of = np.array([lang for lang, _ in got])
    kin = np.array([family_of(lang) for lang, _ in got])
    machines = []
    for f in families if len(families) > 1 else [None]:
        y = np.ones(len(of)) if f is None else np.where(kin == f, 1.0, -1.0)
        machines.append((np.zeros(len(used)), 1.0) if f is None else linear_svm(small, y, cost))
    for k, a, b in pairs:
        pick = np.isin(of, (members[k][a], members[k][b]))
        machines.append(linear_svm(small[pick], np.where(of[pick] == members[k][a], 1.0, -1.0), cost))
    table = np.zeros((1 << BITS, len(machines)), dtype=np.float32)
    for c, (w, _) in enumerate(machines):
        table[used, c] = w * scale
    return LanguageModel(tuple(families), members, pairs, table, np.array([b for _, b in machines]))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """One row per input row: key, lang_pred, score. Missing texts and texts without a letter: ``und``, 0.

    Only the text is read; the model is one table of 2^14 rows.
    """
    kind = dict(docs.dtypes)[key]
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[tuple[str, float]] = []
            run: list[bytes] = []
            size = 0
            for value in batch.column(1):
                run.append(value.as_py())
                size += len(run[-1])
                if size > 1 << 21:
                    got += shared.value.predict(run)
                    run, size = [], 0
            got += shared.value.predict(run) if run else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                names=[key, "lang_pred", "score"])

    return docs.select(key, text_bytes().alias("_text")).mapInArrow(predict, f"`{key}` {kind}, lang_pred string, score double")
