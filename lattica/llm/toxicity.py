"""Toxicity (operator 2): character n-grams scaled by naive Bayes log-count ratios, in a linear classifier.

Presence of hashed character n-grams is multiplied by the log of the ratio of their smoothed document rates in the two
classes; a logistic regression is trained on these features. Only n-grams whose ratio is far from chance, measured in
its standard errors, are used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.linear import code_points, logistic, rolling
from lattica.llm.quality import labelled
from lattica.llm.rows import each_text

ORDERS = (4, 6, 8)
BITS = 20
#: Labelled rows that the fit may see.
SAMPLE = 20_000
#: Tasks that count the sample; each sends at most one count a hash and class to the driver.
TASKS = 2
#: Standard errors between the log-count ratio of a used feature and zero, and documents that have it.
STEPS, LEAST = 4.0, 3
#: Scores from here on are predicted toxic.
TOXIC = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """The used hashes in order, their weights (log-count ratio times coefficient), and the intercept."""

    at: np.ndarray
    weights: np.ndarray
    intercept: float

    @cached_property
    def place(self) -> np.ndarray:
        """By hash: where its weight stands, or -1. Built where the model is used, so that little is sent."""
        place = np.full(1 << BITS, -1, np.int32)
        place[self.at] = np.arange(len(self.at))
        return place

    def found(self, text: str) -> np.ndarray:
        """Places of the distinct used hashes of a text."""
        hits = [x[x >= 0] for x in (self.place[h] for h in rolling(code_points(text), ORDERS, BITS))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int32)

    def score(self, text: str) -> float:
        z = self.intercept + float(self.weights[self.found(text)].sum())
        return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the hashes of its documents with their counts in either class."""
    by = np.zeros((2, 1 << BITS), np.int32)
    n = [0, 0]
    for batch in batches:
        for y, t in zip(batch.column("y").to_pylist(), batch.column("text"), strict=True):
            seen = np.zeros(1 << BITS, bool)
            for h in rolling(code_points(t.as_py() or ""), ORDERS, BITS):
                seen[h] = True
            by[int(y > 0)] += seen
            n[int(y > 0)] += 1
    some = np.flatnonzero(by.any(axis=0)).astype(np.int32)
    data = [pa.array([x], kind) for x, kind in ((n[0], pa.int64()), (n[1], pa.int64()), (compress(np.diff(some, prepend=0).astype("<i4").tobytes()), pa.binary()), (compress(by[:, some].tobytes()), pa.binary()))]
    yield pa.RecordBatch.from_arrays(data, names=["n0", "n1", "at", "by"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, ridge: float = 3e-4) -> ToxicityModel:
    """Fit on at most ``sample`` labelled rows. Without both labels among them every score is the one label's rate."""
    rows = labelled(docs, labels, label, sample)
    by, n = np.ones((2, 1 << BITS)), np.zeros(2)
    for r in rows.coalesce(TASKS).mapInArrow(_counts, "n0 long, n1 long, at binary, by binary").collect():
        at = np.cumsum(np.frombuffer(decompress(r["at"]), "<i4"))
        by[:, at] += np.frombuffer(decompress(r["by"]), np.int32).reshape(2, -1)
        n += (r["n0"], r["n1"])
    if not n.all():
        rate = float(n[1] / max(1, n.sum()))
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    ratio = np.log(by[1] / (n[1] + 2)) - np.log(by[0] / (n[0] + 2))
    used = np.flatnonzero((np.abs(ratio) >= STEPS * np.sqrt(1 / by[0] + 1 / by[1])) & (by.sum(axis=0) >= LEAST + 2))
    ratio = ratio[used]
    draft = ToxicityModel(used.astype(np.int32), ratio, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(draft)
    found = each_text(rows, "text", lambda: lambda t: (shared.value.found(t or "").tobytes(),), "at binary", ["key", "y"])
    got = sorted(found.collect(), key=lambda r: r["key"])
    hits = [np.frombuffer(r["at"], np.int32) for r in got]
    y = np.array([float(r["y"] > 0) for r in got])
    r = np.repeat(np.arange(len(got)), [len(h) for h in hits])
    c = np.concatenate(hits)
    w, b = logistic(r, c, ratio[c], y, len(used), ridge)
    return ToxicityModel(draft.at, (w * ratio).astype(np.float32), float(b))


def toxicity(df: DataFrame, model: ToxicityModel, threshold: float = TOXIC, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``score`` in 0..1 and ``predicted`` of every whole text.

    Null texts count as empty, and empty texts get the score of a text without any feature. Repeated rows stay repeated,
    an empty table gives no rows, and only the kept columns and the text are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.score

        def run(t):
            s = score(t or "")
            return s, int(s >= threshold)

        return run

    return each_text(df, text, make, "score double, predicted int", keep)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row's label may not be learnt: crc32 of its key as text leaves 2 modulo 4. A null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2
