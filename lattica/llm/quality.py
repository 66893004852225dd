"""Quality rules (operator 8): text statistics, and a verdict of hashed n-gram logistic regression.

Words and characters give hashed n-gram frequencies; a ridge-penalised logistic regression is trained on labelled rows,
its margin is turned into a probability on a part of them that it has not seen, and texts are scored in Arrow batches
against fixed thresholds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.linear import logistic, platt, rolling
from lattica.llm.rows import SLICE, each_text, forget, give_back
from lattica.plans.checkpoints import cut

CHARS, WORDS = (1, 2, 3), (1, 2)
BITS = 18
SYMBOLS = "#*$%&|<>"
SPACES = re.compile("[\x20\x09-\x0d]")
#: Labelled rows that the fit may see.
SAMPLE = 4000
#: Every so manieth of them is kept for calibration.
FOLD = 4
#: A feature is used if so many rows of the fit have it.
LEAST = 25
#: Rows with a lower probability of good quality are rejected.
KEEP = 0.5
#: Words of a window whose repetition counts.
RUN = 5


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Words as numbers in order of first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def repeated_words(ids: np.ndarray, n_distinct: int, run: int = RUN) -> int:
    """Words inside windows of ``run`` words that stand twice or more in the text, first ones included. Exact."""
    n = len(ids) - run + 1
    if n < 2:
        return 0
    key, span = ids[:n].copy(), n_distinct
    for k in range(1, run):
        if span * n_distinct >= 1 << 62:  # too wide for one number: number the distinct windows so far
            key = np.unique(key, return_inverse=True)[1]
            span = int(key.max()) + 1
        key, span = key * n_distinct + ids[k : k + n], span * n_distinct
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[run : run + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str, words: list[bytes], ids: np.ndarray, n_distinct: int) -> tuple[int, int, int, int, int, bool]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` of a text."""
    lines = [x for x in text.split("\n") if SPACES.sub("", x)] if "\n" in text else []
    n, again = len(words), repeated_words(ids, n_distinct)
    chars = len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d"))
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n


def grams(text: str, ids: np.ndarray, distinct: list[bytes]):
    """Hashes of character n-grams, then of word n-grams (apart by one bit), window by window, so that a long text is never held whole."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    return rolling(points, CHARS, BITS), (h + (1 << BITS) for h in rolling(hashed[ids], WORDS, BITS, 7))


@dataclass(frozen=True)
class QualityModel:
    """The used hashes with their weights, intercept, calibration."""

    at: np.ndarray
    given: np.ndarray
    intercept: float
    slope: float
    offset: float

    @cached_property
    def weights(self) -> np.ndarray:
        """Weights by hash; built where the model is used, so that little is sent."""
        weights = np.zeros(2 << BITS, np.float32)
        weights[self.at] = self.given
        return weights

    def probability(self, text: str, ids: np.ndarray, distinct: list[bytes]) -> float:
        z = self.intercept
        for part in grams(text, ids, distinct):
            n, total = 0, 0.0
            for h in part:
                n, total = n + len(h), total + float(self.weights[h].sum())
            if n:
                z += total / n
        return 1 / (1 + float(np.exp(-np.clip(self.slope * z + self.offset, -40, 40))))


def _frequencies(text: str) -> tuple[bytes]:
    words = text.encode().split()
    ids, distinct = word_ids(words)
    cols, vals = [], []
    for part in map(list, grams(text, ids, distinct)):
        if part:
            c, n = np.unique(np.concatenate(part), return_counts=True)
            cols.append(c.astype(np.int32))
            vals.append((n / n.sum()).astype(np.float32))
    if not cols:
        return (b"",)
    packed = np.concatenate(cols).tobytes() + np.concatenate(vals).tobytes()
    return (compress(packed, 6),)


def _sparse(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = decompress(packed) if packed else b""
    return np.frombuffer(data, np.int32, len(data) // 8), np.frombuffer(data, np.float32, len(data) // 8, len(data) // 2)


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, y, text)`` of at most ``sample`` labelled documents, chosen by the hash of their key, in shared storage.

    The labels are cut to the bound before the join, so the texts of other documents are never moved; repeated rows of a
    key count once (its greatest label, its smallest text), and null keys and labels are left out.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    chosen = marked.orderBy(F.xxhash64(F.lit(3), F.col(key)), key).limit(sample)
    rows = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    return cut(rows.groupBy(key).agg(F.first("y").alias("y"), F.min("text").alias("text")).withColumnRenamed(key, "key"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, ridge: float = 1e-3) -> QualityModel:
    """Fit on at most ``sample`` labelled rows. Without both labels among them every row gets the one label's rate.

    However few rows there are, the weights come from the rows outside the calibration fold. If that leaves them without one of
    the labels, the fold is theirs too.
    """
    rows = labelled(docs, labels, label, sample)
    got = each_text(rows, "text", lambda: lambda t: _frequencies(t or ""), "packed binary", ["key", "y"]).collect()
    got = sorted(got, key=lambda r: r["key"])
    y = np.array([r["y"] for r in got], float)
    width = 2 << BITS
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 1.0
        return QualityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0, 0.0, float(np.log((rate + 1e-9) / (1 - rate + 1e-9))))
    fold = np.arange(len(got)) % FOLD == 0
    df, mass = np.zeros(width), np.zeros(width)
    for c, v in (_sparse(r["packed"]) for r in got):
        df[c] += 1
        mass[c] += v
    used = np.flatnonzero(df >= min(LEAST, 0.1 * len(got)))
    scale = np.zeros(width)
    scale[used] = 1 / np.sqrt(mass[used] / len(got))
    place = np.full(width, -1)
    place[used] = np.arange(len(used))

    def matrix(which: np.ndarray):
        r, c, v = [], [], []
        for k, i in enumerate(which):
            cols, vals = _sparse(got[i]["packed"])
            own = place[cols] >= 0
            r.append(np.full(int(own.sum()), k, np.int32))
            c.append(place[cols[own]].astype(np.int32))
            v.append((vals[own] * scale[cols[own]]).astype(np.float32))
        return np.concatenate(r), np.concatenate(c), np.concatenate(v)

    fit, rest = np.flatnonzero(~fold), np.flatnonzero(fold)
    if y[fit].min() == y[fit].max():
        fit = np.arange(len(got))
    w, b = logistic(*matrix(fit), y[fit], len(used), ridge)
    r, c, v = matrix(rest)
    a, d = platt(np.bincount(r, v * w[c], len(rest)) + b, y[rest])
    return QualityModel(used.astype(np.int32), (w * scale[used]).astype(np.float32), float(b), a, d)


def quality(df: DataFrame, model: QualityModel, threshold: float = KEEP, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``n_words``, the statistics, ``base_failed``, ``probability`` and ``kept`` of every whole text.

    ``kept`` is false where the base rules fail and otherwise whether the probability reaches the threshold. Null and
    empty texts have no word, so they fail the base rules. Repeated rows stay repeated, an empty table gives no rows, and
    only the kept columns and the text are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    give_back()  # what training has left in the driver

    def make():
        known = shared.value

        def run(t):
            t = t or ""
            words = t.encode().split()
            ids, distinct = word_ids(words)
            out = statistics(t, words, ids, len(distinct))
            p = known.probability(t, ids, distinct)
            return *out, p, not out[-1] and p >= threshold

        return run

    return each_text(
        df,
        text,
        make,
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
        " probability double, kept boolean",
        keep,
    )


def filtered(df: DataFrame, model: QualityModel, threshold: float = KEEP, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``quality`` keeps, with all their columns, in one pass without a shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    give_back()  # what training has left in the driver

    def run(batches):
        forget()
        known = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                part = batch.slice(a, SLICE)
                keep = []
                for t in part.column(part.schema.get_field_index(text)):
                    t = t.as_py() or ""
                    words = t.encode().split()
                    ids, distinct = word_ids(words)
                    failed = statistics(t, words, ids, len(distinct))[-1]
                    keep.append(not failed and known.probability(t, ids, distinct) >= threshold)
                yield part.filter(pa.array(keep, pa.bool_()))
        give_back()

    return df.mapInArrow(run, df.schema)
