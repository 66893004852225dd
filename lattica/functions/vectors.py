"""Vector expressions, and the built-in embedder: hashed bags of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.text import _col

WORD = re.compile("[a-z0-9]+")
#: Words whose buckets a task remembers.
WORDS = 1 << 18


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    whole = F.array(F.struct(_col(v).alias("v"), dot(v, v).alias("n")))  # bound once, not once an element
    return F.transform(whole, lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(F.sqrt(s["n"]))))[0]


def embed(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """``(key, embedding)``: unit vectors of word counts in ``dim`` hash buckets; texts without a word have zeros.

    Words are counted in Arrow batches, text by text, so nothing is shuffled; a task remembers the buckets of the words that it has
    met, a bounded number of them.
    """
    rows = df.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        for batch in batches:
            made = np.zeros((batch.num_rows, dim))
            for i, t in enumerate(batch.column(1)):
                for word, n in Counter(WORD.findall(t.as_py())).items():
                    at = place.get(word)
                    if at is None:
                        if len(place) >= WORDS:
                            place.clear()
                        at = place[word] = int(md5(word.encode()).hexdigest()[:8], 16) % dim
                    made[i, at] += n
            norm = np.sqrt((made * made).sum(axis=1))
            made /= np.where(norm == 0, 1.0, norm)[:, None]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dim), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=[key, "embedding"])

    return rows.mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>")
