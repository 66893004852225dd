"""Telling apart the few rows of a table that something is known about, without moving the others.

Keys are marked in a bitmap of fixed size that goes to every executor. Rows whose place is not marked are surely not among
the keys and stay where they are; the others (the keys' rows, and by chance some more) can be joined with the keys. However
many keys there are, nothing is lost: a full bitmap only means that all rows are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a bitmap: 2 MB on an executor, 4 MB on their way to the driver at most.
PLACES = 1 << 24


def free(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front of it a name that the table has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bitmap(keys: DataFrame, mark: F.Column, places: int = PLACES) -> np.ndarray:
    """Which places the marks (64-bit hashes) of the keys have; words are formed on the executors."""
    at = F.pmod(mark, F.lit(places))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    got = words.agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    held = np.zeros(places // 64, np.int64)
    held[got.column("word").to_numpy().astype(np.int64)] = got.column("bits").to_numpy().astype(np.int64)
    return held


def split(df: DataFrame, mark: F.Column, held: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows whose place is free, and those whose place is marked; columns as they are, no shuffle.

    Only the marks go to Python, the rows stay in the JVM.
    """
    shared = df.sparkSession.sparkContext.broadcast(held)
    places = 64 * len(held)

    @F.arrow_udf("boolean")
    def hit(marks: pa.Array) -> pa.Array:
        at = marks.to_numpy(zero_copy_only=False) % places
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return df.where(~hit(mark)), df.where(hit(mark))
