"""Groups of any size in tasks of bounded memory: large groups are dealt out as a grid of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a group that meet in one block at most, about.
BLOCK = 8192


def deal(df: DataFrame, keys: list[str], spread: str, block: int = BLOCK, parts_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """``df`` with ``part_lo`` and ``part_hi``: rows of a group meet in at least one block, and a block is bounded.

    A group of up to ``block`` rows is one block. A larger one is split by the hash of ``spread`` into parts; every two
    parts meet in a block of their own, so each of its rows is repeated once per part and no task holds the group.
    ``parts_of`` gives the number of parts by a group's size. Only groups beyond a block are sent to all executors.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    wanted = parts_of(F.col("__n")) if parts_of else F.ceil(F.col("__n") / F.lit(block / 2))
    parts = sizes.withColumn("__parts", wanted.cast("int")).drop("__n")
    with_parts = df.join(F.broadcast(parts), keys, "left")
    own = F.pmod(F.xxhash64(F.lit(11), F.col(spread)), F.col("__parts")).cast("int")
    others = F.when(F.col("__parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("__parts") - 1))
    return (
        with_parts.withColumn("part_own", F.coalesce(own, F.lit(0)))
        .withColumn("__other", F.explode(others))
        .withColumn("part_lo", F.least("part_own", "__other"))
        .withColumn("part_hi", F.greatest("part_own", "__other"))
        .drop("__parts", "__other")
    )


def together(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key stand side by side in one partition.

    The number of partitions is the session's: work that goes with the square of a block is not merged by its few bytes.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of the rows of each key (the first ``n_keys`` columns, integers) out of batches in key order.

    Groups of one row are left out: no pair can come of them.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        cuts = [0, *ends.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == 0 and held and any(held[0].column(i)[0].as_py() != int(keys[i, 0]) for i in range(n_keys)):
                if sum(x.num_rows for x in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            if b < batch.num_rows and a > 0 or (a == 0 and b < batch.num_rows and not held):
                if b - a > 1:
                    yield pa.Table.from_batches([batch.slice(a, b - a)])
            elif b < batch.num_rows:  # ends what was held
                held.append(batch.slice(a, b - a))
                yield pa.Table.from_batches(held)
                held = []
            else:
                held.append(batch.slice(a, b - a))
    if sum(x.num_rows for x in held) > 1:
        yield pa.Table.from_batches(held)


def join_roots(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hooks the roots of ``i`` and ``j`` pairwise to the smaller one, in place, until no pair has two; ``up`` stays flat."""
    while len(i):
        a, b = up[i], up[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up[:] = higher


def meetings(rows: np.ndarray, columns: np.ndarray, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows`` in slices, so that each with all ``columns`` makes a matrix of bounded size."""
    step = max(1, cells // max(1, len(columns)))
    for at in range(0, len(rows), step):
        yield rows[at : at + step], columns


def exact_dots(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` with the rows ``j`` of ``x``, summed component by component as SQL does."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 1 << 16):
        here = slice(at, at + (1 << 16))
        a, b, sums = i[here], j[here], out[here]
        for c in x.T:
            sums += c[a] * c[b]
    return out


def doubt(x: np.ndarray) -> float:
    """More than a product of matrices can be off from the exact inner products of rows of ``x``."""
    lengths = np.sqrt((x * x).sum(axis=1))
    longest = float(lengths[np.isfinite(lengths)].max(initial=0.0))
    return 4 * (x.shape[1] + 1) * 2.0**-52 * longest * longest
