"""Connected components of an undirected edge table (union-find replacement)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.blocks import join_roots
from lattica.plans.checkpoints import cut

#: Distinct edges up to which one task joins all (another way, not another result): a round of stars has some ten shuffles, however few edges.
FEW = 1 << 18


def _print(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, component)`` of the edges that one task reads; names are in the order in which Spark has them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    u, v = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 1))
    names = pc.unique(pa.chunked_array([u, v]))
    names = names.take(pc.sort_indices(names))
    up = np.arange(len(names))
    join_roots(up, *(pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False) for x in (u, v)))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(up))], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; component is its smallest node.

    Up to ``FEW`` distinct edges one task joins. More are contracted by the two stars in turn, each one shuffle of the remaining
    edges with a map-side minimum, and the lineage is cut after every round; the number of rounds grows with the logarithm
    of the longest chain. Self loops and nulls are ignored, repeated edges count once, an empty edge table gives an empty result.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    before = _print(now)
    if before[0] <= FEW:
        kind = now.schema["u"].dataType.simpleString()
        return cut(now.coalesce(1).mapInArrow(_joined, f"node {kind}, component {kind}"))
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        after = _print(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
