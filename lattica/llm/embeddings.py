"""Embedding near-duplicates by an exact metric range join (operator 4).

On unit vectors a cosine of at least ``c`` is a distance of at most ``eps = sqrt(2 - 2c)``. Pivots partition the vectors
of a label: each is owned by the cell of its nearest pivot. By the triangle inequality a partner of ``x`` whose own
pivot is at distance ``d`` lies within ``d(y, p) <= d(y, own) + 2 eps`` of the pivot ``p`` of ``x``, so ``y`` is also sent
to every such cell as a visitor, and each cell joins its own vectors with all that came, independently of other cells.
Every label has pivots, one for so many of its vectors; they meet its vectors in blocks of bounded size. Where pivots
discard little, so that a vector would be sent to many cells, a label is one cell. Cells that are still large are dealt out
as a grid of blocks of few parts, and vectors travel as they are stored, since each is sent once for every part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.buckets import deal, groups, join_roots, together
from lattica.operators.blocks import meetings
from lattica.operators.components import connected_components
from lattica.plans.checkpoints import cut

COSINE = 0.93
#: A label has a pivot for every so many vectors, up to a few; then one for every so many more, up to the most.
PER_PIVOT, FEW, PER_FURTHER, PIVOTS = 64, 4, 4096, 16
#: Vectors that meet in one block, about.
BLOCK = 8192
#: A label is split into its cells if a vector is sent to so many of them at most, on average.
VISITS = 3
#: A large cell has two parts at least, and one for so many vectors; a block holds two of them.
PART = 98304
#: Products of a block that are looked at together.
PRODUCTS = 1 << 21
#: Distances are compared with so much slack, far above rounding; the cosine itself decides.
SLACK = 1e-9
KEYS = ["label", "size", "cell"]
BLOCKS = ["label", "size", "salt"]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _units(column: pa.Array, size: int) -> np.ndarray:
    return unit_rows(np.asarray(column.flatten()).reshape(-1, size))


def _cells(batches: Iterator[pa.RecordBatch], eps: float) -> Iterator[pa.RecordBatch]:
    """The cells of each vector; in every block (label, length, salt) the pivots come first."""
    held, pivots = None, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in BLOCKS])
        edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            part, key = batch.slice(a, b - a), tuple(keys[:, a].tolist())
            first = part.column("first").to_numpy(zero_copy_only=False)
            if key != held:
                held, pivots = key, np.zeros((0, key[1]))
            x = _units(part.column("vector"), key[1])
            pivots = np.concatenate([pivots, x[first]])
            rows = np.flatnonzero(~first)
            if not len(rows):
                continue
            far = np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ pivots.T))
            near = far.argmin(axis=1)
            row, cell = np.nonzero(far <= far[np.arange(len(rows)), near][:, None] + 2 * eps + SLACK)
            ends = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
            sent = part.take(pa.array(rows)).drop_columns(["salt", "first"])
            data = [*sent.columns, pa.array(near.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(data, names=[*sent.schema.names, "near", "cells"])


def _hits(raw: np.ndarray, flat: np.ndarray, rows: np.ndarray, columns: np.ndarray, cosine: float, above: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)`` out of rows and columns with at least the cosine, with ``above`` only ``i < j``.

    Single precision tells nearly all pairs apart; double precision decides those that it cannot.
    """
    slack = (raw.shape[1] + 8) * 2.0**-22
    for some, others in meetings(rows, columns, PRODUCTS):
        if above:
            others = others[others > some[0]]
        sim = flat[some] @ flat[others].T
        i, j = np.nonzero(sim >= np.float32(cosine - slack))
        sim, i, j = sim[i, j], some[i], others[j]
        sure = (sim >= cosine + slack) & (i < j if above else True)
        for at in np.array_split(near := np.flatnonzero(~sure & (i < j if above else True)), len(near) // 65536 + 1):
            sure[at] = (unit_rows(raw[i[at]]) * unit_rows(raw[j[at]])).sum(axis=1) >= cosine
        if sure.any():
            yield i[sure], j[sure]


def _links(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """For each owned vector of a block its number of partners there, and a spanning set of the links found."""
    for block in groups(batches, 5):
        size = block.column("size")[0].as_py()
        raw = np.concatenate([np.asarray(c.flatten()) for c in block.column("vector").chunks]).reshape(-1, size)
        flat = np.empty(raw.shape, np.float32)
        for at in range(0, len(raw), 8192):
            flat[at : at + 8192] = unit_rows(raw[at : at + 8192])
        n, ids, own, part = (block.column(c).to_numpy() for c in ("n", "id", "own", "part_own"))
        lo, hi = (block.column(c)[0].as_py() for c in ("part_lo", "part_hi"))
        mine, guest = (lambda p: np.flatnonzero(own & (part == p))), (lambda p: np.flatnonzero(~own & (part == p)))
        if lo == hi:
            found = [(mine(lo), mine(lo), True), (mine(lo), guest(lo), False)]
        else:
            found = [(mine(lo), np.flatnonzero(part == hi), False), (guest(lo), mine(hi), False)]
        roots, count = np.arange(len(raw)), np.zeros(len(raw), np.int64)
        for rows, columns, above in found:
            if not len(rows) or not len(columns):
                continue
            for i, j in _hits(raw, flat, rows, columns, cosine, above):
                np.add.at(count, i, n[j])
                np.add.at(count, j, n[i])
                join_roots(roots, i, j)
        count[~own] = 0  # counted where they are owned
        some = np.flatnonzero((count > 0) | (roots != np.arange(len(raw))))
        if len(some):
            data = [pa.array(ids[some]), pa.array(ids[roots[some]]), pa.array(count[some])]
            yield pa.RecordBatch.from_arrays(data, names=["src", "dst", "links"])


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row a vector.

    Vectors of equal, non-null labels and of one length are linked at a cosine of at least ``cosine`` in double
    precision. A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, nor does
    one without a label: no links, a component of its own. Equal vectors are one class and are never paired; their
    rows are counted. A null key has a null component and is not kept. Repeated rows are vectors of their own. Only the
    three columns are read; an empty table gives no rows.
    """
    real = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(F.col("vector"), lambda x: x != 0)
    kind = dict(df.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(key).alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast(kind).alias("vector"))
    good = F.coalesce(F.col("label").isNotNull() & real & some, F.lit(False))
    rows = rows.withColumn("good", good).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(5), "vector"))
    same = ["label", "h1", "h2"]
    usable = rows.where("good").withColumn("size", F.size("vector"))

    # where no pivot can prune, every cell gets every vector, so small labels have few cells
    plan = usable.groupBy("label", "size").agg(F.count("*").alias("held"))
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.least(F.lit(FEW), F.ceil(F.col("held") / PER_PIVOT)), F.ceil(F.col("held") / PER_FURTHER)))
    plan = plan.select("label", "size", wanted.cast("int").alias("wanted"), F.ceil(F.col("held") / (2 * block)).cast("int").alias("salts"))
    plan = cut(plan)
    several = F.broadcast(plan.where("wanted > 1"))  # at most one for PER_PIVOT vectors
    planned = lambda t: t.join(several, ["label", "size"], "left").withColumns({"wanted": F.coalesce("wanted", F.lit(1)), "salts": F.coalesce("salts", F.lit(1))})
    met = planned(usable)
    chosen = met.groupBy("label", "size", F.pmod("h2", "wanted").alias("which")).agg(F.min_by("vector", F.struct("h1", "h2")).alias("vector"), F.first("salts").alias("salts"))
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    classes = usable.groupBy(*same).agg(F.first("vector").alias("vector"), F.count("*").alias("n"), F.min("key").alias("low"))
    classes = planned(classes.withColumn("size", F.size("vector")))
    columns = [*BLOCKS, "first", "h1", "h2", "n", "low", "vector"]
    nothing = {"first": F.lit(True), "n": F.lit(0).cast("long"), "h1": F.lit(0).cast("long"), "h2": F.lit(0).cast("long"), "low": F.lit(None).cast(rows.schema["key"].dataType)}
    dealt = classes.withColumns({"salt": F.pmod("h1", "salts").cast("int"), "first": F.lit(False)}).select(*columns)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.withColumns(nothing).select(*columns).unionByName(dealt).repartition(partitions, *BLOCKS).sortWithinPartitions(*BLOCKS, F.desc("first"))
    eps = math.sqrt(2 - 2 * cosine)
    cells = dealt.mapInArrow(lambda b: _cells(b, eps), f"label long, size int, h1 long, h2 long, n long, low {dict(rows.dtypes)['key']}, vector {kind}, near int, cells array<int>")
    classes = cut(cells).withColumn("id", F.monotonically_increasing_id())

    # a label is split where its vectors are sent to few cells
    split = classes.groupBy("label", "size").agg(F.count("*").alias("held"), F.sum(F.size("cells")).alias("sent"), F.max("near").alias("last"))
    split = split.where((F.col("sent") <= VISITS * F.col("held")) & (F.col("last") > 0)).select("label", "size", F.lit(True).alias("split"))
    sent = classes.join(F.broadcast(split), ["label", "size"], "left")
    sent = sent.withColumn("cell", F.explode(F.when(F.col("split"), F.col("cells")).otherwise(F.array(F.lit(0)))))
    sent = sent.withColumn("own", F.col("split").isNull() | (F.col("cell") == F.col("near"))).select(*KEYS, "id", "n", "own", "vector")
    sides = [*KEYS, "part_lo", "part_hi"]
    parts = lambda n: F.greatest(F.lit(2), F.ceil(n / (PART if block >= BLOCK else block / 2)))
    side = together(deal(sent, KEYS, "id", block, parts).select(*sides, "part_own", "id", "n", "own", "vector"), sides)
    found = cut(side.mapInArrow(lambda b: _links(b, cosine), "src long, dst long, links long"))

    counts = found.groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "id")
    parts = connected_components(found).withColumnsRenamed({"node": "id", "component": "root"})
    rooted = classes.select("id", *same, "n", "low").join(parts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lowest, "root").join(counts, "id", "left")
    named = named.select(*same, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component")
    flat = rows.select("key", "good", *same)
    linked = flat.where("good").join(named, same).select("key", "links", "component")
    alone = flat.where(~F.col("good")).select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("component"))
    whole = linked.unionByName(alone)
    return whole.select(
        F.col("key").alias(key),
        F.col("links").cast("long").alias("n_links"),
        F.col("component").cast("long").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(False)).alias("kept"),
    )
