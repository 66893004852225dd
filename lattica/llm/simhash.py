"""SimHash near-duplicates by pivot distance tables (operator 7).

Every distinct fingerprint gets a row of Hamming distances to fixed reference fingerprints, once. Two fingerprints that
differ in at most ``k`` bits differ by at most ``k`` in every coordinate of that table (triangle inequality), so pairs
whose largest coordinate difference exceeds ``k`` are discarded by comparing small integers, and only survivors are
verified bit by bit. Distances of random fingerprints all lie near 32, so one reference discards about half of the pairs
and no set of references is an index; what is compared at all is therefore limited losslessly first: with ``k`` differing
bits at least ``parts - k`` of ``parts`` bit ranges are equal, and only fingerprints that agree on such ranges meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.buckets import deal, groups, join_roots, together
from lattica.llm.rows import each_text
from lattica.operators.components import connected_components
from lattica.plans.checkpoints import cut

SEED = 42
#: Reference fingerprints of the distance table.
REFERENCES = 16
#: Shingles whose bits are counted at once.
STRETCH = 1 << 16
#: Distinct fingerprints from which wider ranges are compared (another exact way, not another result).
MANY = 1 << 22


def hashes(text: str | None, size: int) -> np.ndarray:
    """64-bit hashes of the word shingles in order, repeats included; fewer words are one shingle. ASCII letters are lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in joined), np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without a word."""
    return majority(hashes(text, size))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), STRETCH):
        part = h[at : at + STRETCH]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3) -> DataFrame:
    """Kept columns and ``fp long`` (the 64 bits as a signed number) of every whole text; null counts as empty."""

    def make():
        def run(t):
            x = fingerprint(t, size)
            return (x - (1 << 64) if x >> 63 else x,)

        return run

    return each_text(df, text, make, "fp long", keep)


def references(n: int = REFERENCES) -> list[int]:
    """Fixed, well mixed reference fingerprints as signed numbers."""
    made = [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(1, n + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def _masks(k: int, many: bool) -> list[int]:
    parts = 2 * k if many and k > 1 else k + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]
    chosen = [sum(c) for c in combinations(ranges, parts - k)]
    return [x - (1 << 64) if x >> 63 else x for x in chosen]


def _links(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A spanning set of the links inside each block: its members with the root that they reach within it."""
    for block in groups(batches, 4):
        block = block.combine_chunks()
        fp = block.column("fp").to_numpy().astype(np.int64)
        far = block.column("far").combine_chunks()
        far = np.asarray(far.flatten()).reshape(len(fp), -1)
        order = np.argsort(far[:, 0], kind="stable")
        fp, far = fp[order], far[order]
        first = far[:, 0].astype(np.int16)
        stop = np.searchsorted(first, first + k, side="right")
        roots, bits = np.arange(len(fp)), fp.view(np.uint64)
        step = max(1, min(512, (1 << 21) // len(fp)))
        for a in range(0, len(fp), step):
            b = min(len(fp), a + step)
            z = int(stop[b - 1])
            alive = np.abs(far[a:b, None, 0] - far[None, a:z, 0]) <= k
            for p in range(1, far.shape[1]):
                alive &= np.abs(far[a:b, None, p] - far[None, a:z, p]) <= k
            i, j = np.nonzero(alive)
            near = np.bitwise_count(bits[a + i] ^ bits[a + j]) <= k
            i, j = i[near] + a, j[near] + a
            join_roots(roots, i[i < j], j[i < j])
        moved = np.flatnonzero(roots != np.arange(len(fp)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[roots[moved]])], names=["src", "dst"])


def linked(prints: DataFrame, k: int = 3, block: int = 8192) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints of column ``fp`` that join all those within ``k`` bits.

    Fewer links than pairs: inside a block of candidates each member is tied to the root it reaches there. No pair
    within ``k`` bits is left in different components. Ranges on which very many fingerprints agree are dealt out as
    blocks of bounded size.
    """
    distinct = prints.select("fp").distinct()
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("tinyint") for r in references()])
    masks = _masks(k, distinct.count() > MANY)
    ranges = F.array(*[F.struct(F.lit(i).cast("long").alias("range"), F.col("fp").bitwiseAND(F.lit(m)).alias("held")) for i, m in enumerate(masks)])
    rows = distinct.withColumn("far", table).withColumn("__r", F.explode(ranges)).select("fp", "far", "__r.range", "__r.held")
    dealt = deal(rows, ["range", "held"], "fp", block)
    keys = ["range", "held", "part_lo", "part_hi"]
    side = together(dealt.select(*keys, "fp", "far"), keys)
    return side.mapInArrow(lambda batches: _links(batches, k), "src long, dst long")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 3, size: int = 3, block: int = 8192) -> DataFrame:
    """``(key, fingerprint, component_id)``: fingerprints within ``k`` bits are linked, components take the smallest key.

    Rows of one fingerprint are one class and are never paired. Null and wordless texts have fingerprint 0 and link like
    any other. Rows without a key keep their row; a component of such rows only has a null ``component_id``. Repeated
    rows are repeated. Only the key and the text are read, so other columns cannot clash. An empty table gives no rows.
    """
    prints = cut(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), keep=("key",), size=size))
    classes = prints.groupBy("fp").agg(F.min("key").alias("low"))
    found = connected_components(linked(classes, k, block)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = cut(classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select(F.col("key").alias(key), shown, "component_id")
