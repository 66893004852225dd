"""Canonical capsules: similarity join on shared entities, components, representatives, centroids; inverted views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.config import Config
from lattica.functions import json_text as J
from lattica.functions.vectors import l2_normalize
from lattica.operators.blocks import deal, doubt, exact_dots, groups, together
from lattica.operators.components import connected_components
from lattica.plans.checkpoints import cut


#: Capsules that meet in one block, about.
BLOCK = 4096


def _close(batches: Iterator[pa.RecordBatch], config: Config) -> Iterator[pa.RecordBatch]:
    """``(a, b, sim)`` of each block: equal polarity, and similar enough for their predicates."""
    for block in groups(batches, 4):
        block = block.combine_chunks()
        x = np.asarray(block.column("embedding").combine_chunks().flatten(), np.float64).reshape(block.num_rows, -1)
        ids = np.asarray(block.column("capsule_id").to_pylist())
        part, polarity, predicate = (block.column(c).to_numpy() for c in ("part_own", "polarity", "predicate"))
        across = block.column("part_lo")[0].as_py() != block.column("part_hi")[0].as_py()
        slack = doubt(x)
        for at in range(0, len(x), 512):
            here = slice(at, at + 512)
            sim = x[here] @ x.T
            same = (predicate[here, None] == predicate) | (predicate[here, None] == 0) | (predicate == 0)
            least = np.where(same, config.merge_threshold, config.predicate_free_threshold)
            ok = (sim >= least - slack) & (polarity[here, None] == polarity) & (ids[here, None] < ids)
            if across:
                ok &= part[here, None] != part
            i, j = np.nonzero(ok)
            sure = exact_dots(x, i + at, j)  # the sums decide, as in SQL, and are not rounded twice
            some = sure >= least[i, j]
            i, j, sure = i[some], j[some], sure[some]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + at]), pa.array(ids[j]), pa.array(sure)], names=["a", "b", "sim"])


def similar_pairs(capsules: DataFrame, config: Config = Config(), block: int = BLOCK) -> DataFrame:
    """``(a, b, sim)`` with ``a < b``: capsules that share an entity, agree in polarity and are similar enough.

    A merge needs a shared entity, so capsules meet by entity. The capsules of a common entity are dealt out as blocks of
    bounded size, which are compared as matrices; only similar pairs leave a block, each once. Different predicates
    need a higher similarity. With ``neighbor_limit`` only pairs among the nearest of the first one stay.
    """
    name = lambda c: F.when(F.col(c) == "", F.lit(0)).otherwise(F.xxhash64(c)).cast("long").alias(c)
    rows = capsules.select(F.explode("entity_ids").alias("entity"), "capsule_id", name("polarity"), name("predicate"), F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = rows.withColumns({"at": F.xxhash64("entity"), "at2": F.xxhash64(F.lit(5), "entity")})
    keys = ["at", "at2", "part_lo", "part_hi"]
    dealt = deal(keyed, keys[:2], "capsule_id", block).select(*keys, "part_own", "capsule_id", "polarity", "predicate", "embedding")
    out = together(dealt, keys).mapInArrow(lambda b: _close(b, config), "a string, b string, sim double").dropDuplicates(["a", "b"])
    if config.neighbor_limit:
        near = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        out = out.withColumn("r", F.row_number().over(near)).where(F.col("r") <= config.neighbor_limit).drop("r")
    return out


def copies(capsules: DataFrame) -> DataFrame:
    """``(capsule_id, copy_of)``: capsules equal in text, predicate, polarity and entities, tied to the smallest."""
    keys = ["text", "predicate", "polarity", F.array_join("entity_ids", ",").alias("ents")]
    named = capsules.where(F.size("entity_ids") > 0).select("capsule_id", *keys)
    first = named.groupBy("text", "predicate", "polarity", "ents").agg(F.min("capsule_id").alias("copy_of"))
    return named.join(first, ["text", "predicate", "polarity", "ents"]).select("capsule_id", "copy_of")


def capsule_clusters(capsules: DataFrame, config: Config = Config()) -> DataFrame:
    """``(capsule_id, cluster)``: components of similar pairs; cluster is the smallest member. Without ``merge_capsules`` each is its own."""
    if not config.merge_capsules:
        return capsules.select("capsule_id", F.col("capsule_id").alias("cluster"))
    tied = copies(capsules)
    firsts = capsules.join(tied.where(F.col("capsule_id") == F.col("copy_of")), "capsule_id", "left_semi")
    pairs = similar_pairs(firsts, config).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    edges = pairs.unionByName(tied.select(F.col("capsule_id").alias("src"), F.col("copy_of").alias("dst")))
    parts = connected_components(edges)
    return capsules.join(parts, capsules["capsule_id"] == parts["node"], "left").select("capsule_id", F.coalesce("component", "capsule_id").alias("cluster"))


def canonical_capsules(capsules: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(canonical_id, text, predicate, polarity, arguments, entity_ids, provenance, num_provenance, doc_idxs, passage_ids, member_ids, freq, cluster)``.

    Numbers follow the smallest member. The member with the most provenance represents a cluster, of several the one with the
    smallest id; provenance is distinct by place and in its order.
    """
    rows = capsules.join(clusters, "capsule_id")
    listed = F.col("provenance") if dict(capsules.dtypes)["provenance"].startswith("array") else F.array("provenance")
    rows = rows.withColumn("places", J.distinct_provenance(listed))
    order = F.struct(-F.size("places"), F.col("capsule_id"))
    grouped = rows.groupBy("cluster").agg(
        F.min_by(F.struct("text", "predicate", "polarity", "arguments"), order).alias("first"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("entity_ids")))).alias("entity_ids"),
        J.distinct_provenance(F.flatten(F.collect_list("places"))).alias("provenance"),
        F.sort_array(F.collect_set("doc_idx")).alias("doc_idxs"),
        F.sort_array(F.collect_set("passage_id")).alias("passage_ids"),
        F.sort_array(F.collect_set("capsule_id")).alias("member_ids"),
        F.count("*").alias("freq"),
    )
    # a cluster is named after a capsule number, so the order of numbers needs no window over all clusters
    number = F.substring("cluster", 3, 8).cast("int")
    return grouped.select(
        F.format_string("CC_%07d", number).alias("canonical_id"),
        "first.*",
        "entity_ids",
        "provenance",
        F.size("provenance").cast("long").alias("num_provenance"),
        "doc_idxs",
        "passage_ids",
        "member_ids",
        "freq",
        "cluster",
    )


def centroids(capsules: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(cluster, embedding)``: normalised mean vectors, summed by dimension before they are put together.

    The one member of a cluster is its mean, so only the vectors of larger clusters are taken apart.
    """
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = capsules.select("capsule_id", "embedding").join(cut(clusters.join(sizes, "cluster")), "capsule_id")
    alone = rows.where("n = 1").select("cluster", F.col("embedding").cast("array<double>").alias("v"))
    each = rows.where("n > 1").select("cluster", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    dense = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    both = alone.unionByName(means.groupBy("cluster").agg(dense.alias("v")))
    return both.select("cluster", l2_normalize("v").alias("embedding"))


def struct_index(passages: DataFrame, canonical: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The six inverted views; values are distinct and sorted."""
    def view(df, key, value):
        return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(value + "s"))

    by_passage = canonical.select("canonical_id", F.explode("passage_ids").alias("passage_id"))
    by_entity = canonical.select("canonical_id", F.explode("entity_ids").alias("entity_id"))
    return {
        "doc_to_passages": view(passages, "doc_idx", "passage_id"),
        "passage_to_doc": passages.select("passage_id", "doc_idx").distinct(),
        "passage_to_canonical": view(by_passage, "passage_id", "canonical_id"),
        "canonical_to_passages": view(by_passage, "canonical_id", "passage_id"),
        "entity_to_canonical": view(by_entity, "entity_id", "canonical_id"),
        "alias_to_entity": view(entities.select("entity_id", F.explode("aliases").alias("alias")), "alias", "entity_id"),
    }
