"""The typed evidence graph: edges, strengths, neighbourhoods, personalised propagation, rank fusion, paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.config import TYPE_WEIGHTS, Config
from lattica.operators.blocks import BLOCK, deal, doubt, exact_dots, groups, meetings, together
from lattica.plans.checkpoints import cut


def evidence_edges(passages: DataFrame, canonical: DataFrame, sim: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """``(src, dst, type, cost)``, undirected, each once: passages in documents, capsules in passages, mentions, similarity."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    in_doc = passages.select(node("P", "passage_id").alias("src"), node("D", "doc_idx").alias("dst"), F.lit("in_doc").alias("type"), F.lit(config.cost_in_doc).alias("cost"))
    in_passage = canonical.select("canonical_id", F.explode("passage_ids").alias("p"))
    in_passage = in_passage.select(node("C", "canonical_id").alias("src"), node("P", "p").alias("dst"), F.lit("in_passage").alias("type"), F.lit(config.cost_in_passage).alias("cost"))
    mentions = canonical.select("canonical_id", F.explode("entity_ids").alias("e"))
    mentions = mentions.select(node("C", "canonical_id").alias("src"), node("E", "e").alias("dst"), F.lit("mentions").alias("type"), F.lit(config.cost_mentions).alias("cost"))
    edges = in_doc.unionByName(in_passage).unionByName(mentions)
    if sim is not None:
        edges = edges.unionByName(sim_rows(sim, config))
    return edges.dropDuplicates(["src", "dst", "type"])


def sim_rows(sim: DataFrame, config: Config = Config()) -> DataFrame:
    """Pairs ``(src, dst, sim)`` as edges."""
    return sim.select("src", "dst", F.lit("sim").alias("type"), F.lit(config.cost_sim).alias("cost"))


def _nearest(batches: Iterator[pa.RecordBatch], k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """``(a, b, sim)`` of each block: for each of its rows the ``k`` nearest similar ones that it meets there, ties by key.

    A matrix product finds them with some to spare, exact sums decide. Of equal vectors only the first ``k + 1`` can be near to any.
    """
    for block in groups(batches, 5):
        block = block.combine_chunks()
        size = block.column("size")[0].as_py()
        keys = block.column("key").to_numpy()
        turn = np.argsort(keys, kind="stable")
        names, part = block.column("key").take(pa.array(turn)).combine_chunks(), block.column("part_own").to_numpy()[turn]
        keys = np.unique(keys[turn], return_inverse=True)[1]
        x = np.asarray(block.column("vector").combine_chunks().flatten(), np.float64).reshape(-1, size)[turn]
        x += 0.0  # one zero
        lo, hi = (block.column(c)[0].as_py() for c in ("part_lo", "part_hi"))
        kinds: dict[tuple, int] = {}
        first = np.zeros(len(x), bool)
        for r in range(len(x)):
            kind = (part[r], x[r].tobytes())
            kinds[kind] = kinds.get(kind, 0) + 1
            first[r] = kinds[kind] <= k + 1
        everyone = np.arange(len(x))
        sides = [(everyone, everyone)] if lo == hi else [(everyone[part == lo], everyone[part == hi]), (everyone[part == hi], everyone[part == lo])]
        slack = doubt(x)
        for rows, columns in (m for r, c in sides for m in meetings(r, c[first[c]])):
            sim = x[rows] @ x[columns].T
            sim[np.isnan(sim)] = np.inf
            sim[keys[rows, None] == keys[columns]] = -np.inf
            least = np.full(len(rows), threshold)
            if len(columns) > k:
                least = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k])
            i, j = np.nonzero(sim >= (least - slack)[:, None])
            i, j = rows[i], columns[j]
            sure = exact_dots(x, i, j)
            near = ~(sure < threshold)
            i, j, sure = i[near], j[near], sure[near]
            turn = np.lexsort((j, np.where(np.isnan(sure), -np.inf, -sure), i))
            i, j, sure = i[turn], j[turn], sure[turn]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            some = np.flatnonzero(np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < k)
            if len(some):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i[some])), names.take(pa.array(j[some])), pa.array(sure[some])], names=["a", "b", "sim"])


def knn_edges(vectors: DataFrame, key: str, vector: str, block: str, k: int, threshold: float, most: int = BLOCK) -> DataFrame:
    """``(src, dst, sim)``: unordered pairs inside a block that are among either one's ``k`` nearest and similar enough.

    The vectors of a block meet as matrices in groups of at most ``most`` rows; only each row's nearest of a group leave it.
    Keys, blocks and vectors that are null or hold a null link with nothing, nor do vectors of different length.
    """
    whole = F.forall("vector", lambda v: v.isNotNull())
    rows = vectors.select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("block").isNotNull() & F.col("key").isNotNull() & whole)
    keys = ["at", "at2", "size", "part_lo", "part_hi"]
    keyed = rows.select(F.xxhash64("block").alias("at"), F.xxhash64(F.lit(5), "block").alias("at2"), F.size("vector").alias("size"), "key", "vector")
    dealt = together(deal(keyed, keys[:3], "key", most).select(*keys, "part_own", "key", "vector"), keys)
    kind = dict(rows.dtypes)["key"]
    near = dealt.mapInArrow(lambda b: _nearest(b, k, threshold), f"a {kind}, b {kind}, sim double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    kept = near.withColumn("r", rank).where(F.col("r") <= k)
    return kept.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "sim").dropDuplicates(["src", "dst"])


def edge_strength(type_: Column, cost: Column, config: Config = Config()) -> Column:
    """Type weight over cost; 0 for types that propagation does not follow."""
    weight = F.lit(0.0)
    for name, w in TYPE_WEIGHTS.items():
        allowed = w > 0 and (name != "sim" or config.allow_sim)
        weight = F.when(type_ == name, w if allowed else 0.0).otherwise(weight)
    return weight / (config.strength_eps + F.greatest(F.lit(0.0), cost))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def induce(seeds: DataFrame, adjacency: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, node, depth)`` within ``hops`` of a question's seeds; the nearest nodes first, then by name, up to the cap ``max_nodes`` (0: all)."""
    reached = seeds.select("qid", F.col("seed").alias("node")).distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for depth in range(1, config.hops + 1):
        step = frontier.join(adjacency.select("src", "dst"), F.col("node") == F.col("src")).select("qid", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(reached, ["qid", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(frontier)
    if not config.max_nodes:
        return reached
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("depth", "node"))
    return reached.withColumn("r", rank).where(F.col("r") <= config.max_nodes).drop("r")


def mini_ppr(seeds: DataFrame, nodes: DataFrame, adjacency: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, node, score)`` after a fixed number of steps; mass of nodes without a way out goes back to the seeds.

    ``seeds`` has ``(qid, seed, weight)``, repeated seeds add up; without a seed among the nodes all nodes are seeds.
    ``adjacency`` has both directions and ``strength``; parallel edges add. Each step is one equi join and one sum,
    keyed by question and node, and every few steps the lineage is cut.
    """
    s = seeds.groupBy("qid", F.col("seed").alias("node")).agg(F.sum("weight").alias("w"))
    s = nodes.select("qid", "node").join(s, ["qid", "node"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = s.groupBy("qid").agg(F.sum("w").alias("t"), F.count("*").alias("n"))
    s = cut(s.join(total, "qid").select("qid", "node", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1 / F.col("n")).alias("s")))
    inside = nodes.select("qid", F.col("node").alias("src")).join(adjacency.where(F.col("strength") > 0), "src")
    inside = inside.join(nodes.select("qid", F.col("node").alias("dst")), ["qid", "dst"], "left_semi")
    out = inside.groupBy("qid", "src", "dst").agg(F.sum("strength").alias("k"))
    sums = out.groupBy("qid", "src").agg(F.sum("k").alias("all"))
    moves = cut(out.join(sums, ["qid", "src"]).select("qid", F.col("src").alias("node"), "dst", (F.col("k") / F.col("all")).alias("p")))
    stuck = cut(s.select("qid", "node").join(moves.select("qid", "node").distinct(), ["qid", "node"], "left_anti"))
    now = s.select("qid", "node", F.col("s").alias("score"))
    for step in range(config.steps):
        flow = now.join(moves, ["qid", "node"]).groupBy("qid", F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("p")).alias("f"))
        lost = now.join(stuck, ["qid", "node"]).groupBy("qid").agg(F.sum("score").alias("d"))
        mixed = s.join(flow, ["qid", "node"], "left").join(lost, "qid", "left")
        f, d = F.coalesce("f", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
        now = mixed.select("qid", "node", ((1 - config.alpha) * F.col("s") + config.alpha * (f + d * F.col("s"))).alias("score"))
        if step % 3 == 2 or step == config.steps - 1:
            now = cut(now)
    return now


def rrf(scores: DataFrame, keys: list[str], node: str, score: str, k: int, pool: int) -> DataFrame:
    """Reciprocal ranks ``1 / (k + rank)`` of the first ``pool`` rows of each list."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), node))
    return scores.withColumn("rank", rank).where(F.col("rank") <= pool).withColumn("rrf", 1.0 / (k + F.col("rank")))


def propagated_ranks(walked: DataFrame, config: Config = Config()) -> DataFrame:
    """``walked`` (``qid, kind, node, score``) with ``rank``, ``rrf`` and ``id``: the first ``ppr_rrf_pool`` nodes of each kind."""
    return rrf(walked, ["qid", "kind"], "node", "score", config.rrf_k, config.ppr_rrf_pool).withColumn("id", F.substring("node", 3, 100))


def shortest_paths(sources: DataFrame, adjacency: DataFrame, nodes: DataFrame, rounds: int = 6) -> DataFrame:
    """``(qid, source, node, cost, path)``: cheapest paths of up to ``rounds`` edges inside a question's nodes.

    Bounded relaxation: each round extends what improved in the round before; ties go to the path that sorts first.
    """
    inside = nodes.select(F.col("qid").alias("q"), F.col("node").alias("src")).join(adjacency.select("src", "dst", "cost"), "src")
    inside = inside.join(nodes.select(F.col("qid").alias("q"), F.col("node").alias("dst")), ["q", "dst"], "left_semi")
    inside = cut(inside.groupBy("q", "src", "dst").agg(F.min("cost").alias("step")))
    best = sources.select("qid", "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"), F.array("source").alias("path"))
    moved = best
    for _ in range(rounds):
        more = moved.join(inside, (F.col("qid") == F.col("q")) & (F.col("node") == F.col("src"))).select(
            "qid", "source", F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("dst")).alias("path")
        )
        both = best.withColumn("old", F.lit(0)).unionByName(more.withColumn("old", F.lit(1)))
        pick = both.groupBy("qid", "source", "node").agg(F.min(F.struct(F.round("cost", 9).alias("c"), "old", "path", "cost")).alias("x"))
        best = cut(pick.select("qid", "source", "node", "x.cost", "x.path", F.col("x.old").alias("new")))
        moved, best = best.where("new = 1").drop("new"), best.drop("new")
    return best
