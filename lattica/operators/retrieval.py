"""Dense candidates, prizes, assignment along the question graph, document scores and order, evidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.config import Config
from lattica.functions import text as T
from lattica.functions.vectors import dot


def _best(who: np.ndarray, item: np.ndarray, sim: np.ndarray, owner: np.ndarray | None, k: int) -> np.ndarray:
    """Places of each query's ``k`` best items, or of the ``k`` best owners' best items; ties to the smaller one."""
    turn = np.lexsort((np.unique(item, return_inverse=True)[1], -sim, who))
    if owner is not None:
        turn = turn[np.sort(np.unique(np.stack([who[turn], owner[turn]]), axis=1, return_index=True)[1])]
        turn = turn[np.lexsort((owner[turn], -sim[turn], who[turn]))]
    starts = np.flatnonzero(np.diff(who[turn], prepend=-1))
    place = np.arange(len(turn)) - np.repeat(starts, np.diff(np.append(starts, len(turn))))
    return turn[place < k]


def dense_topk(items: DataFrame, item: str, queries: DataFrame, query: str, k: int, config: Config = Config(), vector: str = "embedding", owner: str | None = None) -> DataFrame:
    """``(query, item, sim, rank)``: the ``k`` items with the greatest inner product for each query, ties by item.

    With ``owner`` (an integer column of the items), ``(query, owner, item, sim, rank)``: the ``k`` owners whose best item
    has the greatest product, ties by owner, each with that item.

    Items are never moved: every Arrow batch is multiplied with the queries' matrix, each task keeps its running ``k`` best
    of a query (what is below the last of them goes at once), and only those are ranked. The matrix is sent to the executors in blocks of a checked size, one pass for each.
    """
    rows = queries.select(query, vector).orderBy(query).toLocalIterator()
    schema = f"{query} {dict(queries.dtypes)[query]}, {item} {dict(items.dtypes)[item]}, sim double" + (f", {owner} {dict(items.dtypes)[owner]}" if owner else "")
    kept, block = None, []

    def scan(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], np.float64)
        shared = items.sparkSession.sparkContext.broadcast((ids, matrix))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            held: list[tuple] = []
            floor, fresh = np.full(len(ids), -np.inf), 0  # each query's k-th best so far: nothing below it can be among its best
            step = max(32, min(1024, (1 << 19) // max(1, len(ids))))

            def fold() -> None:
                who, what, sim, own = (None if held[0][i] is None else np.concatenate([h[i] for h in held]) for i in range(4))
                top = _best(who, what, sim, own, k)
                held[:] = [(who[top], what[top], sim[top], None if own is None else own[top])]
                n = np.bincount(who[top], minlength=len(ids))
                floor[n == k] = sim[top][np.cumsum(n)[n == k] - 1]

            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                    sim = np.round(x @ q.T, 9)
                    some = sim >= floor
                    if not owner and len(sim) > k and np.count_nonzero(some) > k * len(ids):
                        some &= sim >= np.partition(sim, -k, axis=0)[-k]
                    rows, who = np.nonzero(some)
                    if not len(rows):
                        continue
                    names = np.asarray(part.column(0).to_pylist())
                    held.append((who, names[rows], sim[rows, who], np.asarray(part.column(2))[rows] if owner else None))
                    fresh += len(rows)
                    if fresh >= max(k * len(ids), 1 << 12):
                        fold()
                        fresh = 0
            if held:
                fold()
                who, what, sim, own = held[0]
                out = [pa.array([ids[i] for i in who.tolist()]), pa.array(what.tolist()), pa.array(sim)]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(own)] if owner else []), names=[query, item, "sim"] + ([owner] if owner else []))

        return items.select(item, vector, *([owner] if owner else [])).mapInArrow(best, schema)

    for r in rows:
        block.append(r)
        if len(block) == config.max_questions:
            kept, block = scan(block) if kept is None else kept.unionByName(scan(block)), []
    if block or kept is None:
        last = scan(block) if block else items.sparkSession.createDataFrame([], schema)
        kept = last if kept is None else kept.unionByName(last)
    if owner:
        first = F.row_number().over(Window.partitionBy(query, owner).orderBy(F.desc("sim"), item))
        kept = kept.withColumn("rank", first).where("rank = 1")
        item = owner
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("sim"), item))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def sim_edges(canonical: DataFrame, config: Config = Config(), among: DataFrame | None = None) -> DataFrame:
    """``(src, dst, sim)``: unordered pairs of capsule nodes of which one is among the other's nearest and similar enough.

    As in the engine that is followed, a capsule counts among its own ``sim_edge_topk`` nearest. With ``among``
    (``canonical_id``), only the pairs of two of these; their nearest are still sought among all.
    """
    if among is not None:
        asked = canonical.join(among.select("canonical_id"), "canonical_id", "left_semi").select(F.col("canonical_id").alias("other"), "embedding")
    else:
        asked = canonical.select(F.col("canonical_id").alias("other"), "embedding")
    near = dense_topk(canonical, "canonical_id", asked, "other", config.sim_edge_topk, config)
    near = near.where((F.col("other") != F.col("canonical_id")) & (F.col("sim") >= config.sim_edge_threshold))
    if among is not None:
        near = near.join(among.select("canonical_id"), "canonical_id", "left_semi")
    a, b = F.concat(F.lit("C:"), "other"), F.concat(F.lit("C:"), "canonical_id")
    return near.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "sim").dropDuplicates(["src", "dst"])


def best_per_doc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Best passage of each document: ``(*keys, doc_idx, passage_id, sim)``, the smaller passage on ties."""
    order = F.struct(F.col("sim").isNull().alias("none"), (~F.isnan("sim")).alias("real"), (-F.col("sim")).alias("less"), F.col("passage_id"))
    best = F.min_by(F.struct("passage_id", "sim"), order)
    return scores.groupBy(*keys, "doc_idx").agg(best.alias("b")).select(*keys, "doc_idx", "b.passage_id", "b.sim")


def dense_scores(wanted: DataFrame, passages: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(qid, passage_id, dense)``: each wanted passage's greatest inner product with its question's vectors ``(qid, embedding)``."""
    met = wanted.select("qid", "passage_id").distinct().join(passages.select("passage_id", F.col("embedding").alias("own")), "passage_id").join(vectors, "qid")
    return met.groupBy("qid", "passage_id").agg(F.max(F.round(dot("own", "embedding"), 9)).alias("dense"))


def prizes(candidates: DataFrame, entity_ids: DataFrame, question_entities: DataFrame, config: Config = Config()) -> DataFrame:
    """Candidates with ``prize``: similarity plus a bonus if one of the sub-question's entities is the capsule's."""
    own = candidates.join(entity_ids, "canonical_id", "left").join(question_entities, ["qid", "gid"], "left")
    match = F.coalesce(F.arrays_overlap("entity_ids", "asked"), F.lit(False))
    prize = F.col("sim") + F.when(match, config.entity_match_bonus).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("qid", "gid").orderBy(F.desc("prize"), "canonical_id"))
    return own.withColumn("prize", prize).withColumn("rank", rank).drop("asked")


def boosted(candidates: DataFrame, fused: DataFrame, config: Config = Config()) -> DataFrame:
    """Prizes raised by propagation ranks ``(qid, canonical_id, rrf)``, and ranked again."""
    raised = candidates.join(fused, ["qid", "canonical_id"], "left").withColumn("prize", F.col("prize") + config.ppr_prize_weight * F.coalesce("rrf", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("qid", "gid").orderBy(F.desc("prize"), "canonical_id"))
    return raised.withColumn("rank", rank).drop("rrf")


BEAM = "qid long, gid string, canonical_id string, score double"


def beam_assign(candidates: DataFrame, order: DataFrame, parents: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, gid, canonical_id, score)``: one capsule for each group, by beam search in the groups' order.

    A capsule's worth is its prize, plus a bonus for entities shared with the parents' choices (or a malus without any),
    plus what its documents add, less what repeats. Groups without candidates are left open (null). A question has at
    most eight groups of a few candidates, so each is one small sequential task.
    """
    top = candidates.where(F.col("rank") <= config.binding_candidates)
    folded = top.groupBy("qid", "gid").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical_id", "prize", "entity_ids", "doc_idxs"))).alias("cands"))
    above = parents.groupBy("qid", F.col("child").alias("gid")).agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    rows = order.select("qid", "gid", "level", "pos").join(folded, ["qid", "gid"], "left").join(above, ["qid", "gid"], "left")

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["level", "pos", "gid"])
        beam = [(0.0, {}, frozenset(), frozenset())]
        entities: dict[str, set] = {}
        for r in frame.itertuples():
            cands = [] if r.cands is None else list(r.cands)
            if not cands:
                beam = [(s, a | {r.gid: None}, d, c) for s, a, d, c in beam]
                continue
            for c in cands:
                entities[c["canonical_id"]] = set([] if c["entity_ids"] is None else c["entity_ids"])
            grown = []
            for score, chosen, docs, caps in beam:
                above = [entities[chosen[p]] for p in ([] if r.parents is None else r.parents) if chosen.get(p)]
                for c in cands:
                    own, worth = set([] if c["doc_idxs"] is None else c["doc_idxs"]), c["prize"]
                    if above:
                        shared = sum(len(entities[c["canonical_id"]] & x) for x in above)
                        worth += config.overlap_bonus * shared if shared else -config.no_overlap_penalty
                    worth += config.doc_diversity_bonus * len(own - docs) - config.repeat_doc_penalty * len(own & docs)
                    worth -= config.repeat_capsule_penalty * (c["canonical_id"] in caps)
                    grown.append((score + worth, chosen | {r.gid: c["canonical_id"]}, docs | own, caps | {c["canonical_id"]}))
            grown.sort(key=lambda x: (-round(x[0], 9), [str(v) for v in x[1].values()]))
            beam = grown[: config.beam]
        score, chosen, _, _ = beam[0]
        return pd.DataFrame({"qid": key[0], "gid": list(chosen), "canonical_id": list(chosen.values()), "score": score})

    return rows.groupBy("qid").applyInPandas(run, BEAM)


def doc_scores(dense: DataFrame, capsule: DataFrame, fused: DataFrame, propagated: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, doc_idx, score)``: the greater of capsule and weighted dense score, plus both reciprocal-rank signals.

    Inputs are keyed by question and document: ``dense.sim``, ``capsule.prize``, ``fused.rrf``, ``propagated.rrf``.
    """
    parts = [dense.select("qid", "doc_idx", "sim"), capsule.select("qid", "doc_idx", "prize"), fused.select("qid", "doc_idx", F.col("rrf").alias("dense_rrf")), propagated.select("qid", "doc_idx", F.col("rrf").alias("ppr_rrf"))]
    met = parts[0]
    for p in parts[1:]:
        met = met.join(p, ["qid", "doc_idx"], "full")
    zero = F.lit(0.0)
    base = F.greatest(F.coalesce("prize", zero), config.dense_weight * F.greatest(zero, F.coalesce("sim", zero)))
    return met.select("qid", "doc_idx", (base + config.rrf_weight * (F.coalesce("dense_rrf", zero) + F.coalesce("ppr_rrf", zero))).alias("score"))


def title_index(docs: DataFrame) -> DataFrame:
    """``(norm, doc_idx)``: the first document of each normalised title."""
    rows = docs.select(T.normalize_entity("title").alias("norm"), "doc_idx").where(F.col("norm") != "")
    return rows.groupBy("norm").agg(F.min("doc_idx").alias("doc_idx"))


def title_jump(scores: DataFrame, entity_scores: DataFrame, titles: DataFrame, generic: DataFrame, config: Config = Config()) -> DataFrame:
    """Scores raised for documents whose title is one of a question's strongest entities, unless it is generic."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "entity_id"))
    top = entity_scores.withColumn("r", rank).where(F.col("r") <= config.jump_top_m)
    hit = top.join(titles, "norm").join(generic.where(F.col("genericness") < config.generic_threshold), "doc_idx")
    bonus = hit.groupBy("qid", "doc_idx").agg((config.jump_bonus * F.sum("score")).alias("bonus"))
    return scores.join(bonus, ["qid", "doc_idx"], "full").select("qid", "doc_idx", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def generic_penalty(scores: DataFrame, generic: DataFrame, config: Config = Config()) -> DataFrame:
    """Scores lowered for generic titles, from the threshold on, by at most the weight."""
    over = (F.col("genericness") - config.generic_threshold) / max(1e-6, 1 - config.generic_threshold)
    malus = F.when(F.col("genericness") >= config.generic_threshold, config.generic_weight * over).otherwise(0.0)
    return scores.join(generic, "doc_idx", "left").select("qid", "doc_idx", (F.col("score") - F.coalesce(malus, F.lit(0.0))).alias("score"))


def mention_jump(scores: DataFrame, best: DataFrame, passages: DataFrame, titles: DataFrame, generic: DataFrame, config: Config = Config()) -> DataFrame:
    """Scores raised for documents whose title is mentioned in the best passages of a question's first documents.

    All bonuses come from the scores before the jump, so the result does not depend on an order of updates.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_idx"))
    seeds = scores.withColumn("r", rank).where((F.col("r") <= config.mention_from_top) & (F.col("score") > 0))
    said = seeds.join(best.select("qid", "doc_idx", "passage_id"), ["qid", "doc_idx"]).join(passages.select("passage_id", "text"), "passage_id")
    found = said.select("qid", F.col("doc_idx").alias("seed"), "score", F.explode(F.slice(T.entity_mentions("text"), 1, config.mention_top_m)).alias("mention"))
    hit = found.select("qid", "seed", "score", T.normalize_entity("mention").alias("norm")).join(titles, "norm").where(F.col("doc_idx") != F.col("seed"))
    hit = hit.join(generic.where(F.col("genericness") < config.generic_threshold), "doc_idx")
    bonus = hit.groupBy("qid", "doc_idx").agg((config.mention_bonus * F.sum("score")).alias("bonus"))
    return scores.join(bonus, ["qid", "doc_idx"], "full").select("qid", "doc_idx", (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))


def diversified(scores: DataFrame, covers: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, doc_idx, score, rank)``: the best document first, then a few that cover further groups, then by score.

    Only a question's pool (its first documents) is chosen from, one at a time, each time with one maximum per question.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_idx")
    ranked = scores.withColumn("score_rank", F.row_number().over(order))
    groups = covers.groupBy("qid", "doc_idx").agg(F.collect_set("gid").alias("gids"))
    pool = ranked.where(F.col("score_rank") <= config.diversify_pool).join(groups, ["qid", "doc_idx"], "left")
    schema = "qid long, doc_idx long, pick int"

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("score_rank")
        sets = {r.doc_idx: set([] if r.gids is None else r.gids) for r in frame.itertuples()}
        score = dict(zip(frame.doc_idx, frame.score, strict=True))
        first = frame.doc_idx.iloc[0]
        chosen, left = [first], set().union(*sets.values()) - sets[first]
        rest = [d for d in frame.doc_idx if d != first]
        while len(chosen) < config.diversify_n and left and rest:
            d = max(rest, key=lambda d: (score[d] + config.diversify_gain * len(sets[d] & left), score[d], -d))
            chosen.append(d)
            rest.remove(d)
            left -= sets[d]
        return pd.DataFrame({"qid": key[0], "doc_idx": chosen, "pick": range(len(chosen))})

    picks = pool.groupBy("qid").applyInPandas(run, schema)
    done = ranked.join(picks, ["qid", "doc_idx"], "left")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("pick", F.lit(1 << 20)), "score_rank"))
    return done.select("qid", "doc_idx", "score", rank.alias("rank"))


def apply_rerank(ranked: DataFrame, selected: DataFrame, config: Config = Config()) -> DataFrame:
    """A model's choice ``(qid, selected array<doc_idx>)`` comes first in its order, the others keep theirs."""
    chosen = selected.select("qid", F.posexplode("selected").alias("pos", "doc_idx"))
    met = ranked.join(chosen, ["qid", "doc_idx"], "left")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.coalesce("pos", F.lit(1 << 20)), "rank"))
    return met.select("qid", "doc_idx", "score", rank.alias("rank"))


def retrieved(ranked: DataFrame, dense: DataFrame, config: Config = Config()) -> DataFrame:
    """The first documents of the order, filled up with dense ones that it lacks."""
    fill = dense.join(ranked.select("qid", "doc_idx"), ["qid", "doc_idx"], "left_anti").select("qid", "doc_idx", F.col("sim").alias("score"), F.lit(1).alias("tier"), F.lit(0).alias("r"))
    both = ranked.select("qid", "doc_idx", "score", F.lit(0).alias("tier"), F.col("rank").alias("r")).unionByName(fill)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("tier", "r", F.desc("score"), "doc_idx"))
    return both.withColumn("rank", rank).where(F.col("rank") <= config.retrieval_top_k).select("qid", "doc_idx", "score", "rank")


def evidence_pool(pools: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(qid, passage_id, origin)``: the union of named pools; a passage in several is credited to the first."""
    whole = None
    for i, (name, df) in enumerate(pools):
        part = df.select("qid", "passage_id", F.struct(F.lit(i).alias("i"), F.lit(name).alias("name")).alias("o"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("qid", "passage_id").agg(F.min("o").alias("o")).select("qid", "passage_id", F.col("o.name").alias("origin"))


def pack_evidence(pool: DataFrame, hits: DataFrame, weights: DataFrame, seeds: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, passage_id, position, token_count)``: passages that cover the groups best within the token budget.

    ``pool`` has ``(qid, passage_id, doc_idx, dense, tokens)``, ``hits`` the prize that a passage holds for a group,
    ``weights`` the groups' weights, ``seeds`` passages that come first if they fit. Then the passage with the greatest
    objective is taken, again and again; a passage that does not fit is passed over. Ties go to the smallest passage.
    """
    held = hits.join(weights, ["qid", "gid"], "left").groupBy("qid", "passage_id").agg(F.collect_list(F.struct("gid", "hit", F.coalesce("weight", F.lit(1.0)).alias("weight"))).alias("hits"))
    first = seeds.groupBy("qid", "passage_id").agg(F.min("pos").alias("seed"))
    rows = pool.join(held, ["qid", "passage_id"], "left").join(first, ["qid", "passage_id"], "left")

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("passage_id")
        cands = {r.passage_id: (r.doc_idx, r.dense, int(r.tokens), [] if r.hits is None else [(h["gid"], h["hit"], h["weight"]) for h in r.hits]) for r in frame.itertuples()}
        budget = config.token_budget if config.token_budget > 0 else 10**9
        best: dict[str, float] = {}
        per_doc: dict[int, int] = {}
        out, spent = [], 0

        def take(pid: str) -> None:
            nonlocal spent
            doc, _, n, own = cands[pid]
            out.append(pid)
            spent += n
            per_doc[doc] = per_doc.get(doc, 0) + 1
            for g, h, _ in own:
                best[g] = max(best.get(g, 0.0), h)

        for r in frame[frame.seed.notna()].sort_values(["seed", "passage_id"]).itertuples():
            if len(out) < config.max_passages and spent + int(r.tokens) <= budget:
                take(r.passage_id)
        while len(out) < config.max_passages:
            free = [p for p in cands if p not in out and spent + cands[p][2] <= budget]
            if not free:
                break

            def worth(p: str) -> float:
                doc, dense, n, own = cands[p]
                gain = sum(w * max(0.0, h - best.get(g, 0.0)) for g, h, w in own)
                return round(config.evidence_dense * dense + config.evidence_gain * gain - config.same_doc_penalty * per_doc.get(doc, 0) - config.length_penalty * n, 9)

            take(max(free, key=worth))  # the first of equal ones
        return pd.DataFrame({"qid": key[0], "passage_id": out, "position": range(len(out)), "token_count": [cands[p][2] for p in out]})

    return rows.groupBy("qid").applyInPandas(run, "qid long, passage_id string, position int, token_count int")


def pack_in_order(ranked: DataFrame, config: Config = Config()) -> DataFrame:
    """``(qid, passage_id, position, token_count)``: passages in their order ``rank``, those that still fit the budget.

    What does not fit is passed over and smaller ones after it may be taken, so this is one small sequential task a question;
    ``max_passages`` times 50 candidates are looked at. ``ranked`` has ``(qid, passage_id, rank, tokens)``, repeats count once.
    """
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "passage_id"))
    once = ranked.groupBy("qid", "passage_id").agg(F.min("rank").alias("rank"), F.first("tokens").alias("tokens"))
    some = once.withColumn("place", place).where(F.col("place") <= 50 * config.max_passages)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        out, spent = [], 0
        for r in frame.sort_values("place").itertuples():
            if len(out) < config.max_passages and spent + int(r.tokens) <= config.token_budget:
                out.append((key[0], r.passage_id, len(out), int(r.tokens)))
                spent += int(r.tokens)
        return pd.DataFrame(out, columns=["qid", "passage_id", "position", "token_count"])

    return some.groupBy("qid").applyInPandas(run, "qid long, passage_id string, position int, token_count int")


def with_fallback(evidence: DataFrame, ranked: DataFrame, best: DataFrame, dense: DataFrame, passages: DataFrame, config: Config = Config()) -> DataFrame:
    """Evidence, and for questions without any the best passage of each document in order, then the nearest passages."""
    sized = passages.select("passage_id", F.col("token_count").alias("tokens"))
    left = ranked.select("qid").union(dense.select("qid")).distinct().join(evidence.select("qid"), "qid", "left_anti")
    by_doc = ranked.join(left, "qid", "left_semi").join(best.select("qid", "doc_idx", "passage_id"), ["qid", "doc_idx"]).join(sized, "passage_id")
    first = pack_in_order(by_doc.select("qid", "passage_id", F.col("rank").cast("double").alias("rank"), "tokens"), config)
    left = left.join(first.select("qid"), "qid", "left_anti")
    nearest = dense.join(left, "qid", "left_semi").join(sized, "passage_id").select("qid", "passage_id", (-F.col("dense")).alias("rank"), "tokens")
    return evidence.unionByName(first).unionByName(pack_in_order(nearest, config))


def coverage(evidence: DataFrame, top: DataFrame) -> DataFrame:
    """``(qid, coverage)``: share of groups of which one of the first capsules ``(qid, gid, passage_id)`` is in evidence."""
    groups = top.select("qid", "gid").distinct()
    met = top.join(evidence.select("qid", "passage_id"), ["qid", "passage_id"], "left_semi").select("qid", "gid").distinct().withColumn("met", F.lit(1))
    return groups.join(met, ["qid", "gid"], "left").groupBy("qid").agg(F.avg(F.coalesce("met", F.lit(0))).alias("coverage"))
