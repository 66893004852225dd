"""The whole way: index a corpus, retrieve evidence for a batch of questions, evaluate."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.config import RECALL_AT, Config
from lattica.functions import text as T
from lattica.functions.metrics import exact_match, recall_at, token_f1
from lattica.operators import capsules as C
from lattica.operators import dag, entities, graph, modelled, retrieval, segmentation
from lattica.plans.checkpoints import cut
from lattica.plans.models import Cached, Completer, encode
from lattica.sources.readers import load_tables, write_tables

log = logging.getLogger("lattica")


@dataclass
class Engine:
    """Stages from DataFrame to DataFrame; ``index`` fills ``tables``, which can be written and loaded.

    With a ``completer``, it reads capsules out of passages, judges pairs of capsules, takes questions apart and reranks
    documents; without one, sentences serve as capsules and sub-questions, and only equal texts entail each other.
    """

    config: Config = field(default_factory=Config)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    completer: Completer | Cached | None = None
    stages: dict[str, float] = field(default_factory=dict)

    def _made(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, materialised; the seconds that it took are kept under the stage's name."""
        began = time.monotonic()
        done = cut(df)
        self.stages[name] = round(time.monotonic() - began, 3)
        log.info("%s: %.1f s", name, self.stages[name])
        return done

    def _vectors(self, df: DataFrame, key: str, text: str, instruction: str = "") -> DataFrame:
        return encode(df, key, text, self.config.embedder, self.config.dim, instruction)

    def index(self, corpus: DataFrame, mentions: bool = True, similar: bool = True) -> Engine:
        """``corpus`` as made by ``segmentation.corpus``. Tables that several later stages read are materialised once.

        Similarity edges are a search of every capsule among all, the square of the corpus. Without ``similar`` they are left to
        ``retrieve``, which finds those that its questions can meet; what it gives is the same.
        """
        c = self.config
        passages = self._made("passages", segmentation.passages(corpus, c))
        if self.completer is not None:
            capsules = self._made("capsules", modelled.model_capsules(passages, self.completer, c))
        else:
            capsules = self._made("capsules", segmentation.sentence_capsules(passages, c, mentions))
        surfaces = entities.surface_counts(capsules, corpus.select("title"), c)
        ents = self._made("entities", entities.entities(entities.entity_clusters(surfaces, c)))
        attached = entities.attach_entities(capsules, entities.alias_index(ents))
        capsules = self._made("capsule vectors", attached.join(self._vectors(capsules, "capsule_id", "text"), "capsule_id"))
        clusters = self._made("clusters", C.capsule_clusters(capsules, c))
        canonical = C.canonical_capsules(capsules, clusters)
        canonical = self._made("canonical", canonical.join(C.centroids(capsules, clusters), "cluster").drop("cluster"))
        edges = graph.evidence_edges(passages, canonical, retrieval.sim_edges(canonical, c) if similar else None, c)
        entailed = modelled.entailment_edges(canonical, self.completer, c)
        edges = self._made("edges", edges.unionByName(entailed.select("src", "dst", "type", "cost")))
        self.tables = {
            "docs": corpus,
            "passages": self._made("passage vectors", passages.join(self._vectors(passages, "passage_id", "text"), "passage_id")),
            "capsules": capsules,
            "entities": ents.drop("cluster"),
            "canonical": canonical,
            "edges": edges,
            "genericness": entities.title_genericness(corpus, "doc_idx").select("doc_idx", "genericness"),
            **C.struct_index(passages, canonical, ents),
        }
        return self

    def save(self, folder: str) -> None:
        write_tables(self.tables, folder, json.dumps(asdict(self.config), sort_keys=True), json.dumps(self.stages))

    def load(self, spark, folder: str) -> Engine:
        self.tables = load_tables(spark, folder)
        return self

    def retrieve(self, questions: DataFrame) -> dict[str, DataFrame]:
        """``questions`` has ``(qid long, question)``. Gives ``documents``, ``evidence``, ``assignment`` and ``coverage``.

        All questions go through every stage together, keyed by ``qid``.
        """
        c, t = self.config, self.tables
        passages, canonical = t["passages"], t["canonical"]
        if self.completer is not None:
            parts, links = modelled.question_dags(questions, self.completer, c)
            nodes = cut(dag.with_anchor(parts, questions))
            above = cut(dag.parents(nodes, links))
        else:
            nodes = cut(dag.with_anchor(dag.chain_dag(questions), questions))
            above = dag.parents(nodes)
        order = dag.topo_levels(nodes, above)
        node = F.concat_ws("|", F.col("qid").cast("string"), "gid")
        asked = nodes.select(node.alias("node"), "question")
        vectors = cut(self._vectors(asked, "node", "question", c.query_instruction))
        parts = F.split("node", r"\|")
        split = lambda df: df.withColumns({"qid": parts[0].cast("long"), "gid": parts[1]}).drop("node")

        near = split(retrieval.dense_topk(passages, "passage_id", vectors, "node", c.retrieval_top_k, c)).drop("rank")
        near = cut(near.join(passages.select("passage_id", "doc_idx"), "passage_id"))
        by_group = cut(split(retrieval.dense_topk(passages, "passage_id", vectors, "node", c.retrieval_top_k, c, owner="doc_idx")).drop("rank"))
        by_question = cut(retrieval.best_per_doc(by_group, ["qid"]))
        fused = graph.rrf(by_group, ["qid", "gid"], "doc_idx", "sim", c.rrf_k, c.rrf_pool).groupBy("qid", "doc_idx").agg(F.sum("rrf").alias("rrf"))

        cands = split(retrieval.dense_topk(canonical, "canonical_id", vectors, "node", c.subq_top_capsule, c)).drop("rank")
        names = entities.alias_index(t["entities"])
        wanted = nodes.select("qid", "gid", F.explode(T.entity_mentions("question")).alias("m")).select("qid", "gid", T.normalize_entity("m").alias("norm")).join(names, "norm")
        asked_entities = wanted.groupBy("qid", "gid").agg(F.collect_set("entity_id").alias("asked"))
        shown = canonical.select("canonical_id", "entity_ids", "doc_idxs", "passage_ids")
        cands = cut(retrieval.prizes(cands, shown, asked_entities, c))

        edges, left_out = t["edges"], t["edges"].where("type = 'sim'").isEmpty()
        if left_out and (c.allow_sim or c.neighbor_expand_sim_top_m):
            edges, left_out = edges.unionByName(graph.sim_rows(retrieval.sim_edges(canonical, c), c)), False
        adjacency = cut(graph.both_ways(edges).withColumn("strength", graph.edge_strength(F.col("type"), F.col("cost"), c)))
        many = nodes.groupBy("qid").count().where(F.col("count") >= c.ppr_min_groups).select("qid")
        seeds = cands.where(F.col("rank") <= c.ppr_seed_per_group).select("qid", F.concat(F.lit("C:"), "canonical_id").alias("seed"), F.lit(2.0).alias("weight"))
        seeds = seeds.unionByName(wanted.select("qid", F.concat(F.lit("E:"), "entity_id").alias("seed"), F.lit(1.0).alias("weight")).distinct()).join(many, "qid")
        # propagation neither follows edges without strength nor reaches nodes by them
        nodes_ = cut(graph.induce(seeds, adjacency.where("strength > 0"), c))
        walked = graph.mini_ppr(seeds, nodes_, adjacency, c).withColumn("kind", F.substring("node", 1, 1))
        walked = cut(graph.propagated_ranks(walked, c))
        cands = cut(retrieval.boosted(cands, walked.where("kind = 'C'").select("qid", F.col("id").alias("canonical_id"), "rrf"), c))
        chosen = cut(retrieval.beam_assign(cands, order, above, c))

        kept = cands.where(F.col("rank") <= c.seed_top_s).select("qid", "gid", "canonical_id").unionByName(chosen.where("canonical_id IS NOT NULL").select("qid", "gid", "canonical_id")).distinct()
        ways = adjacency.select("src", "dst", "type", "cost")
        if left_out:  # both ends of an edge that a way can take are among these, and one end has the other near
            met = cut(modelled.way_capsules(cands, c).select("canonical_id").distinct())
            ways = ways.unionByName(graph.both_ways(graph.sim_rows(cut(retrieval.sim_edges(canonical, c, met)), c)))
        paths = cut(modelled.connected(chosen, above, cands, shown, ways, c))
        on_way = paths.select("qid", F.explode("path").alias("n")).where(F.col("n").startswith("C:")).select("qid", F.substring("n", 3, 100).alias("canonical_id"))
        best_prize = cands.groupBy("qid", "canonical_id").agg(F.max("prize").alias("prize"))
        touched = kept.select("qid", "canonical_id").unionByName(on_way).distinct().join(best_prize, ["qid", "canonical_id"], "left").join(shown, "canonical_id")
        touched = touched.withColumn("prize", F.coalesce("prize", F.lit(0.0)))
        capsule = touched.select("qid", "prize", F.explode("doc_idxs").alias("doc_idx")).groupBy("qid", "doc_idx").agg(F.max("prize").alias("prize"))
        entity = touched.select("qid", "prize", F.explode("entity_ids").alias("entity_id")).groupBy("qid", "entity_id").agg(F.max("prize").alias("score"))
        entity = entity.join(t["entities"].select("entity_id", T.normalize_entity("canonical_name").alias("norm")), "entity_id")
        propagated = walked.where("kind = 'D'").select("qid", F.col("id").cast("long").alias("doc_idx"), "rrf")

        titles = retrieval.title_index(t["docs"])
        scores = retrieval.doc_scores(by_question, capsule, fused, propagated, c)
        scores = retrieval.title_jump(scores, entity, titles, t["genericness"], c)
        scores = retrieval.generic_penalty(scores, t["genericness"], c)
        scores = cut(retrieval.mention_jump(cut(scores), by_question, passages, titles, t["genericness"], c))
        group_docs = by_group.withColumn("r", F.row_number().over(Window.partitionBy("qid", "gid").orderBy(F.desc("sim"), "doc_idx"))).where(F.col("r") <= 15)
        covers = kept.join(shown, "canonical_id").select("qid", "gid", F.explode("doc_idxs").alias("doc_idx")).unionByName(group_docs.select("qid", "gid", "doc_idx"))
        ranked = cut(retrieval.diversified(scores, covers, c))
        if self.completer is not None:
            chosen_docs = modelled.reranked(ranked, questions, by_question, passages, t["docs"], self.completer, c)
            ranked = cut(retrieval.apply_rerank(ranked, chosen_docs, c))
        documents = retrieval.retrieved(ranked, by_question, c)

        dense = near.groupBy("qid", "passage_id", "doc_idx").agg(F.max("sim").alias("dense"))
        asked_by = split(vectors).select("qid", "embedding")
        pooled = ranked.where(F.col("rank") <= c.pool_docs).select("qid", "doc_idx").join(passages.select("passage_id", "doc_idx"), "doc_idx")
        per_doc = retrieval.dense_scores(pooled, passages, asked_by).join(passages.select("passage_id", "doc_idx"), "passage_id")
        per_doc = per_doc.withColumn("r", F.row_number().over(Window.partitionBy("qid", "doc_idx").orderBy(F.desc("dense"), "passage_id"))).where(F.col("r") <= c.pool_per_doc)
        held = kept.join(shown, "canonical_id").select("qid", "gid", "canonical_id", F.explode("passage_ids").alias("passage_id"))
        anchor = dense.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("dense"), "passage_id"))).where(F.col("r") <= 120)
        pool = retrieval.evidence_pool([("documents", per_doc), ("provenance", held), ("dense", anchor), ("walk", walked.where((F.col("kind") == "P") & (F.col("rank") <= c.pool_ppr_passages)).select("qid", F.col("id").alias("passage_id")))])
        pool = pool.join(passages.select("passage_id", "doc_idx", F.col("token_count").alias("tokens")), "passage_id").join(retrieval.dense_scores(pool, passages, asked_by), ["qid", "passage_id"], "left")
        pool = pool.withColumn("dense", F.coalesce("dense", F.lit(0.0)))
        hits = held.join(cands.select("qid", "gid", "canonical_id", "prize"), ["qid", "gid", "canonical_id"]).groupBy("qid", "gid", "passage_id").agg(F.max("prize").alias("hit"))
        weights = dag.leaves(nodes, above).select("qid", "gid", F.lit(c.leaf_weight).alias("weight"))
        first = ranked.where(F.col("rank") <= 2).join(by_question.select("qid", "doc_idx", "passage_id"), ["qid", "doc_idx"]).select("qid", "passage_id", F.col("rank").alias("pos"))
        packed = cut(retrieval.pack_evidence(pool, hits, weights, first, c))
        evidence = cut(retrieval.with_fallback(packed, ranked, by_question, dense, passages, c))
        top = cands.where(F.col("rank") <= 5).join(shown.select("canonical_id", F.col("passage_ids").alias("ps")), "canonical_id").select("qid", "gid", F.explode("ps").alias("passage_id"))
        return {"documents": documents, "evidence": evidence, "assignment": chosen, "coverage": retrieval.coverage(evidence, top), "paths": paths}

    def rag_qa(self, questions: DataFrame, golds: DataFrame | None = None) -> dict[str, DataFrame]:
        """What ``retrieve`` gives, ``answers`` (``qid, prediction, raw``), and with ``golds`` (``qid, golds array<string>``)
        ``metrics``: exact match, F1, mean coverage, mean evidence tokens and seconds a question. Needs a completer."""
        if self.completer is None:
            raise ValueError("answers need a completer")
        began, asked = time.monotonic(), questions.count()
        got = self.retrieve(questions)
        answers = cut(modelled.answers(questions, got["evidence"], self.tables["passages"], self.completer))
        got["answers"] = answers
        if golds is not None:
            spent = got["evidence"].groupBy("qid").agg(F.sum("token_count").alias("tokens"))
            rows = golds.join(answers, "qid", "left").join(got["coverage"], "qid", "left").join(spent, "qid", "left")
            got["metrics"] = rows.agg(
                F.avg(exact_match(F.coalesce("prediction", F.lit("")), "golds")).alias("em"),
                F.avg(token_f1(F.coalesce("prediction", F.lit("")), "golds")).alias("f1"),
                F.avg(F.coalesce("coverage", F.lit(0.0))).alias("coverage"),
                F.avg(F.coalesce("tokens", F.lit(0))).cast("int").alias("evidence_tokens"),
                F.lit(round((time.monotonic() - began) / max(1, asked), 4)).alias("latency_avg_s"),
            )
        return got

    def evaluate(self, documents: DataFrame, gold: DataFrame) -> DataFrame:
        """Mean recall at the usual cut-offs; ``gold`` has ``(qid, doc_idx)``."""
        lists = documents.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_idx"))), lambda x: x["doc_idx"]).alias("got"))
        wanted = gold.groupBy("qid").agg(F.collect_set("doc_idx").alias("gold"))
        met = wanted.join(lists, "qid", "left").withColumn("got", F.coalesce("got", F.array().cast("array<bigint>")))
        return met.agg(*[F.round(F.avg(recall_at("got", "gold", k)), 4).alias(f"recall_{k}") for k in RECALL_AT])
