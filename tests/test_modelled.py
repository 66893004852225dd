"""Operators that ask a model, with models that are functions."""

import heapq
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from lattica.config import Config
from lattica.operators import graph, modelled, segmentation
from lattica.plans.engine import Engine


def model(f):
    return lambda prompts: pd.Series([f(p) for p in prompts], dtype=object)


def test_question_dags(spark):
    rows = [(1, "json?"), (2, "second?"), (3, "lines?"), (4, "nothing?"), (5, None)]
    questions = spark.createDataFrame(rows, "qid long, question string")

    def say(p):
        if p is None:
            return None
        nodes = '{"nodes": [{"id": "a", "question": "x?"}, {"question": "y?", "depends_on": ["a"]}, {"id": "a", "question": "again"}], "edges": [{"source": "a", "target": "q1"}]}'
        if p.endswith("json?") or (p.endswith("second?") and p.startswith("Reply")):
            return f"Sure.\n{nodes}"
        return "1. one?\n- two?" if p.endswith("lines?") and "one a line" in p else "no idea"

    nodes, edges = modelled.question_dags(questions.where("question IS NOT NULL"), model(say))
    got = {}
    for r in nodes.orderBy("qid", "pos").collect():
        got.setdefault(r["qid"], []).append((r["gid"], r["question"], r["depends_on"]))
    graph_ = [("a", "x?", []), ("q1", "y?", ["a"])]
    assert got == {1: graph_, 2: graph_, 3: [("q1", "one?", []), ("q2", "two?", ["q1"])], 4: [("q0", "nothing?", [])]}
    assert sorted(tuple(r) for r in edges.collect()) == [(1, "a", "q1"), (2, "a", "q1")]


def test_model_capsules(spark):
    docs = segmentation.corpus(spark.createDataFrame([(1, "Ann Lee met Bob Roe. It rained."), (2, "Plain words here. More words."), (3, "")], "doc_id long, text string"))

    def say(p):
        if "Ann Lee" not in p:
            return '{"capsules": []}'
        return '{"capsules": [{"predicate": " met ", "polarity": "neg", "arguments": [{"role": "arg0", "surface": "Ann Lee"}], "sent_id": 99}, {"canonical_text": "c", "sent_id": "x"},]}'

    made = modelled.model_capsules(segmentation.passages(docs), model(say)).orderBy("capsule_id")
    got = [(r["doc_idx"], r["text"], r["predicate"], r["polarity"], r["sent_id"], r["confidence"]) for r in made.collect()]
    assert sorted(got) == sorted(
        [(1, "It rained.", "met", "negated", 1, 1.0), (1, "c", "", "affirmed", 0, 1.0), (2, "Plain words here.", "sentence", "affirmed", 0, 0.0), (2, "More words.", "sentence", "affirmed", 1, 0.0)]
    )
    assert modelled.extraction_counts(made).first() == (2, 1, 1)


def test_entailment(spark):
    rows = [("1", "same", ["E1"], [1.0, 0.0]), ("2", "same", ["E1", "E2"], [1.0, 0.0]), ("3", "other", ["E2"], [0.99, 0.14]), ("4", "far", ["E1"], [0.0, 1.0]), ("5", "same", [], [1.0, 0.0]), ("6", "not so", ["E2"], [1.0, 0.0])]
    canonical = spark.createDataFrame(rows, "canonical_id string, text string, entity_ids array<string>, embedding array<double>")
    say = model(lambda p: '{"label": "contradicts", "confidence": 0.5}' if "not so" in p and "same" in p else ('{"label": "Entails"}' if "not so" in p else "?"))
    shown = lambda df: sorted((r["src"], r["dst"], r["type"], r["cost"], r["label"], r["confidence"]) for r in df.collect())
    same = ("C:1", "C:2", "entails", 0.1, "equivalent", 1.0)
    assert shown(modelled.entailment_edges(canonical)) == [same]
    assert shown(modelled.entailment_edges(canonical, say)) == [same, ("C:2", "C:6", "contradicts", 1.0, "contradicts", 0.5), ("C:3", "C:6", "entails", 0.2, "entails", 0.0)]
    assert shown(modelled.entailment_edges(canonical.limit(0), say)) == []


def test_reranked(spark):
    ranked = spark.createDataFrame([(q, d, 1.0, d + 1) for q, n in ((1, 5), (2, 2), (3, 4), (4, 12)) for d in range(n)], "qid long, doc_idx long, score double, rank int")
    best = ranked.select("qid", "doc_idx", F.concat(F.lit("P"), "doc_idx").alias("passage_id"))
    passages = spark.createDataFrame([(f"P{d}", "word " * 100) for d in range(11)], "passage_id string, text string")
    docs = spark.createDataFrame([(d, None if d % 2 else f"T{d}") for d in range(12)], "doc_idx long, title string")
    questions = spark.createDataFrame([(q, f"question {q}") for q in range(1, 5)], "qid long, question string")
    said = {"question 1": '{"selected": [3, 9, 3]}', "question 3": "none", "question 4": '```json\n{"selected": [9, 10, 2, 1],}\n```'}
    say = model(lambda p: next((a for q, a in said.items() if f"{q}\n" in p), '{"selected": [0]}'))
    got = {r["qid"]: r["selected"] for r in modelled.reranked(ranked, questions, best, passages, docs, say).collect()}
    assert got == {1: [3, 0], 4: [9, 2]}


def test_answers(spark):
    rows = [(1, "Where was Ann born?"), (2, "Which is older, Foo or Bar?"), (3, "Is it so?"), (4, "What is it?"), (5, "Is it raining?")]
    questions = spark.createDataFrame(rows, "qid long, question string")
    passages = spark.createDataFrame([("P1", "Ann", "Ann was born in Paris, France."), ("P2", None, "A thing of note.")], "passage_id string, title string, text string")
    evidence = spark.createDataFrame([(1, "P2", 1), (1, "P1", 0), (2, "P2", 0), (4, "P2", 0)], "qid long, passage_id string, position int")

    def say(p):
        if "Ann" in p:
            return "Thought: hm.\nAnswer: London."
        if "older" in p:
            return "bar" if "Options" in p else "It was 1900"
        if "so?" in p:
            return "Yes." if "Reply with yes" in p else "perhaps"
        return None if "raining" in p else "Thinking.\nAnswer: a thing"

    got = {r["qid"]: r["prediction"] for r in modelled.answers(questions, evidence, passages, model(say)).collect()}
    assert got == {1: "Paris", 2: "Bar", 3: "yes", 4: "a thing", 5: ""}


def test_connected(spark):
    rng = random.Random(5)
    names = [f"{i:02d}" for i in range(30)]
    shown = spark.createDataFrame([(c, [f"e{rng.randrange(6)}"], [f"p{rng.randrange(9)}"], [rng.randrange(4)]) for c in names], "canonical_id string, entity_ids array<string>, passage_ids array<string>, doc_idxs array<bigint>")
    edges = [(f"C:{r['canonical_id']}", f"E:{e}", 0.08) for r in shown.collect() for e in r["entity_ids"]] + [(f"C:{r['canonical_id']}", f"P:{p}", 0.06) for r in shown.collect() for p in r["passage_ids"]]
    adjacency = graph.both_ways(spark.createDataFrame(edges, "src string, dst string, cost double"))
    cands = spark.createDataFrame([(q, g, c, 1.0 - 0.01 * i, i + 1) for q in (1, 2) for g in ("a", "b", "c") for i, c in enumerate(rng.sample(names, 14))], "qid long, gid string, canonical_id string, prize double, rank int")
    chosen = cands.where("rank = 1").select("qid", "gid", "canonical_id").unionByName(spark.createDataFrame([(1, "d", None)], "qid long, gid string, canonical_id string"))
    parents = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "d", "c")], "qid long, child string, parent string")
    got = {(r["qid"], r["source"], r["target"]): (round(r["cost"], 6), r["path"]) for r in modelled.connected(chosen, parents, cands, shown, adjacency, Config()).collect()}
    ways = {}
    for a, b, c in edges:
        ways.setdefault(a, []).append((b, c))
        ways.setdefault(b, []).append((a, c))
    parts = {r["canonical_id"]: {f"E:{e}" for e in r["entity_ids"]} | {f"P:{p}" for p in r["passage_ids"]} for r in shown.collect()}
    want = {}
    for q in (1, 2):
        inside = set()
        for r in cands.where(f"qid = {q} AND rank <= 12").collect():
            inside |= {f"C:{r['canonical_id']}"} | parts[r["canonical_id"]]
        at = {r["gid"]: f"C:{r['canonical_id']}" for r in chosen.where(f"qid = {q}").collect()}
        for a, b in ((at["a"], at["b"]), (at["b"], at["c"])) if q == 1 else ((at["a"], at["b"]), (at["a"], at["c"])):
            heap, cost = [(0.0, a)], {}
            while heap:
                d, n = heapq.heappop(heap)
                if n in cost:
                    continue
                cost[n] = d
                for m, c in ways.get(n, []):
                    if m in inside:
                        heapq.heappush(heap, (d + c, m))
            if a != b and b in cost:
                want[q, a, b] = round(cost[b], 6)
    assert {k: v[0] for k, v in got.items()} == want and want
    assert all(v[1][0] == k[1] and v[1][-1] == k[2] for k, v in got.items())


def test_engine_with_a_model(spark):
    texts = [(1, "Ann Lee\nAnn Lee was born in Paris, France. She met Bob Roe."), (2, "Bob Roe\nBob Roe lives in Rome. Bob Roe knows Ann Lee."), (3, "Cid Moe\nCid Moe plays chess well.")]
    docs = segmentation.corpus(spark.createDataFrame(texts, "doc_id long, text string"))

    def say(p):
        if "sub-questions" in p:
            return json.dumps({"nodes": [{"id": "a", "question": "Where was Ann Lee born?"}, {"id": "b", "question": "Who met Bob Roe?", "depends_on": ["a"]}], "edges": []})
        return '{"selected": [1]}' if "Candidates" in p else "Answer: Paris"

    engine = Engine(completer=model(say)).index(docs)
    questions = spark.createDataFrame([(1, "Where was Ann Lee born?")], "qid long, question string")
    got = engine.rag_qa(questions, spark.createDataFrame([(1, ["Paris"])], "qid long, golds array<string>"))
    assert got["answers"].first()["prediction"] == "Paris"
    m = got["metrics"].first()
    assert (m["em"], m["f1"]) == (1.0, 1.0) and m["evidence_tokens"] > 0 and 0 <= m["coverage"] <= 1
    assert got["documents"].count() == 3


def test_retrieval_finds_similarity_edges_that_the_index_left_out(spark):
    """Everything is the same with and without them in the index, ways that take one among it; propagation does without."""
    names, places = ["Ann Lee", "Bob Roe", "Cid Moe", "Dan Poe"], ["Rome", "Oslo", "Bern", "Kiel", "Lima"]
    texts = [(i, f"{names[i % 4]} {i}\n{names[i % 4]} was born near the old town of {places[i % 5]}. The old town of {places[i % 5]} was born near a lake.") for i in range(12)]
    docs = segmentation.corpus(spark.createDataFrame(texts, "doc_id long, text string"))
    questions = spark.createDataFrame([(1, "Who was born near the old town of Rome? Who was born near Oslo?"), (2, "Was Bob Roe born near a lake?")], "qid long, question string")
    config = Config(merge_threshold=0.999, predicate_free_threshold=0.999, sim_edge_threshold=0.5, sim_edge_topk=4, cost_sim=0.001)
    shown = []
    for similar in (True, False):
        engine = Engine(config).index(docs, similar=similar)
        kept = {frozenset((r["src"], r["dst"])) for r in engine.tables["edges"].where("type = 'sim'").collect()}
        assert bool(kept) == similar
        whole = kept or whole
        got = engine.retrieve(questions)
        shown.append({k: sorted(map(str, got[k].collect())) for k in ("documents", "evidence", "assignment", "coverage", "paths")})
        steps = {frozenset(x) for r in got["paths"].collect() for x in zip(r["path"], r["path"][1:])}
        assert steps & whole
    assert shown[0] == shown[1]
