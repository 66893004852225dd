"""Operators against plain versions, and the edge cases of their inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.config import Config
from lattica.operators import capsules, components, dag, entities, graph, retrieval, segmentation
from lattica.operators.components import connected_components
from lattica.plans import models
from lattica.sources import readers


def greedy(counts, budget, overlap):
    out, at = [], 0
    while at < len(counts):
        end, used = at, 0
        while end < len(counts) and (end == at or used + counts[end] <= budget):
            used += counts[end]
            end += 1
        out.append((at, end - 1, used))
        if end == len(counts):
            break
        back, kept = end, 0
        while back > at + 1 and kept < overlap:
            back -= 1
            kept += counts[back]
        at = back
    return out


def test_passages(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(" ".join(["w"] * (n - 1) + [f"e{k}."]) for k, n in enumerate(rng.choices(range(1, 12), k=rng.randint(0, 40))))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "w " * 50 + "end.")]
    docs = segmentation.corpus(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {}
    for r in segmentation.passages(docs, Config(chunk_tokens=20, chunk_overlap=6)).orderBy("passage_id").collect():
        got.setdefault(r["doc_idx"], []).append((r["sent_start"], r["sent_end"], r["token_count"]))
        whole = " ".join((dict(rows)[r["doc_idx"]] or "").split())
        assert whole[r["start_char"] : r["end_char"]] == r["text"]
    sents = {r["doc_id"]: r["n"] for r in docs.select(F.col("doc_idx").alias("doc_id"), F.transform(F.split("text", r"(?<=\.)\s"), lambda s: F.size(F.split(F.trim(s), r"\s+"))).alias("n")).collect()}
    for i, text in rows:
        want = greedy(sents[i], 20, 6) if text else []
        assert got.get(i, []) == want, (i, sents[i])


def test_capsule_numbers_do_not_depend_on_partitions(spark):
    docs = segmentation.corpus(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    made = lambda df: sorted(segmentation.sentence_capsules(segmentation.passages(df), mentions=False).select("capsule_id", "passage_id", "sent_id").collect())
    rows = made(docs)
    assert rows == made(docs.repartition(7)) and [r["capsule_id"] for r in rows] == [f"C_{i:08d}" for i in range(len(rows))]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            a = up[a]
        return a

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (5, None)], "src long, dst long")).collect()}
    assert got == {a: find(a) for a in up}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_of_few_edges_take_few_tasks(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(240)] + [(900 + i, 901 + i) for i in range(30)]
    edges = spark.createDataFrame([*pairs, (None, 7), (8, 8), pairs[0]], "src long, dst long")
    name = lambda c: F.concat(F.lit("é_"), c.cast("string"))
    named = edges.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"))

    def found(edges):
        return sorted((r["node"], r["component"]) for r in connected_components(edges).collect())

    with monkeypatch.context() as m:
        m.setattr(components, "FEW", 0)
        by_stars = [found(edges), found(named), found(edges.limit(0))]
    assert [found(edges), found(named), found(edges.limit(0))] == by_stars

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tracker = spark.sparkContext.statusTracker()
    try:
        spark.sparkContext.setJobGroup("few-edges", "components of few edges")
        connected_components(edges)
        stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(tracker.getStageInfo, stages) if x)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 50 < tasks <= 250  # hundreds more with every round of stars


def test_entities(spark):
    caps = spark.createDataFrame(
        [("C_1", "Thomas Sudhof", [("mention", "Thomas C. Sudhof"), ("mention", "he")]), ("C_2", "x", [("mention", "quantum dots")]), ("C_3", "x", [("mention", "American")])],
        "capsule_id string, title string, arguments array<struct<role:string,surface:string>>",
    )
    titles = spark.createDataFrame([("Thomas Sudhof",), ("ok",)], "title string")
    counts = entities.surface_counts(caps, titles)
    assert {r["surface"] for r in counts.collect()} == {"Thomas C. Sudhof", "Thomas Sudhof"}
    ents = entities.entities(entities.entity_clusters(counts))
    (row,) = ents.collect()
    assert (row["canonical_name"], row["freq"], row["aliases"]) == ("Thomas Sudhof", 2, ["Thomas C. Sudhof", "Thomas Sudhof"])
    ids = {r["capsule_id"]: r["entity_ids"] for r in entities.attach_entities(caps, entities.alias_index(ents)).collect()}
    assert ids == {"C_1": ["E_0000000"], "C_2": [], "C_3": []}


def test_canonical_capsules(spark):
    rows = [
        ("C_00000000", "a b", "p", "+", ["E1"], [1.0, 0.0], 1, "P1"),
        ("C_00000001", "a b", "p", "+", ["E1"], [1.0, 0.0], 2, "P2"),
        ("C_00000002", "a c", "p", "+", ["E1", "E2"], [0.95, 0.312], 3, "P3"),
        ("C_00000003", "a c", "p", "-", ["E1"], [0.95, 0.312], 3, "P3"),
        ("C_00000004", "a b", "p", "+", [], [1.0, 0.0], 4, "P4"),
        ("C_00000005", "a b", "q", "+", ["E1"], [0.9, 0.436], 5, "P5"),
    ]
    caps = spark.createDataFrame(rows, "capsule_id string, text string, predicate string, polarity string, entity_ids array<string>, embedding array<double>, doc_idx long, passage_id string")
    place = "named_struct('doc_id', concat('D_', doc_idx), 'doc_idx', doc_idx, 'passage_id', passage_id, 'sent_id', 0, 'quote', text) AS provenance"
    caps = caps.selectExpr("*", place, "transform(entity_ids, e -> named_struct('role', 'mention', 'surface', e, 'entity_id', e)) AS arguments")
    clusters = capsules.capsule_clusters(caps)
    got = {r["capsule_id"]: r["cluster"] for r in clusters.collect()}
    assert [got[f"C_0000000{i}"][-1] for i in range(6)] == ["0", "0", "0", "3", "4", "0"]  # 5 joins 2 at above 0.93
    made = {r["canonical_id"]: r for r in capsules.canonical_capsules(caps, clusters).collect()}
    assert made["CC_0000000"]["freq"] == 4 and made["CC_0000000"]["passage_ids"] == ["P1", "P2", "P3", "P5"]
    mean = {r["cluster"]: r["embedding"] for r in capsules.centroids(caps, clusters).collect()}
    assert sum(x * x for x in mean["C_00000000"]) == pytest.approx(1.0)


def test_ppr(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, strength double")
    both = graph.both_ways(edges)
    nodes = spark.createDataFrame([(1, n) for n in "abcd"] + [(2, n) for n in "ab"], "qid long, node string")
    seeds = spark.createDataFrame([(1, "a", 2.0), (1, "a", 2.0), (1, "z", 1.0), (1, "d", 4.0)], "qid long, seed string, weight double")
    got = {(r["qid"], r["node"]): r["score"] for r in graph.mini_ppr(seeds, nodes, both).collect()}
    s, p = {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.5}, {}
    w = {"a": {"b": 1.0}, "b": {"a": 0.5, "c": 0.5}, "c": {"b": 1.0}, "d": {}}
    p = dict(s)
    for _ in range(10):
        flow = {n: sum(p[m] * w[m].get(n, 0) for m in w) for n in s}
        p = {n: 0.15 * s[n] + 0.85 * (flow[n] + p["d"] * s[n]) for n in s}
    for n in s:
        assert got[1, n] == pytest.approx(p[n])
    assert sum(v for (q, _), v in got.items() if q == 1) == pytest.approx(1.0)
    assert got[2, "a"] + got[2, "b"] == pytest.approx(1.0)


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 3.0), ("c", "d", 1.0)], "src string, dst string, cost double")
    nodes = spark.createDataFrame([(1, n) for n in "abcd"], "qid long, node string")
    start = spark.createDataFrame([(1, "a")], "qid long, source string")
    got = {r["node"]: (r["cost"], "".join(r["path"])) for r in graph.shortest_paths(start, graph.both_ways(edges), nodes).collect()}
    assert got == {"a": (0.0, "a"), "b": (1.0, "ab"), "c": (2.0, "abc"), "d": (3.0, "abcd")}


def test_dag(spark):
    q = spark.createDataFrame([(1, "One is. Two is. Three is."), (2, "Only."), (3, None)], "qid long, question string")
    nodes = dag.with_anchor(dag.chain_dag(q), q)
    above = dag.parents(nodes)
    assert sorted((r["qid"], r["gid"], r["level"]) for r in dag.topo_levels(nodes, above).collect() if r["qid"] < 3) == [(1, "q0", 0), (1, "q1", 0), (1, "q2", 1), (1, "q3", 2), (2, "q1", 0)]
    assert sorted((r["qid"], r["gid"]) for r in dag.leaves(nodes, above).collect() if r["qid"] < 3) == [(1, "q0"), (1, "q3"), (2, "q1")]
    ring = spark.createDataFrame([(1, 0, "a", "x", ["b"]), (1, 1, "b", "y", ["a"]), (2, 0, "a", "x", []), (2, 1, "b", "y", [])], "qid long, pos int, gid string, question string, depends_on array<string>")
    edges = spark.createDataFrame([(1, "a", "b"), (2, "a", "b")], "qid long, src string, dst string")
    above = dag.parents(ring, edges)
    assert sorted((r["qid"], r["child"], r["parent"]) for r in above.collect()) == [(1, "a", "b"), (1, "b", "a"), (2, "b", "a")]
    assert sorted((r["qid"], r["gid"], r["level"]) for r in dag.topo_levels(ring, above).collect()) == [(1, "a", 0), (1, "b", 1), (2, "a", 0), (2, "b", 1)]


def test_beam(spark):
    cols = "qid long, gid string, canonical_id string, prize double, rank int, entity_ids array<string>, doc_idxs array<long>"
    rows = [(1, "q1", "x", 0.5, 1, ["E1"], [1]), (1, "q1", "y", 0.45, 2, ["E2"], [2]), (1, "q2", "z", 0.4, 1, ["E2"], [3]), (1, "q2", "x", 0.42, 2, ["E1"], [1])]
    order = spark.createDataFrame([(1, "q1", 0, 0), (1, "q2", 1, 1), (1, "q3", 2, 2)], "qid long, gid string, level int, pos int")
    above = spark.createDataFrame([(1, "q2", "q1")], "qid long, child string, parent string")
    got = {r["gid"]: (r["canonical_id"], r["score"]) for r in retrieval.beam_assign(spark.createDataFrame(rows, cols), order, above).collect()}
    worth = {("x", "z"): 0.5 + 0.08 + 0.4 - 0.04 + 0.08, ("x", "x"): 0.5 + 0.08 + 0.42 + 0.08 - 0.03 - 0.02, ("y", "z"): 0.45 + 0.08 + 0.4 + 0.08 + 0.08}
    best = max(worth, key=worth.get)
    assert (got["q1"][0], got["q2"][0]) == best and got["q3"][0] is None and got["q1"][1] == pytest.approx(worth[best])


def test_evidence(spark):
    pool = spark.createDataFrame([(1, f"P{i}", i // 2, 0.1 * i, 900 if i == 5 else 400) for i in range(6)], "qid long, passage_id string, doc_idx long, dense double, tokens long")
    hits = spark.createDataFrame([(1, "g1", "P0", 0.9), (1, "g2", "P5", 0.9)], "qid long, gid string, passage_id string, hit double")
    weights = spark.createDataFrame([(1, "g1", 2.0)], "qid long, gid string, weight double")
    seeds = spark.createDataFrame([(1, "P2", 1)], "qid long, passage_id string, pos int")
    got = retrieval.pack_evidence(pool, hits, weights, seeds).orderBy("position").collect()
    assert [r["passage_id"] for r in got][:2] == ["P2", "P0"] and sum(r["token_count"] for r in got) <= 1800


def test_dense_documents(spark):
    """A document with very many near passages does not keep others from being ranked."""
    rows = [(f"P{i:03d}", 0, [1.0, i / 1000]) for i in range(300)] + [(f"Q{d:03d}{j}", d, [0.5 / d, j * 0.1]) for d in range(1, 40) for j in range(2)]
    items = spark.createDataFrame(rows, "passage_id string, doc_idx long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([("1|a", [1.0, 0.0]), ("1|b", [0.2, 1.0])], "node string, embedding array<double>")
    got = retrieval.dense_topk(items, "passage_id", asked, "node", 30, owner="doc_idx")
    have = {(r["node"], r["rank"]): (r["doc_idx"], r["passage_id"], round(r["sim"], 6)) for r in got.collect()}
    for node, v in (("1|a", [1.0, 0.0]), ("1|b", [0.2, 1.0])):
        best = {}
        for p, d, x in rows:
            best.setdefault(d, []).append((-round(x[0] * v[0] + x[1] * v[1], 9), p))
        want = sorted((min(b)[0], d, min(b)[1]) for d, b in best.items())[:30]
        assert [have[node, i + 1] for i in range(30)] == [(d, p, round(-s, 6)) for s, d, p in want]
    scores = retrieval.dense_scores(spark.createDataFrame([(1, "P299")], "qid long, passage_id string"), items, asked.selectExpr("1L AS qid", "embedding"))
    assert scores.first()["dense"] == 1.0


def test_sim_edges(spark):
    """All pairs across blocks of questions and batches, as brute force finds them."""
    draw = random.Random(5)
    rows = [(f"c{i:02d}", [draw.gauss(1, 0.6) for _ in range(4)]) for i in range(40)]
    rows = [(k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for k, v in rows]
    capsules_ = spark.createDataFrame(rows, "canonical_id string, embedding array<double>").repartition(3)
    got = retrieval.sim_edges(capsules_, Config(sim_edge_topk=6, sim_edge_threshold=0.9, max_questions=7))
    sim = {(a, b): round(sum(x * y for x, y in zip(u, v, strict=True)), 9) for a, u in rows for b, v in rows}
    near = {a: sorted((b for b, _ in rows), key=lambda b, a=a: (-sim[a, b], b))[:6] for a, _ in rows}
    want = {tuple(sorted((f"C:{a}", f"C:{b}"))) for a in near for b in near[a] if a != b and sim[a, b] >= 0.9}
    assert want and {(r["src"], r["dst"]) for r in got.collect()} == want


def test_sim_edges_among_some(spark):
    """The pairs of some capsules, whose nearest are sought among all, in any order of the rows and with ties."""
    draw = random.Random(6)
    rows = [(f"c{i:04d}", [float(draw.choice([1, 2, 3])) for _ in range(3)]) for i in range(2500)]
    rows = [(k, [x / sum(y * y for y in v) ** 0.5 for x in v]) for k, v in rows]
    capsules_ = spark.createDataFrame(rows, "canonical_id string, embedding array<double>").repartition(2)
    among = spark.createDataFrame([(k,) for k, _ in rows[::7]], "canonical_id string")
    config = Config(sim_edge_topk=90, sim_edge_threshold=0.9, max_questions=1000)
    whole = retrieval.sim_edges(capsules_, config).collect()
    some = {f"C:{k}" for k, _ in rows[::7]}
    want = {(r["src"], r["dst"], r["sim"]) for r in whole if r["src"] in some and r["dst"] in some}
    assert want and {tuple(r) for r in retrieval.sim_edges(capsules_, config, among).collect()} == want


def test_propagated_ranks(spark):
    rows = [(1, kind, f"{kind}:{i:03d}", 1.0 - i / 1000) for kind in "CDP" for i in range(250)]
    got = graph.propagated_ranks(spark.createDataFrame(rows, "qid long, kind string, node string, score double")).collect()
    assert len(got) == 600
    assert {(r["kind"], r["id"], r["rank"], round(r["rrf"], 9)) for r in got} == {(k, f"{i:03d}", i + 1, round(1 / (61 + i), 9)) for k in "CDP" for i in range(200)}


def test_documents_order(spark):
    scores = spark.createDataFrame([(1, i, 1.0 - i / 100) for i in range(10)], "qid long, doc_idx long, score double")
    covers = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 4)], "qid long, gid string, doc_idx long")
    ranked = retrieval.diversified(scores, covers)
    assert [r["doc_idx"] for r in ranked.orderBy("rank").collect()][:3] == [0, 4, 1]
    choice = spark.createDataFrame([(1, [7, 2])], "qid long, selected array<long>")
    assert [r["doc_idx"] for r in retrieval.apply_rerank(ranked, choice).orderBy("rank").collect()][:4] == [7, 2, 0, 4]
    dense = spark.createDataFrame([(1, 3, 0.5), (1, 50, 0.4)], "qid long, doc_idx long, sim double")
    out = retrieval.retrieved(ranked, dense, Config(retrieval_top_k=11)).orderBy("rank").collect()
    assert out[-1]["doc_idx"] == 50 and len(out) == 11


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title": "T", "text": "x"}, {"title": null, "text": "y", "idx": 3}]')
    (tmp_path / "b.json").write_text('{"title": "T"}')
    docs = readers.corpus_to_docs(readers.load_json_array(spark, str(tmp_path / "a.json")))
    assert [r["doc"] for r in docs.collect()] == ["T\nx", "\ny"]
    with pytest.raises(ValueError):
        readers.load_json_array(spark, str(tmp_path / "b.json"))
    rows = spark.createDataFrame([(1, None, ["r1"]), (2, "s", None)], "id long, answer string, answer_aliases array<string>")
    assert [r["gold_answers"] for r in readers.gold_answers(rows.where("id = 2")).collect()] == [["s"]]
    with pytest.raises(Exception, match="no answer"):
        readers.gold_answers(rows).collect()
    assert [r["id"] for r in readers.cap_samples(rows, 1, 1).collect()] == [2]
    assert not readers.index_ready(spark, str(tmp_path / "index"))
    readers.write_tables({"t": rows}, str(tmp_path / "index"))
    assert readers.index_ready(spark, str(tmp_path / "index")) and readers.load_tables(spark, str(tmp_path / "index"))["t"].count() == 2


def test_completer(spark):
    rows = spark.createDataFrame([(1, "Evidence: A b. C d."), (2, "Evidence: A b. C d."), (3, None)], "id long, prompt string")
    out, fresh = models.complete(rows, "prompt", models.rules)
    assert sorted((r["id"], r["answer"]) for r in out.collect() if r["id"] < 3) == [(1, "A b."), (2, "A b.")]
    assert models.complete(rows, "prompt", models.rules, cache=fresh)[1].count() == 0


def test_stream(spark, tmp_path):
    from lattica.streaming.ingest import ingest

    docs = spark.createDataFrame([(1, "One here. Two here."), (2, "Three.")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest(spark, str(tmp_path / "in"), "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "passages")).count() == 2
