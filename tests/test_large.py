"""Queries on tables beyond the settings' caps, and operators on groups beyond a block."""

import random

import duckdb
import pytest

from lattica import operator_queries, queries  # noqa: F401  (the first registers its queries)
from lattica.config import Config
from lattica.operators import graph, modelled, retrieval

N = 5200


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """One region, one nation, more suppliers than ``max_nodes``."""
    d, con = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for name, rows in {
        "region": "SELECT 0::INT AS r_regionkey",
        "nation": "SELECT 0::INT AS n_nationkey, 0::INT AS n_regionkey",
        "supplier": f"SELECT range::BIGINT AS s_suppkey, 0::INT AS s_nationkey FROM range({N})",
    }.items():
        con.execute(f"COPY ({rows}) TO '{d}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    return str(d), con


def same_as_sql(spark, crowded, name):
    d, con = crowded
    got = queries.FOUND[name](spark, d)
    want = con.sql(queries.SQL[name])
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert len(rows) >= N and rows == sorted(want.fetchall())


def test_induced_2hop(spark, crowded):
    same_as_sql(spark, crowded, "induced_2hop")


def test_path_connect(spark, crowded):
    same_as_sql(spark, crowded, "path_connect")


def test_ppr_10_steps(spark, crowded):
    same_as_sql(spark, crowded, "ppr_10_steps")


def test_best_passage_of_a_long_document(spark):
    rows = [(0, 1, "P_0000001_1000", 0.5), (0, 1, "P_0000001_999", 0.5), (0, 1, "P_0000001_1001", 0.4), (1, 2, "P_0000002_001", None), (1, 2, "P_0000002_002", -0.1)]
    got = retrieval.best_per_doc(spark.createDataFrame(rows, "qid long, doc_idx long, passage_id string, sim double"), ["qid"])
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, "P_0000001_1000", 0.5), (1, 2, "P_0000002_002", -0.1)]


def test_nearest_in_blocks(spark):
    """Groups beyond a block, with copies, against a plain version; the old join made every pair of a label row by row."""
    r = random.Random(4)
    some = [[r.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = [(i, i % 2, some[r.randrange(60)] if i % 3 else [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    odd = [(900, 0, None), (901, None, some[0]), (902, 0, [None] * 6), (903, 0, some[0][:5]), (904, 0, [0.0] * 6)]
    dots = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    want = set()
    for a, g, x in rows:
        near = sorted((-dots(x, y), b) for b, h, y in rows if h == g and b != a and dots(x, y) >= 0.3)[:4]
        want |= {(min(a, b), max(a, b), -s) for s, b in near}
    df = spark.createDataFrame(rows + odd, "id long, g int, v array<double>")
    plan = graph.knn_edges(df, "id", "v", "g", 4, 0.3, 40)
    assert "MapInArrow" in plan._jdf.queryExecution().toString()
    got = plan.collect()
    assert {(x["src"], x["dst"]) for x in got} == {(a, b) for a, b, _ in want} and len(got) == len(want)
    assert all(abs(x["sim"] - {(a, b): s for a, b, s in want}[x["src"], x["dst"]]) < 1e-12 for x in got)


def test_entailment_in_blocks(spark):
    """Groups beyond a block against a plain version; the old join made and kept every similar pair of an entity."""
    r = random.Random(5)
    rows = [(f"C{i}", f" T{r.randrange(12)}", r.sample("ABCD", r.randrange(3)), [round(r.gauss(0, 1), 1) for _ in range(4)]) for i in range(150)]
    dots = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    pairs = [(a, b, t == u, dots(x, y)) for a, t, e, x in rows for b, u, f, y in rows if a < b and set(e) & set(f) and dots(x, y) >= 0.5]
    judged = sorted((p for p in pairs if not p[2]), key=lambda p: (-round(p[3], 9), p[0], p[1]))
    df = spark.createDataFrame([*rows, ("odd", "T1", ["A"], None), ("odd2", "T1", None, [1.0] * 4)], "canonical_id string, text string, entity_ids array<string>, embedding array<double>")
    say = lambda prompts: prompts.map(lambda _: '{"label": "contradicts"}')
    for most, want in ((0, judged), (30, judged[:30])):
        made = modelled.entailment_edges(df, say, Config(entails_min_sim=0.5, nli_max_pairs=most), 40)
        got = sorted((x["src"][2:], x["dst"][2:], x["type"] == "entails") for x in made.collect())
        assert got == sorted((a, b, s) for a, b, s, _ in [p for p in pairs if p[2]] + want)
    alone = modelled.entailment_edges(df, None, Config(entails_min_sim=0.5), 40)
    assert "MapInArrow" in alone._jdf.queryExecution().toString()
    assert sorted((x["src"][2:], x["dst"][2:]) for x in alone.collect()) == sorted((a, b) for a, b, s, _ in pairs if s)
