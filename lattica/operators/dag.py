"""Graphs of sub-questions: chains, anchors, parents, order, leaves."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T

MOST = 7


def chain_dag(questions: DataFrame, qid: str = "qid", text: str = "question", most: int = MOST) -> DataFrame:
    """``(qid, pos, gid, question, depends_on)``: the sentences of a question as a chain, each on the one before."""
    rows = questions.select(F.col(qid).alias("qid"), F.posexplode(F.slice(T.sentences(text), 1, most)).alias("pos", "question"))
    gid = F.format_string("q%d", F.col("pos") + 1)
    before = F.when(F.col("pos") > 0, F.array(F.format_string("q%d", "pos"))).otherwise(F.array().cast("array<string>"))
    return rows.select("qid", "pos", gid.alias("gid"), "question", before.alias("depends_on"))


def with_anchor(nodes: DataFrame, questions: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    """Nodes with the whole question put first as ``q0`` (``q_orig`` if that is taken), unless a node says the same."""
    q = questions.select(F.col(qid).alias("qid"), F.col(text).alias("question"))
    low = lambda c: F.lower(F.trim(c))
    said = nodes.select("qid", low("question").alias("said"))
    fresh = q.withColumn("said", low("question")).join(said, ["qid", "said"], "left_anti")
    taken = nodes.where(F.col("gid") == "q0").select("qid", F.lit(True).alias("taken")).distinct()
    anchor = fresh.join(taken, "qid", "left").select(
        "qid", F.lit(-1).alias("pos"), F.when(F.col("taken"), "q_orig").otherwise("q0").alias("gid"), "question", F.array().cast("array<string>").alias("depends_on")
    )
    return anchor.unionByName(nodes)


def parents(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(qid, child, parent)`` from ``depends_on``; edges count only for questions where no node depends on another."""
    known = nodes.select("qid", F.col("gid").alias("g"))
    own = nodes.select("qid", F.col("gid").alias("child"), F.explode("depends_on").alias("parent")).where(F.col("parent") != F.col("child"))
    own = own.join(known.withColumnRenamed("g", "parent"), ["qid", "parent"], "left_semi")
    if edges is None:
        return own.select("qid", "child", "parent").distinct()
    given = edges.select("qid", F.col("dst").alias("child"), F.col("src").alias("parent")).where(F.col("parent") != F.col("child"))
    given = given.join(own.select("qid").distinct(), "qid", "left_anti")
    given = given.join(known.withColumnRenamed("g", "parent"), ["qid", "parent"], "left_semi").join(known.withColumnRenamed("g", "child"), ["qid", "child"], "left_semi")
    return own.select("qid", "child", "parent").unionByName(given.select("qid", "child", "parent")).distinct()


def topo_levels(nodes: DataFrame, parents_: DataFrame) -> DataFrame:
    """``(qid, gid, pos, level)``: level 0 has no parent; a question with a cycle has level = rank of ``pos`` instead.

    A question has at most eight nodes, so its order is one small sequential task.
    """
    above = parents_.groupBy("qid", F.col("child").alias("gid")).agg(F.collect_set("parent").alias("above"))
    rows = nodes.select("qid", "gid", "pos").join(above, ["qid", "gid"], "left")

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        above = {r.gid: [] if r.above is None else list(r.above) for r in frame.itertuples()}
        level = dict.fromkeys(above, 0)
        for _ in range(len(level) + 1):
            now = {g: max((level[p] + 1 for p in ps if p in level), default=0) for g, ps in above.items()}
            if now == level:
                break
            level = now
        else:
            level = {g: i for i, g in enumerate(frame.gid)}
        return pd.DataFrame({"qid": key[0], "gid": frame.gid, "pos": frame.pos, "level": [level[g] for g in frame.gid]})

    return rows.groupBy("qid").applyInPandas(run, f"qid {dict(nodes.dtypes)['qid']}, gid string, pos int, level int")


def leaves(nodes: DataFrame, parents_: DataFrame) -> DataFrame:
    """Nodes that no other depends on."""
    return nodes.join(parents_.select("qid", F.col("parent").alias("gid")).distinct(), ["qid", "gid"], "left_anti")
