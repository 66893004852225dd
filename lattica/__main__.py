"""Command line: ``python -m lattica index|retrieve|evaluate``; every setting of ``Config`` is an option."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.config import Config
from lattica.operators.segmentation import corpus
from lattica.plans.engine import Engine
from lattica.sources import readers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lattica", description=__doc__)
    top.add_argument("action", choices=["index", "retrieve", "evaluate"])
    top.add_argument("--corpus", help="JSON array of {title, text, idx}, or Parquet with doc_id and text")
    top.add_argument("--questions", help="JSON array of questions (id, question and their support)")
    top.add_argument("--index", required=True, help="folder of the index tables")
    top.add_argument("--out", help="folder of the results")
    top.add_argument("--dataset", default="", help="name of the dataset, for the shape of its support")
    top.add_argument("--rebuild", action="store_true", help="index anew even if a finished index is there")
    top.add_argument("--log", default="INFO")
    for f in fields(Config):
        kind = (lambda s: s.lower() in ("1", "true", "yes")) if f.type == "bool" else {"int": int, "float": float}.get(f.type, str)
        top.add_argument("--" + f.name.replace("_", "-"), dest=f.name, type=kind, default=f.default)
    return top


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The corpus of either shape; a document without an index is numbered by the order of title and text."""
    if not path.endswith(".json"):
        return corpus(spark.read.parquet(path))
    rows = readers.load_json_array(spark, path).select("title", "text", "idx")
    idx = F.coalesce("idx", F.monotonically_increasing_id())
    text = F.coalesce("text", F.lit(""))
    return rows.select(idx.alias("doc_idx"), F.format_string("D_%07d", idx).alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), text).alias("doc_text"))


def run(args: argparse.Namespace, spark: SparkSession) -> Engine:
    """Index unless a finished one is there, then retrieve for the questions and write what was found."""
    config = Config(**{f.name: getattr(args, f.name) for f in fields(Config)})
    engine = Engine(config)
    if args.rebuild or not readers.index_ready(spark, args.index):
        if not args.corpus:
            raise SystemExit("--corpus is needed: there is no finished index")
        engine.index(read_corpus(spark, args.corpus)).save(args.index)
    engine.load(spark, args.index)
    if args.action == "index":
        return engine
    samples = spark.read.option("multiLine", True).json(args.questions)
    key = F.col("id") if "id" in samples.columns else F.monotonically_increasing_id()
    samples = samples.withColumn("qid", F.coalesce(key.try_cast("long"), F.xxhash64(key.cast("string"))))
    got = engine.retrieve(samples.select("qid", "question"))
    if args.out:
        for name in ("documents", "evidence", "coverage"):
            readers.append_json(got[name], f"{args.out}/{name}")
    if args.action == "evaluate":
        named = readers.gold_docs(samples, args.dataset).select("qid", F.explode("gold_docs").alias("doc_text"))
        gold = named.join(engine.tables["docs"].select("doc_idx", "doc_text"), "doc_text").select("qid", "doc_idx")
        scores = engine.evaluate(got["documents"], gold)
        logging.getLogger("lattica").info("%s", scores.first().asDict())
        if args.out:
            readers.append_json(scores, f"{args.out}/metrics")
    return engine


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    run(args, SparkSession.builder.appName("lattica").getOrCreate())


if __name__ == "__main__":
    main()
