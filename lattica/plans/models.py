"""Where models plug in: a completer and an embedder, each a function of a batch, with answers kept in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.vectors import embed, l2_normalize
from lattica.plans.checkpoints import cut

Completer = Callable[[pd.Series], pd.Series]
#: Embedders by a part of their model's name, the first one counts; the built-in hashed bag of words needs none.
EMBEDDERS: dict[str, Callable[[pd.Series], pd.Series]] = {}


#: Times that a failed prompt is asked.
ATTEMPTS = 2


@dataclass(frozen=True)
class Cached:
    """A completer whose answers live in a Parquet folder between runs."""

    completer: Completer
    folder: str
    model: str = "default"

    def known(self, spark: SparkSession) -> DataFrame:
        """``(key, message)``, the latest of each key; empty before the first run."""
        return latest(spark.read.schema("key string, message string, at timestamp").parquet(self.folder), "at")

    def keep(self, fresh: DataFrame) -> None:
        """Answers (not failures) are added; an older answer of the same key is out of date from then on."""
        got = fresh.where(F.col("message").isNotNull())
        got.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.folder)

    def prepare(self, spark: SparkSession) -> None:
        """The folder exists afterwards, with the right columns."""
        spark.createDataFrame([], "key string, message string, at timestamp").write.mode("append").parquet(self.folder)


def cache_key(messages: Column, model: str, temperature: float = 0.0, response_format: str | None = None, seed: int | None = None) -> Column:
    """sha256 of the request's canonical JSON; a token limit is no part of it."""
    request = F.struct(messages.alias("messages"), F.lit(model).alias("model"), F.lit(response_format).alias("response_format"), F.lit(seed).alias("seed"), F.lit(temperature).alias("temperature"))
    return F.sha2(F.to_json(request), 256)


def complete(df: DataFrame, prompt: str, completer: Completer, out: str = "answer", cache: DataFrame | None = None, model: str = "default") -> tuple[DataFrame, DataFrame]:
    """``df`` with the completer's answers, and the new cache rows ``(key, message)``.

    Each distinct prompt is asked once; prompts whose key is in ``cache`` are not asked again (anti join). Answers come
    in Arrow batches from the executors. Prompts that get no answer are asked a second time; then theirs is null.
    """
    keyed = df.withColumn("__key", cache_key(F.col(prompt), model))
    asked = keyed.select(F.col("__key").alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])
    if cache is not None:
        asked = asked.join(cache.select("key"), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = pd.Series([None] * len(f), f.index, dtype=object)
            for _ in range(ATTEMPTS):
                left = said.isna()
                if left.any():
                    said[left] = completer(f["prompt"][left]).to_numpy(object)
            yield pd.DataFrame({"key": f["key"], "message": said})

    fresh = asked.mapInPandas(run, "key string, message string")
    known = fresh if cache is None else latest(cache).unionByName(fresh)
    answered = keyed.join(known, keyed["__key"] == known["key"], "left").drop("key", "__key").withColumnRenamed("message", out)
    return answered, fresh


def ask(df: DataFrame, prompt: Column, completer: Completer | Cached, out: str) -> DataFrame:
    """``df`` with the answers in ``out``, materialised; a ``Cached`` completer asks what its folder lacks and keeps it."""
    name = "__prompt"
    rows = df.withColumn(name, prompt)
    if not isinstance(completer, Cached):
        return cut(complete(rows, name, completer, out)[0].drop(name))
    spark = df.sparkSession
    completer.prepare(spark)
    known = cut(completer.known(spark))
    fresh = cut(complete(rows, name, completer.completer, out, known, completer.model)[1])
    completer.keep(fresh)
    keyed = rows.withColumn("__key", cache_key(F.col(name), completer.model))
    told = known.unionByName(fresh).withColumnRenamed("message", out)
    return cut(keyed.join(told, keyed["__key"] == told["key"], "left").drop("key", "__key", name))


def encode(df: DataFrame, key: str, text: str, model: str = "hashed", dim: int = 64, instruction: str = "") -> DataFrame:
    """``(key, embedding array<double>)`` of unit length, by the first embedder whose name is part of the model's.

    An embedder is a function of a batch of texts and gives a list of numbers for each; the instruction is put before the
    texts. Other models are the built-in hashed bag of words, which needs no instruction. An empty table gives no rows.
    """
    made = next((f for name, f in EMBEDDERS.items() if name in model.lower()), None)
    if made is None:
        return embed(df, key, text, dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "embedding": [[float(x) for x in v] for v in made(instruction + f["text"])]})

    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<double>").withColumn("embedding", l2_normalize("embedding"))


def pooled(vectors: Column | str) -> Column:
    """The mean of an array of vectors, dimension by dimension; null of none."""
    v = F.col(vectors) if isinstance(vectors, str) else vectors
    total = F.aggregate(F.slice(v, 2, 1 << 30), F.get(v, 0), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(v))


def latest(cache: DataFrame, at: str | None = None) -> DataFrame:
    """One row a key: the last written, if rows carry a time; the greatest message otherwise."""
    order = [F.desc(at)] if at else []
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order, F.desc("message")))
    return cache.withColumn("__r", rank).where(F.col("__r") == 1).select("key", "message")


def rules(prompts: pd.Series) -> pd.Series:
    """The offline completer: the evidence's first sentence after a line "Evidence:", otherwise nothing."""
    tails = prompts.fillna("").str.partition("Evidence:")[2].str.strip()
    return tails.str.split(r"(?<=[.!?])\s", n=1, regex=True).str[0]
