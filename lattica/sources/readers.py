"""Corpora, questions and index tables in; results out."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import _col

CORPUS = "title string, text string, idx long"


def load_json_array(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A JSON file that is one array of objects; anything else at its root raises when rows are read."""
    shape = spark.read.text(path, wholetext=True).select(F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("c"))
    bad = shape.where(F.col("c") != "[").take(1)
    if bad:
        raise ValueError(f"{path} is not a JSON array")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def corpus_to_docs(corpus: DataFrame) -> DataFrame:
    """``doc = title + newline + text``; a missing one counts as empty."""
    empty = F.lit("")
    return corpus.select("*", F.concat(F.coalesce("title", empty), F.lit("\n"), F.coalesce("text", empty)).alias("doc"))


def gold_docs(samples: DataFrame, dataset: str = "") -> DataFrame:
    """Samples with ``gold_docs``, distinct, from whichever of the three shapes of support they have.

    ``supporting_facts`` name titles of ``context`` (sentences joined without a space for ``hotpotqa``), ``contexts``
    keep those marked as supporting, ``paragraphs`` lose only those marked as not supporting.
    """
    names, joint = samples.columns, "" if "hotpotqa" in dataset else " "
    doc = lambda t, x: F.concat(F.coalesce(t, F.lit("")), F.lit("\n"), F.coalesce(x, F.lit("")))
    found = F.array().cast("array<string>")
    if {"supporting_facts", "context"} <= set(names):
        titles = F.transform("supporting_facts", lambda f: f["title"])
        kept = F.filter("context", lambda c: F.array_contains(titles, c["title"]))
        found = F.transform(kept, lambda c: doc(c["title"], F.array_join(c["sentences"], joint)))
    elif "contexts" in names:
        found = F.transform(F.filter("contexts", lambda c: c["is_supporting"]), lambda c: doc(c["title"], c["text"]))
    elif "paragraphs" in names:
        fields = {f.name for f in samples.schema["paragraphs"].dataType.elementType.fields}
        body = lambda p: F.coalesce(*[p[c] for c in ("text", "paragraph_text") if c in fields])
        mark = lambda p: F.coalesce(p["is_supporting"], F.lit(True)) if "is_supporting" in fields else F.lit(True)
        found = F.transform(F.filter("paragraphs", mark), lambda p: doc(p["title"], body(p)))
    return samples.withColumn("gold_docs", F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))))


def gold_answers(samples: DataFrame) -> DataFrame:
    """Samples with ``gold_answers``: the first answer column that is filled, joined with aliases; none raises."""
    names = set(samples.columns)

    def listed(c: str) -> Column:
        kind = dict(samples.dtypes)[c]
        return F.col(c) if kind.startswith("array") else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string")))

    single = [listed(c) for c in ("answer", "gold_ans", "reference") if c in names]
    parts = [F.coalesce(listed(c), F.array().cast("array<string>")) for c in ("obj", "possible_answers", "o_wiki_title", "o_aliases") if c in names]
    if parts:
        joint = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())
        single.append(F.when(F.size(joint) > 0, joint))
    if not single:
        raise ValueError("samples have no answer column")
    found = F.coalesce(*single, F.array(F.raise_error(F.lit("a sample has no answer")).cast("string")))
    aliases = F.coalesce(F.col("answer_aliases"), F.array().cast("array<string>")) if "answer_aliases" in names else F.array().cast("array<string>")
    return samples.withColumn("gold_answers", F.array_distinct(F.array_union(found, aliases)))


def cap_samples(samples: DataFrame, most: int, offset: int = 0, seed: int | None = None, key: str = "id") -> DataFrame:
    """Rows ``offset`` to ``offset + most`` in order of the key, or of its seeded hash."""
    if most < 0 or offset < 0:
        raise ValueError("counts must not be negative")
    order = [_col(key)] if seed is None else [F.xxhash64(F.lit(seed), _col(key)), _col(key)]
    return samples.orderBy(*order).offset(offset).limit(most)


META = "name string, rows long, columns string, config string, stages string"


def write_tables(tables: dict[str, DataFrame], folder: str, config: str = "", stages: str = "") -> None:
    """Index tables as Parquet, the marker table last, so that a reader sees a finished index or none.

    Edges are written in the order of ``(src, dst, type)``. The marker tells each table's rows and columns, the settings and the
    seconds of the stages.
    """
    for name, df in tables.items():
        keys = [c for c in ("src", "dst", "type") if c in df.columns]
        (df.orderBy(*keys) if name == "edges" else df).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    meta = [(name, spark.read.parquet(f"{folder}/{name}").count(), ",".join(df.columns), config, stages) for name, df in tables.items()]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").json(f"{folder}/_meta")


def index_meta(spark: SparkSession, folder: str) -> DataFrame:
    """``(name, rows, columns, config, stages)`` of a finished index."""
    return spark.read.schema(META).json(f"{folder}/_meta")


def adjacency_lists(edges: DataFrame) -> DataFrame:
    """``(node, neighbours)``: both ends of every edge, neighbours in the order of ``(node, type, cost)``."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), "type", "cost").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to"), "type", "cost"))
    return both.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("to", "type", "cost"))).alias("neighbours"))


def index_ready(spark: SparkSession, folder: str) -> bool:
    """Whether a finished index is there with all its tables, by what Spark's own readers find."""
    try:
        names = [r["name"] for r in index_meta(spark, folder).select("name").collect()]
        for name in names:
            spark.read.parquet(f"{folder}/{name}").schema  # noqa: B018
        return bool(names)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a finished index, lazily."""
    return {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in index_meta(spark, folder).select("name").collect()}


def append_json(df: DataFrame, path: str) -> None:
    """Predictions and metrics as JSON lines, added to what is there."""
    df.write.mode("append").json(path)
