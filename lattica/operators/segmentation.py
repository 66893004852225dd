"""Sentences, passages with overlap, sentence capsules and their numbering."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.config import Config
from lattica.functions import text as T
from lattica.plans.checkpoints import cut


def corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_idx, doc_id, title, text, doc_text)``: the first line is the title of a text that has none."""
    title = F.substring_index(F.coalesce(F.col(text), F.lit("")), "\n", 1)
    return docs.select(
        F.col(key).cast("long").alias("doc_idx"),
        F.format_string("D_%07d", F.col(key).cast("long")).alias("doc_id"),
        title.alias("title"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.concat(title, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).alias("doc_text"),
    )


def sentence_rows(docs: DataFrame) -> DataFrame:
    """``(doc_idx, pos, sentence)`` of a corpus."""
    return docs.select("doc_idx", F.posexplode(T.sentences("text")).alias("pos", "sentence"))


SPANS = "array<struct<start:int,stop:int,tokens:long,char:int>>"


def spans_of(counts: list[int], lengths: list[int], budget: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """``(start, stop, tokens, char)`` of the windows over sentences with so many words and characters, in linear time.

    From sentence ``start`` a window reaches the last one within the budget, or is one sentence; the next starts as late as
    leaves the overlap, but moves on. ``char`` is where the window begins in the sentences joined by one space.
    """
    words, chars = [0], [0]
    for n, c in zip(counts, lengths, strict=True):
        words.append(words[-1] + n)
        chars.append(chars[-1] + c + 1)
    out, start, stop, back, m = [], 0, 0, 0, len(counts)
    while start < m:
        stop = max(stop, start + 1)
        while stop < m and words[stop + 1] - words[start] <= budget:
            stop += 1
        out.append((start, stop, words[stop] - words[start], chars[start]))
        if stop >= m:
            break
        while back + 1 <= m and words[back + 1] <= words[stop] - overlap:
            back += 1
        start = max(start + 1, back)
    return out


def passages(docs: DataFrame, config: Config = Config(), counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Windows of whole sentences within a budget of words, each starting so that it overlaps the one before.

    Every document is a row of its own, so nothing is shuffled: Arrow batches of word counts and lengths give the spans, and
    texts are cut by them inside the JVM. A sentence longer than the budget is a passage of its own; documents without
    a sentence have none. ``counts`` turns an array of sentences into their tokens (default: words).
    """
    arrays = docs.select("doc_idx", "doc_id", "title", T.sentences("text").alias("sentences")).where(F.size("sentences") > 0)
    budget, overlap = config.chunk_tokens, config.chunk_overlap

    @F.pandas_udf(SPANS)
    def spans(n: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([spans_of(x.tolist(), y.tolist(), budget, overlap) for x, y in zip(n, c, strict=True)])

    words = counts(F.col("sentences")) if counts else F.transform("sentences", lambda s: T.word_count(s))
    lengths = F.transform("sentences", lambda s: F.length(s))
    whole = arrays.withColumn("spans", spans(words, lengths))
    window = F.transform("spans", lambda p: F.struct(p.alias("p"), F.slice("sentences", p["start"] + 1, p["stop"] - p["start"]).alias("part")))
    own = whole.select("doc_idx", "doc_id", "title", F.posexplode(window).alias("chunk_idx", "w"))
    own = own.select("doc_idx", "doc_id", "title", "chunk_idx", "w.p", F.col("w.part").alias("sentences"), F.array_join("w.part", " ").alias("text"))
    return own.select(
        F.format_string("P_%07d_%03d", "doc_idx", "chunk_idx").alias("passage_id"),
        "doc_id",
        "doc_idx",
        "chunk_idx",
        "title",
        "text",
        "sentences",
        F.col("p.char").alias("start_char"),
        (F.col("p.char") + F.length("text")).alias("end_char"),
        F.col("p.start").alias("sent_start"),
        (F.col("p.stop") - 1).alias("sent_end"),
        F.size("sentences").alias("num_sents"),
        F.col("p.tokens").alias("token_count"),
    )


def sentence_spans(passages_: DataFrame) -> DataFrame:
    """``(passage_id, sent_id, start, stop)``: where each sentence of a passage stands in its text."""
    step = F.aggregate(
        "sentences",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("stop")))).alias("out")),
    )["out"]
    rows = passages_.select("passage_id", F.posexplode(step).alias("sent_id", "s"))
    return rows.select("passage_id", "sent_id", "s.start", "s.stop")


def sentence_capsules(passages_: DataFrame, config: Config = Config(), mentions: bool = True) -> DataFrame:
    """Atomic statements: the first sentences of each passage, with the entities that they mention as arguments.

    ``mentions=False`` leaves the arguments empty.
    """
    return with_capsule_ids(sentence_statements(passages_, config, mentions))


def with_capsule_ids(statements: DataFrame) -> DataFrame:
    """Statements with ``capsule_id``. Numbers follow document, passage, sentence, predicate and text; they are dealt per
    document and shifted by the counts of the documents before, so that no window holds the corpus.
    """
    rows = numbered(statements, ["doc_idx"], ["passage_id", "sent_id", "predicate", "text"], "capsule_nr")
    return rows.withColumn("capsule_id", F.format_string("C_%08d", "capsule_nr"))


def sentence_statements(passages_: DataFrame, config: Config = Config(), mentions: bool = True) -> DataFrame:
    """The statements of ``sentence_capsules``, not numbered yet."""
    rows = passages_.select(
        "doc_id", "doc_idx", "passage_id", "title", "sent_start", F.posexplode(F.slice("sentences", 1, config.max_capsules_per_passage)).alias("sent_id", "text")
    )
    found = T.entity_mentions("text") if mentions else F.array().cast("array<string>")
    argument = F.transform(found, lambda m: F.struct(F.lit("mention").alias("role"), m.alias("surface")))
    quote = F.substring("text", 1, 200)
    return rows.select(
        "doc_id",
        "doc_idx",
        "passage_id",
        "title",
        "text",
        F.lit("sentence").alias("predicate"),
        F.lit("affirmed").alias("polarity"),
        argument.alias("arguments"),
        "sent_id",
        F.struct("doc_id", "doc_idx", "passage_id", "sent_id", quote.alias("quote")).alias("provenance"),
        F.lit(0.0).alias("confidence"),
    )


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 0 in the order of ``groups``, then ``order``: rank inside a group plus the counts of those before.

    Only the table of group counts is put in one order, by ranges; rows stay with their group.
    """
    counts = df.groupBy(*groups).agg(F.count("*").alias("__n"))
    slices = counts.withColumn("__slice", F.floor(F.col(groups[0]) / F.lit(65536)))
    per = slices.groupBy("__slice").agg(F.sum("__n").alias("__m"))
    ahead = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("__slice", F.coalesce(F.sum("__m").over(ahead), F.lit(0)).alias("__far"))
    near = Window.partitionBy("__slice").orderBy(*groups).rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("__near", F.coalesce(F.sum("__n").over(near), F.lit(0))).join(per, "__slice")
    starts = starts.select(*groups, (F.col("__near") + F.col("__far")).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    return df.join(starts, groups).withColumn(name, F.col("__start") + inside).drop("__start")


def numbered_by_range(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 0 in a total order: places inside the ranges of the order plus the rows of the ranges before.

    No window holds more than the table of ranges. The rows are materialised, before and after they are put in order.
    """
    keys = {f"__k{i}": c for i, c in enumerate(order)}
    dealt = cut(df.withColumns(keys)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(dealt.select(*df.columns, F.spark_partition_id().alias("__slot"), F.monotonically_increasing_id().alias("__at")))
    slots = placed.groupBy("__slot").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    ahead = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("__slot", (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__from"))
    return placed.join(slots, "__slot").withColumn(name, F.col("__at") + F.col("__from")).drop("__slot", "__at", "__from")
