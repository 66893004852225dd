"""Substring deduplication by unit hashing (operator 9).

Texts are cut into units (paragraphs, lines, or the sentences inside lines), units are normalised and hashed to 128 bits,
digests are grouped over the whole corpus, and only the earliest ranked occurrence of a digest stays. What repeats is
reported as spans of the original text, with the offsets of what is kept.

Lines and paragraphs are units of their own, but the passages that repeat in the corpora at hand are set into the middle
of lines: whole lines catch a fifth to a third of their words, sentences inside lines about two thirds (README). Sentences are
therefore the default unit. Units that repeat count once they make a connected run of ``min_words`` words; with 0 every
repeated unit counts, stock lines of a few words too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.marks import bitmap, free, split
from lattica.llm.rows import SLICE, forget, give_back, small_batches
from lattica.plans.checkpoints import cut

#: Where a unit ends; white space after it belongs to it.
ENDS = {
    "sentence": re.compile("[.!?]+[\x20\x09-\x0d]+|\n[\x20\x09-\x0d]*"),
    "line": re.compile("\n"),
    "paragraph": re.compile("\n[\x20\x09-\x0d]*\n"),
}
#: Words of a run of repeated units that make it a repeated passage: half of the passages that are looked for.
MIN_WORDS = 25
UNITS = "doc long, twin long, start int, stop int, words int, hi long, lo long"


def cut_units(text: str, unit: str = "sentence") -> Iterator[tuple[int, int, int, bytes]]:
    """``(start, stop, words, digest)`` of the units with a word, offsets in characters; a unit reaches to the next one."""
    at, held = 0, None
    for stop in (*(m.end() for m in ENDS[unit].finditer(text)), len(text)):
        words = text[at:stop].encode().lower().split()
        if words:
            if held:
                yield held[0], at, *held[1:]
            held = at, len(words), xxhash.xxh3_128_digest(b" ".join(words))
        at = stop
    if held:
        yield held[0], len(text), *held[1:]


def _units(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for a in range(0, batch.num_rows, SLICE):
            part = batch.slice(a, SLICE)
            got = [list(cut_units(t.as_py() or "", unit)) for t in part.column("text")]
            flat = [u for x in got for u in x]
            if not flat:
                continue
            start, stop, words, digest = zip(*flat, strict=True)
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            take = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
            data = [part.column("doc").take(take), part.column("twin").take(take)]
            data += [pa.array(x, pa.int32()) for x in (start, stop, words)] + [pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(data, names=["doc", "twin", "start", "stop", "words", "hi", "lo"])
    give_back()


def repeated_spans(
    df: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "sentence", min_words: int = MIN_WORDS
) -> DataFrame:
    """``(key, twin, start, stop, n_units, n_words, kept_<key>, kept_start)``: what repeats and where it is kept.

    Occurrences are ranked by key, then by the hash of the text (``twin``, which tells rows of one key apart), then by
    place; a null key ranks first. Every run of neighbouring units that all stand somewhere earlier, with at least
    ``min_words`` words together, is one span; ``kept_*`` name the occurrence that the run's first unit repeats.
    Identical rows (same key and text) are one document. Null, empty and wordless texts have no unit and no span; an empty
    table gives no rows. Only the key and the text are read. The sums of a digest are formed before the shuffle, and what
    meets the occurrences is a written table of the repeated digests, so adaptive execution can split a digest that is in very many
    documents.
    """
    body = F.col(text).cast("string")
    named = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("twin"), body.alias("text"))
    units = named.mapInArrow(lambda b: _units(b, unit), UNITS)
    rank = F.struct("doc", "twin", "start")
    first = units.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    with small_batches(df.sparkSession):
        first = cut(first.where(F.col("n") > 1).select("hi", "lo", "first"))
    again = units.join(first, ["hi", "lo"]).where(rank != F.col("first")).drop("hi", "lo")
    whole = Window.partitionBy("doc", "twin").orderBy("start")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    # the units of identical rows stand side by side and count once
    told = again.withColumns({"reached": F.max("stop").over(before), "same": F.coalesce(F.lag("start").over(whole) == F.col("start"), F.lit(False))})
    opened = F.coalesce(F.col("start") > F.col("reached"), F.lit(True))
    runs = told.withColumn("run", F.sum(opened.cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    once = lambda c: F.sum(F.when(F.col("same"), 0).otherwise(c))
    spans = runs.groupBy("doc", "twin", "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        once(F.lit(1)).cast("long").alias("n_units"),
        once(F.col("words")).cast("long").alias("n_words"),
        F.min_by("first", "start").alias("first"),
    )
    return spans.where(F.col("n_words") >= min_words).select(
        F.col("doc").alias(key),
        "twin",
        "start",
        "stop",
        "n_units",
        "n_words",
        F.col("first.doc").alias(f"kept_{key}"),
        F.col("first.start").alias("kept_start"),
    )


def without_spans(df: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with the spans cut out of its texts; all rows and columns stay, texts without a span are as they were.

    Only texts that have a span meet the table of spans; all others stay where they are. Columns may have any names.
    """
    ordered = F.array_sort(F.collect_list(F.struct("start", "stop")))
    with small_batches(df.sparkSession):
        cuts = cut(spans.groupBy(F.col(key).cast("long").alias("doc"), F.col("twin").alias("own")).agg(ordered.alias("cuts")))
    doc, own = F.col(key).cast("long"), F.xxhash64(F.col(text).cast("string"))
    rest, some = split(df, F.xxhash64(doc, own), bitmap(cuts, F.xxhash64("doc", "own")))
    names = {c: free(df, c) for c in ("doc", "own", "cuts", "row_doc", "row_own")}
    held = some.select("*", doc.alias(names["row_doc"]), own.alias(names["row_own"]))
    named = cuts.withColumnsRenamed(names)
    same = held[names["row_doc"]].eqNullSafe(named[names["doc"]]) & (held[names["row_own"]] == named[names["own"]])
    met = held.join(named, same, "left").select(*[held[f"`{c}`"] for c in df.columns], named[names["cuts"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = []
            for t, cuts in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                t = t.as_py()
                if cuts.is_valid and t is not None:
                    parts, last = [], 0
                    for c in cuts.as_py():
                        parts.append(t[last : c["start"]])
                        last = c["stop"]
                    t = "".join([*parts, t[last:]])
                texts.append(t)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
        give_back()

    return rest.unionAll(met.mapInArrow(run, df.schema))


#: DuckDB SQL of the query (unique keys); what ends a unit is that of ENDS.
ORACLE = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?]+[\\x20\\x09-\\x0d]+|\\n[\\x20\\x09-\\x0d]*)', '\\1' || chr(31), 'g'), chr(31)) AS parts FROM d),
p AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS nr FROM c),
o AS (SELECT doc_id, nr, s, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start,
        length(s) AS n, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0d]+') AS w FROM p),
a AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS whole FROM o),
u AS (SELECT doc_id, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY nr), whole)::INT AS stop, len(w) AS words,
        array_to_string(w, ' ') AS unit, row_number() OVER (PARTITION BY doc_id ORDER BY nr) AS pos FROM a WHERE len(w) > 0),
f AS (SELECT *, row_number() OVER same AS turn, first_value(doc_id) OVER same AS kept_doc_id, first_value(start) OVER same AS kept_start FROM u
      WINDOW same AS (PARTITION BY unit ORDER BY doc_id NULLS FIRST, start)),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM f WHERE turn > 1)
SELECT doc_id, min(start)::INT AS start, max(stop)::INT AS stop, count(*)::BIGINT AS n_units, sum(words)::BIGINT AS n_words,
  arg_min(kept_doc_id, pos) AS kept_doc_id, arg_min(kept_start, pos)::INT AS kept_start
FROM r GROUP BY doc_id, run HAVING sum(words) >= {MIN_WORDS}
"""
