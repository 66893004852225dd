"""Mixing sources to target weights by entropy balancing (operator 3). DataFrame operations only.

The mix is a rate per document, how often its words are taken, that is nearest to the base rates in relative entropy
(mass counted in words), subject to one constraint per source, its words, and to rates of at most ``cap``. The dual has
one multiplier per source and is convex; its solution tilts the base rates exponentially, ``min(cap, base * exp(lam))``.
Newton's method finds the multipliers: every iteration sums words and slope per source over the table of rates, with
partial sums before the shuffle. Rates are then rounded to copies: whole copies first, then one further copy of
documents in the order of a hash divided by their remaining fraction (which takes each with that probability) until the
words of the source's target are reached; the document at that point gives the part that is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.plans.checkpoints import cut

WORD = "[^\\x20\\x09-\\x0D]+"
#: Weights of the sources in order of their code points, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for a word of the corpus, and the most that one source or document gives.
SHARE, CAP = 1.5, 2.0
ROUNDS = 40
#: A multiplier is found once its source's words are as near to the target as this part of it.
NEAR = 1e-9
#: Documents that stand in one slice of a source when they are put in order.
SLICE = 20_000
#: Base rates by words: fragments and very long documents start lower, so that a source's words come from whole middling texts first.
BASE_RATES = ((50, 0.5), (1000, 1.0), (None, 0.75))
#: Sources up to which their table is sent to every executor; beyond it is joined by shuffling.
FEW = 10_000


def base_rate(size: F.Column) -> F.Column:
    """The base rate of a document of so many words, by ``BASE_RATES`` (words below which a rate holds)."""
    rate = F.lit(BASE_RATES[-1][1])
    for below, x in reversed(BASE_RATES[:-1]):
        rate = F.when(size < below, F.lit(x)).otherwise(rate)
    return rate


def n_words(text: str) -> F.Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row a source.

    Sources take weights in code-point order, null last. ``share`` of all words is dealt by weight; what would exceed
    ``cap`` times a source's size is dealt again among the others. That is a water level: sources are ordered by the level
    at which they are full, and the level is that of the first one that is not full.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("nr", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weighed = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("nr") - 1, F.lit(len(weights))) + 1))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("full", F.col("most") / F.col("w"))
    before = everything.orderBy("full", "nr").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    found = weighed.withColumn("level", level)
    open_ = F.when(F.col("level") < F.col("full"), F.struct("full", "nr", "level"))
    chosen = found.withColumn("level", F.min(open_).over(everything)["level"])
    return chosen.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("full") <= F.col("level")), F.col("most")).otherwise(F.col("level") * F.col("w")).alias("target"),
    )


def multipliers(mass: DataFrame, goals: DataFrame, cap: float = CAP) -> DataFrame:
    """``(source, lam)``: solves the dual by Newton steps.

    ``mass`` has ``(source, base, words)``, the words of a source at each base rate; ``goals`` has ``(source, target)``.
    A source whose target is all it may give stops at the cap; one without words keeps 0.
    """
    rate = F.least(F.lit(cap), F.col("base") * F.exp("lam"))
    state = cut(goals.select("source", "target", *[F.lit(x).alias(n) for n, x in (("lam", 0.0), ("low", -64.0), ("high", 64.0))], F.lit(False).alias("done")))
    for _ in range(ROUNDS):
        sums = (
            mass.join(state.select(F.col("source").alias("s"), "lam"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(F.col("words") * rate).alias("got"), F.sum(F.when(rate < cap, F.col("words") * rate).otherwise(0.0)).alias("slope"))
        )
        # Newton on the logarithm of a source's words, which is linear until documents reach the cap; bisection where it leaves
        # the bracket
        step = F.col("lam") + F.ln(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        below = F.col("got") < F.col("target")
        low, high = F.when(below, F.col("lam")).otherwise(F.col("low")), F.when(below, F.col("high")).otherwise(F.col("lam"))
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        settled = F.coalesce((F.abs(F.col("target") - F.col("got")) <= F.lit(NEAR) * F.col("target")) | (below & (F.col("slope") == 0)), F.lit(True))
        met = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("over", F.col("done") | settled)
        met = met.withColumn("step", F.when(F.col("slope") > 0, step)).withColumns({"low": low, "high": high})
        moved = F.when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        state = cut(met.select("source", "target", F.when(F.col("over"), F.col("lam")).otherwise(moved).alias("lam"), "low", "high", F.col("over").alias("done")))
        if not state.where(~F.col("done")).take(1):
            break
    return state.select("source", "lam")


def _by_source(rows: DataFrame, small: DataFrame, few: bool) -> DataFrame:
    """Rows with the columns of their source; ``small`` is sent to the executors only if its size has been checked."""
    named = small.withColumnRenamed("source", "__s")
    on = rows["source"].eqNullSafe(named["__s"])
    return rows.join(F.broadcast(named) if few else named, on).drop("__s")


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    base: F.Column | None = None,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
) -> DataFrame:
    """``(key, source, twin, size, source_size, target, rate, taken)`` of every document.

    ``taken`` counts the words that the mix takes of it, repeats included: whole copies of ``size``, a further copy or
    a part of one, at most ``cap`` copies for a whole ``cap``. The taken words of a source sum to its target, rounded.
    Null texts have size 0 and take 0. A null source is a source, the last one. A null key is a key like any other;
    repeated rows are documents of their own, and which of several identical ones is taken further is arbitrary but how
    many is not. ``base`` gives positive base rates (default: ``base_rate`` of the size). Only key, text and source are read. Empty tables give
    no rows. ``twin`` is the hash of the text.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(text).cast("string")).alias("twin"),
        n_words(text).alias("size"),
        (base_rate(n_words(text)) if base is None else base.cast("double")).alias("base"),
    )
    sized = cut(rows)
    mass = cut(sized.groupBy("source", "base").agg(F.sum("size").cast("double").alias("words"), F.count("*").alias("n")))
    sizes = mass.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"), F.sum("n").alias("n"))
    goals = cut(targets(sizes.select("source", "source_size"), weights, share, cap))
    lam = multipliers(mass, goals, cap)
    counted = sizes.agg(F.count("*").alias("k"), F.max("n").alias("n")).first()
    few, slices = counted["k"] <= FEW, max(1, -(-(counted["n"] or 1) // SLICE))

    per_source = goals.join(lam.withColumnRenamed("source", "__l"), F.col("source").eqNullSafe(F.col("__l"))).drop("__l")
    rated = _by_source(sized, per_source, few).withColumn("rate", F.least(F.lit(cap), F.col("base") * F.exp("lam")))
    digest = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    part = F.col("rate") - F.floor("rate")
    draw = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    ordered = (
        rated.withColumn("digest", digest)
        .withColumn("place", F.when(part > 0, draw / part))
        # finer than the order is needed for; beyond place 1 on a logarithmic scale, so that no slice holds more than its share
        .withColumn("slice", F.when(F.col("place") < 1, F.floor(F.col("place") * slices)).otherwise(slices + F.floor(F.log2("place") * slices)))
        .withColumn("slice", F.coalesce(F.col("slice"), F.lit(-1)).cast("int"))
    )
    whole = F.sum(F.floor("rate") * F.col("size"))
    sums = cut(ordered.groupBy("source", "slice").agg(F.sum("size").alias("words"), whole.alias("whole")))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("ahead", F.coalesce(F.sum(F.when(F.col("slice") >= 0, F.col("words")).otherwise(0)).over(ahead), F.lit(0)))
    starts = starts.withColumn("whole", F.sum("whole").over(Window.partitionBy("source")))
    starts = starts.select(F.col("source").alias("__s"), F.col("slice").alias("__i"), "ahead", "whole")
    met = ordered.join(starts, ordered["source"].eqNullSafe(starts["__s"]) & (ordered["slice"] == starts["__i"])).drop("__s", "__i")
    # the documents that take no further copy need no order, so they are not gathered by it
    spread = F.when(F.col("slice") < 0, F.pmod(F.xxhash64("key", "twin"), F.lit(slices))).otherwise(0)
    inside = Window.partitionBy("source", "slice", spread).orderBy("place", "digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rest = F.round("target").cast("long") - F.col("whole")
    further = F.when(F.col("slice") < 0, F.lit(0)).otherwise(F.least(F.col("size"), F.greatest(F.lit(0), rest - reached)))
    return met.select(
        F.col("key").alias(key),
        F.col("source").alias(source),
        "twin",
        "size",
        "source_size",
        "target",
        "rate",
        (F.floor("rate") * F.col("size") + further).cast("long").alias("taken"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, list_extract(CAST([3, 1, 2] AS DOUBLE[]), ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT) AS w,
      row_number() OVER (ORDER BY source NULLS LAST) AS nr, source_size * {CAP}::DOUBLE AS most FROM s),
f AS (SELECT *, most / w AS full_at FROM r),
l AS (SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
        - coalesce(sum(most) OVER (ORDER BY full_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lev FROM f),
o AS (SELECT lev FROM l WHERE lev < full_at ORDER BY full_at, nr LIMIT 1),
t AS (SELECT l.source, source_size, CASE WHEN o.lev IS NULL OR full_at <= o.lev THEN most ELSE o.lev * w END AS target FROM l LEFT JOIN o ON true),
b AS (SELECT *, CASE {" ".join(f"WHEN size < {n} THEN {x}::DOUBLE" for n, x in BASE_RATES[:-1])} ELSE {BASE_RATES[-1][1]}::DOUBLE END AS base FROM d),
m AS (SELECT source, base, sum(size)::DOUBLE AS words FROM b GROUP BY source, base),
k AS (SELECT m.source, m.base, t.target,
        (t.target - coalesce(sum({CAP}::DOUBLE * m.words) OVER (PARTITION BY m.source ORDER BY m.base DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / nullif(sum(m.base * m.words) OVER (PARTITION BY m.source ORDER BY m.base DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS tilt
      FROM m JOIN t ON m.source IS NOT DISTINCT FROM t.source),
x AS (SELECT source, arg_max(tilt, base) FILTER (WHERE tilt * base < {CAP}) AS tilt FROM k GROUP BY source),
r2 AS (SELECT b.doc_id, b.source, b.size, t.source_size, t.target, least({CAP}::DOUBLE, coalesce(b.base * x.tilt, {CAP}::DOUBLE)) AS rate,
        md5(coalesce(b.doc_id::VARCHAR, '')) AS digest
      FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source JOIN x ON b.source IS NOT DISTINCT FROM x.source),
o2 AS (SELECT *, floor(rate)::BIGINT AS whole, CASE WHEN rate > floor(rate)
        THEN (('0x' || substr(digest, 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE) / (rate - floor(rate)) END AS place FROM r2),
g AS (SELECT *, sum(whole * size) OVER (PARTITION BY source) AS given,
        coalesce(sum(CASE WHEN place IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place NULLS FIRST, digest, size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o2)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN place IS NULL THEN 0 ELSE least(size, greatest(0, round(target)::BIGINT - given - ahead)) END)::BIGINT AS taken FROM g
"""
