"""Chat formatting by multi-party perspective rotation (operator 10). DataFrame operations only.

Every participant of a conversation gets the dialogue rendered with itself as the assistant and all others as named
users; what the assistant says carries the loss mask. Instructions (role ``system``) stay what they are and have no
perspective of their own.

Turns are numbered without gathering a conversation: a range partitioning in dialogue order gives each turn its place in
its partition, and the sums of a conversation's turns in the partitions before give the rest. Texts are gathered in parts of a
bounded number of turns; where a part begins in each perspective comes from counts, so no rendered text is moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.plans.checkpoints import cut

#: Turns of a conversation that are rendered into one row; longer ones go on in further rows.
TURNS = 256
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(c: F.Column) -> F.Column:
    """Text that holds no mark of its own."""
    return F.regexp_replace(c, "<\\|", "< |")


def _named(c: F.Column) -> F.Column:
    """The header of a user; a name stays in its line."""
    return F.concat(F.lit(f"{OPEN}user name="), F.regexp_replace(_plain(c), "[\\r\\n]+", " "), F.lit("\n"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", turns: int = TURNS) -> DataFrame:
    """``(conv, participant, part, n_turns, start_char, n_chars, n_loss_chars, masks, text)``.

    One row for a conversation, a participant and each ``turns`` turns in dialogue order; the texts of the parts in order are
    the whole dialogue, ``start_char`` is where a part begins in it. ``masks`` are the character spans in the part's text
    that carry loss: the assistant's words and the mark that ends them. ``<|`` inside a turn or a name is written ``< |``, and
    line ends inside a name become a space, so that neither can open or close a turn. A null role is the participant
    ``unknown``, a null text is empty, a null turn stands first; a null conversation is one of its own. Turns of one
    number are ordered by role and digest of the text, repeated rows stay. A conversation of instructions only has no
    participant and no row, nor has an empty table. No row holds more than ``turns`` turns.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("id"),
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("unknown")).alias("role"),
        _plain(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("said"),
    )
    rows = cut(rows)
    order = ["conv", "turn", "role", "digest", "id"]
    thin = rows.select("id", "conv", "turn", "role", F.md5("said").alias("digest"), F.length("said").alias("len"))
    dealt = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.select("id", "conv", "role", "len", F.spark_partition_id().alias("slot"), F.monotonically_increasing_id().alias("at")))
    slots = placed.groupBy("conv", "slot").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("conv").alias("c"), F.col("slot").alias("s"), (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("from"))
    numbered = placed.join(slots, F.col("conv").eqNullSafe(F.col("c")) & (F.col("slot") == F.col("s")))
    numbered = cut(numbered.select("id", "conv", "role", "len", (F.col("at") + F.col("from")).alias("nr")).withColumn("part", F.floor(F.col("nr") / turns).cast("long")))

    head = F.when(F.col("role") == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(_named(F.col("role")))
    counts = numbered.groupBy("conv", "part", "role").agg(F.count("*").alias("n"), F.sum("len").alias("len"))
    counts = cut(counts.withColumn("chars", F.col("len") + F.col("n") * (F.length(head) + len(CLOSE) + 1)))
    whole = counts.groupBy("conv", "part").agg(F.sum("chars").alias("chars"), F.sum("n").alias("n_turns"))
    people = counts.where(F.col("role") != SYSTEM).select(F.col("conv").alias("c"), F.col("role").alias("participant")).distinct()
    own = counts.select(F.col("conv").alias("o"), F.col("part").alias("p"), F.col("role").alias("r"), F.col("n").alias("own"))
    views = whole.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    views = views.join(own, F.col("conv").eqNullSafe(F.col("o")) & (F.col("part") == F.col("p")) & (F.col("participant") == F.col("r")), "left")
    less = F.length(_named(F.col("participant"))) - len(f"{OPEN}assistant\n")
    views = views.withColumn("n_chars", F.col("chars") - F.coalesce(F.col("own"), F.lit(0)) * less)
    before = Window.partitionBy("conv", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    views = views.select(F.col("conv").alias("c"), F.col("part").alias("p"), "participant", "n_turns", "n_chars", F.coalesce(F.sum("n_chars").over(before), F.lit(0)).alias("start_char"))

    said = rows.select("id", "said").join(numbered.select("id", "conv", "part", "nr", "role"), "id")
    parts = said.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("nr", "role", "said"))).alias("lines"))
    seen = parts.join(views, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))

    def line(x: F.Column) -> F.Column:
        mine = x["role"] == F.col("participant")
        head = F.when(x["role"] == SYSTEM, F.lit(f"{OPEN}system\n")).when(mine, F.lit(f"{OPEN}assistant\n")).otherwise(_named(x["role"]))
        return F.struct(F.length(head).alias("head"), (F.length(x["said"]) + len(CLOSE)).alias("body"), (mine & (x["role"] != SYSTEM)).alias("own"), F.concat(head, x["said"], F.lit(f"{CLOSE}\n")).alias("shown"))

    step = F.aggregate(
        "shown",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + x["head"] + x["body"] + 1).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("stop"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    done = seen.withColumn("shown", F.transform("lines", line)).withColumn("state", step)
    return done.select(
        F.col("conv").alias(conv),
        "participant",
        "part",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.col("start_char").cast("long").alias("start_char"),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.aggregate("state.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_loss_chars"),
        F.col("state.spans").alias("masks"),
        F.array_join(F.transform("shown", lambda x: x["shown"]), "").alias("text"),
    )


ORACLE = f"""
WITH d AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(said)) - 1)::BIGINT AS nr FROM d),
p AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
s AS (SELECT t.*, nr // {TURNS} AS part, p.participant, t.role = p.participant AS own,
        CASE WHEN t.role = 'system' THEN '{OPEN}system' WHEN t.role = p.participant THEN '{OPEN}assistant'
             ELSE '{OPEN}user name=' || regexp_replace(replace(t.role, '<|', '< |'), '[\\r\\n]+', ' ', 'g') END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
l AS (SELECT *, length(head) AS h, length(said) + {len(CLOSE)} AS b, head || said || '{CLOSE}' || chr(10) AS shown,
        coalesce(sum(length(head) + length(said) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id, participant, part
          ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s),
g AS (SELECT conv_id, participant, part, count(*)::BIGINT AS n_turns, sum(h + b + 1)::BIGINT AS n_chars,
        coalesce(sum(b) FILTER (WHERE own), 0)::BIGINT AS n_loss_chars,
        coalesce(string_agg((before + h)::VARCHAR || '-' || (before + h + b)::VARCHAR, ',' ORDER BY nr) FILTER (WHERE own), '') AS mask_spans,
        string_agg(shown, '' ORDER BY nr) AS text
      FROM l GROUP BY ALL)
SELECT conv_id, participant, part, n_turns, coalesce(sum(n_chars) OVER (PARTITION BY conv_id, participant ORDER BY part
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, n_chars, n_loss_chars, mask_spans, text
FROM g
"""
