"""Canonical entities out of surfaces, and their attachment to capsules; genericness of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.config import Config
from lattica.functions import lexicons as L
from lattica.functions import text as T
from lattica.operators.components import connected_components
from lattica.operators.segmentation import numbered_by_range


def surface_counts(capsules: DataFrame, titles: DataFrame, config: Config = Config()) -> DataFrame:
    """``(surface, freq, is_title)``: valid surfaces of arguments and titles with the times they are used.

    Surfaces without an upper-case letter need at least ``min_freq_lowercase`` uses and few words, unless they are titles.
    """
    used = capsules.select(F.explode("arguments.surface").alias("surface"), F.lit(0).alias("t"))
    both = used.unionByName(titles.select(F.col("title").alias("surface"), F.lit(1).alias("t")))
    counts = both.where(T.is_valid_entity_surface("surface")).groupBy(F.trim("surface").alias("surface")).agg(F.count("*").alias("freq"), F.max("t").alias("is_title"))
    named = F.col("surface").rlike(r"\p{Lu}") | (F.col("is_title") == 1)
    common = (T.word_count("surface") <= config.max_tokens_lowercase) & (F.col("freq") >= config.min_freq_lowercase)
    return counts.where(named | common)


def entity_clusters(surfaces: DataFrame, config: Config = Config()) -> DataFrame:
    """``(surface, freq, is_title, cluster)``: surfaces that share a normal form, or a first and last name, are one.

    Keys, not pairs, are the other side of the graph, so a cluster of any size has as many edges as it has surfaces.
    Cluster names are the smallest normal form.
    """
    norm = surfaces.withColumn("norm", T.normalize_entity("surface")).where(F.col("norm") != "")
    if not config.person_merge:
        return norm.withColumn("cluster", F.col("norm"))
    person = norm.select("norm", T.person_key("surface").alias("person")).where(F.col("person").isNotNull()).distinct()
    shared = person.groupBy("person").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where(F.col("low") != F.col("high"))
    edges = person.join(shared, "person").select(F.col("norm").alias("src"), F.col("low").alias("dst"))
    parts = connected_components(edges)
    return norm.join(parts, norm["norm"] == parts["node"], "left").withColumn("cluster", F.coalesce("component", "norm")).drop("node", "component")


def entities(clusters: DataFrame) -> DataFrame:
    """``(entity_id, canonical_name, aliases, freq)``, numbered by falling frequency, then by name.

    The name is the title among the aliases that sorts first, else the most frequent, then shortest, then first alias.
    """
    best = F.struct(-F.col("is_title"), F.when(F.col("is_title") == 1, 0).otherwise(-F.col("freq")), F.when(F.col("is_title") == 1, 0).otherwise(F.length("surface")), F.col("surface"))
    grouped = clusters.groupBy("cluster").agg(
        F.min_by("surface", best).alias("canonical_name"), F.sort_array(F.collect_set("surface")).alias("aliases"), F.sum("freq").alias("freq")
    )
    rows = numbered_by_range(grouped, [-F.col("freq"), F.lower("canonical_name"), F.col("canonical_name")], "nr")
    return rows.withColumn("entity_id", F.format_string("E_%07d", "nr")).select("entity_id", "canonical_name", "aliases", "freq", "cluster")


def alias_index(entities_: DataFrame) -> DataFrame:
    """``(norm, entity_id)``: the first entity of each normalised alias or name."""
    names = F.explode(F.array_union("aliases", F.array("canonical_name")))
    rows = entities_.select("entity_id", names.alias("alias")).select(T.normalize_entity("alias").alias("norm"), "entity_id")
    return rows.where(F.col("norm") != "").groupBy("norm").agg(F.min("entity_id").alias("entity_id"))


def attach_entities(capsules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Capsules whose arguments have an ``entity_id`` (null if there is none), with ``entity_ids``, distinct and sorted.

    Pronouns stand for the entity of the document's title.
    """
    rows = capsules.select("capsule_id", "title", F.posexplode("arguments").alias("i", "a"))
    pronoun = F.lower(F.trim("a.surface")).isin(L.LINKED_PRONOUNS)
    keyed = rows.select("capsule_id", "i", "a", T.normalize_entity(F.when(pronoun, F.col("title")).otherwise(F.col("a.surface"))).alias("norm"))
    met = keyed.join(aliases, "norm", "left")
    told = F.array_sort(F.collect_list(F.struct("i", F.col("a.role").alias("role"), F.col("a.surface").alias("surface"), "entity_id")))
    ids = met.groupBy("capsule_id").agg(told.alias("told"), F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    out = capsules.join(ids, "capsule_id", "left")
    named = F.transform("told", lambda t: F.struct(t["role"].alias("role"), t["surface"].alias("surface"), t["entity_id"].alias("entity_id")))
    empty = F.array().cast("array<struct<role:string,surface:string,entity_id:string>>")
    return out.withColumns({"arguments": F.coalesce(named, empty), "entity_ids": F.coalesce("entity_ids", F.array().cast("array<string>"))}).drop("told")


def title_idf(titles: DataFrame) -> DataFrame:
    """``(token, df, idf)`` over title rows; a token counts once a title."""
    n = titles.agg(F.count("*").alias("n"))
    df = titles.select(F.explode(F.array_distinct(T.tokenize_title("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def title_genericness(titles: DataFrame, key: str, snippet: str = "text") -> DataFrame:
    """``(key, title, avg_idf, stop_ratio, genericness)`` of every title row. The broadcast tables have one row each."""
    idf = title_idf(titles)
    scale = idf.agg(F.percentile("idf", 0.1).alias("p10"), F.percentile("idf", 0.9).alias("p90"))
    words = titles.select(key, F.explode(T.tokenize_title("title")).alias("token")).where(~F.col("token").isin(L.TITLE_STOPWORDS))
    avg = words.join(idf, "token", "left").groupBy(key).agg(F.avg("idf").alias("avg_idf"))
    rows = titles.join(avg, key, "left").withColumn("avg_idf", F.coalesce("avg_idf", F.lit(0.0))).join(F.broadcast(scale))
    score = T.genericness("title", F.col("avg_idf"), F.col("p10"), F.col("p90"), snippet)
    return rows.select(key, "title", "avg_idf", T.title_stopword_ratio("title").alias("stop_ratio"), score.alias("genericness"))
