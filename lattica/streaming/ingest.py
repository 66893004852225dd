"""Incremental ingestion: new documents of a stream become passages of the index tables.

Their capsules, entities and edges are not made; they come with the next ``Engine.index`` over the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.config import Config
from lattica.functions.vectors import embed
from lattica.operators.segmentation import corpus, passages


def ingest(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, config: Config = Config()):
    """A query that appends the passages, with vectors, of documents arriving as Parquet files in ``source``.

    Batches are written under their number, so one that is repeated after a failure overwrites itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = passages(corpus(batch), config)
        made = made.join(embed(made, "passage_id", "text", config.dim), "passage_id")
        made.write.mode("overwrite").parquet(f"{folder}/passages/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
