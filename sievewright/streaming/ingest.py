"""Documents and events that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, index
from ..sources import files

DOCUMENTS = "rel_path string, text string"


def ingest(spark, landing: str, store: str, checkpoint: str, strategy: str = "recursive", size: int = 512, overlap: int = 64, dim: int = 256):
    """A query that chunks and embeds documents as their files land, and adds those whose ids the store lacks.

    Ids come from content places, so a batch that is run again adds nothing twice.
    """
    incoming = spark.readStream.schema(DOCUMENTS).parquet(landing)

    def add(batch: DataFrame, _: int) -> None:
        # One batch is read for its chunks and for its vectors.
        chunks = chunking.chunk(batch, strategy, size, overlap).dropDuplicates(["chunk_id"])
        known = files.read_or_empty(batch.sparkSession, f"{store}/vectors", "chunk_id string, point_id string, embedding array<double>")
        new = chunks.join(known.select("chunk_id"), "chunk_id", "left_anti").persist()
        new.write.mode("append").parquet(f"{store}/chunks")
        index.embed(new, dim).write.mode("append").parquet(f"{store}/vectors")
        new.unpersist()

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by window and kind; rows later than `late` are left out when it runs as a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        rows.groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )
