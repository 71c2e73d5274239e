"""Incremental ingest: new files in, articles and drop counts out, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters
from ..sources.manifests import write_articles


def follow(spark: SparkSession, raw: str, schema: str, adapter: Callable[[DataFrame], DataFrame], out: str, counts: str, checkpoint: str, every: str | None = None, files: int = 64):
    """Starts a query over a folder of Parquet files.  Without `every` it takes what is there and stops.  The checkpoint
    remembers finished files, as a manifest would; a batch is written under its own number, so a batch that is run again
    after a crash replaces its own rows and none are doubled."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = adapter(df).persist()
        try:
            kept = adapters.keep(rows).withColumn("epoch", F.lit(epoch))
            kept.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/epoch={epoch}")
            adapters.drop_counts(rows).write.mode("overwrite").parquet(f"{counts}/epoch={epoch}")
        finally:
            rows.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(raw)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compact(spark: SparkSession, out: str, to: str) -> None:
    """All batches as one table by source and year, replays folded by article id."""
    df = spark.read.parquet(out).drop("epoch")
    write_articles(df.dropDuplicates(["article_id"]), to, "overwrite")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """An extension for event tables, batch or stream: counts and sums in one-hour windows with a watermark."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if own.isStreaming else own
    return own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
