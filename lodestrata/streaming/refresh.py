"""Structured Streaming: index refresh from arriving chunk files, windows and deduplication over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestrata.operators import indexing


def refresh_index(spark: SparkSession, incoming: str, schema: StructType, index: str, checkpoint: str, id_col: str = "id") -> StreamingQuery:
    """Upserts every batch of arriving chunk files into a versioned index and ends when none is left.

    The version is the batch number, so a batch that is repeated after a failure writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([id_col])
        if number > 0:
            fresh = indexing.upsert(indexing.read_version(batch.sparkSession, index, number - 1), fresh, id_col)
        fresh.write.mode("overwrite").parquet(f"{index}/v={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, ts_col: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums of events by type in tumbling or sliding windows, late rows up to ``late`` included. For streams and tables alike."""
    e = events.withColumn("_t", F.col(ts_col).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("_t", late)
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def first_seen_events(events: DataFrame, id_col: str = "event_id", ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Every event once; a stream keeps ids for ``late`` only."""
    if events.isStreaming:
        return events.withColumn("_t", F.col(ts_col).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([id_col]).drop("_t")
    return events.dropDuplicates([id_col])


def drain(df: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming frame over what has arrived and returns the result, which lies as Parquet in ``folder`` and never on the driver.

    In complete mode every batch writes a version and the last one counts; in append mode all batches together are the result. A batch that is
    repeated after a failure writes its own version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress
    spark = df.sparkSession
    if not last:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{folder}/batch={last['batchId']}")
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)
