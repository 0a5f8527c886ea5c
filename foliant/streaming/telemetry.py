"""Telemetry as a stream: newest attempt per sample, windowed failure rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant import schemas
from foliant.operators.corpus import latest
from foliant.sources.shared import BucketTable


def stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Attempts as they are appended to a folder of JSON lines."""
    return spark.readStream.schema(schemas.TELEMETRY).option("maxFilesPerTrigger", max_files).json(path)


def failure_rates(attempts: DataFrame, width: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(window, candidate, pages, errors, truncated) by event time; rows later than `late` behind are dropped, so state
    is bounded."""
    timed = attempts.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "candidate").agg(
        F.count("*").alias("pages"), F.sum(F.col("error").isNotNull().cast("int")).alias("errors"), F.sum(F.coalesce(F.col("finish_reason") == "length", F.lit(False)).cast("int")).alias("truncated")
    )


def stored(spark: SparkSession, target: str) -> DataFrame | None:
    """What `keep_latest` has kept so far; null before the first batch."""
    return BucketTable(spark, target).read()


def keep_latest(attempts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest attempt per candidate and sample in `target`: each micro-batch is merged with the buckets that it
    touches, which are written anew and then made current. Late rows take part; a batch that is run again gives the same
    table."""

    def merge(batch: DataFrame, number: int) -> None:
        table = BucketTable(batch.sparkSession, target)
        fresh = batch.withColumn("bucket", table.bucket("candidate", "sample_id"))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most as many as buckets
        before = table.read(only=touched)
        rows = batch if before is None else batch.unionByName(before, allowMissingColumns=True)
        newest = latest(rows, ["candidate", "sample_id"], ["ts"], "attempts").select(*batch.columns)
        table.replace(newest.withColumn("bucket", table.bucket("candidate", "sample_id")), touched, ["candidate", "sample_id"], f"batch-{number}")

    return attempts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
