"""Resumable append: new records are appended exactly once per text, over any number of restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(spark: SparkSession, source: str, schema, key: str, out: str, checkpoint: str, files_per_batch: int = 4, time: str | None = None, late: str = "180 days") -> DataFrame:
    """Run over all files that are there, appending the first record of each key; returns the table written so far.

    The state (a 128-bit hash per key, not the key) and the position in the source live in ``checkpoint``; a second run reads
    only new files.  With an event ``time`` a key is remembered for ``late`` beyond the latest time seen, so the state stays
    bounded; without it for ever.  The file sink commits each batch once, so a failed batch leaves no rows.  Null keys count
    as one key.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    hashed = rows.withColumn("__key", F.coalesce(F.md5(F.col(key).cast("string")), F.lit("")))
    first = hashed.withWatermark(time, late).dropDuplicatesWithinWatermark(["__key"]) if time else hashed.dropDuplicates(["__key"])
    query = first.drop("__key").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def counts_by_window(spark: SparkSession, source: str, schema, time: str, key: str, out: str, checkpoint: str, window: str = "1 day", late: str = "180 days") -> DataFrame:
    """Events per time window and key, with late events counted up to the watermark.

    Each batch writes only the counts it changed, and windows behind the watermark leave the state; the last count of a
    window is the one that holds.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    counts = rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"))
    counts = counts.select(F.col("w.start").alias("start"), key, "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(f"start timestamp, {key} string, n long, batch long").parquet(out)
    return done.groupBy("start", key).agg(F.max_by("n", "batch").alias("n"))
