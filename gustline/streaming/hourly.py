"""An hourly panel from a stream of events, with a watermark for late ones (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.shared import fresh_path


def hourly_stream(events: DataFrame, key: str, time: str, value: str, late: str = "2 hours") -> DataFrame:
    """(key, hour, total, n) of a stream; hours close when the watermark passes them."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    sums = stamped.groupBy(F.window("_t", "1 hour"), key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.select(key, F.col("window.start").alias("hour"), "total", "n")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table (one file, or a folder of part files), read as a stream of its files and caught up once, as (event_type, hour, total, n).

    Each micro-batch writes the whole result as a table of its own in the shared folder, which also holds the stream's state; the last one is returned.
    """
    source, out = f"{sf_dir}/events.parquet", fresh_path(spark, "hourly")
    only = f"{sf_dir}/events.parque[t]"  # a stream takes a plain path for a folder; as a pattern, the same name may also be a file
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(only)
    sums = hourly_stream(stream, "event_type", "ts", "value")
    sums = sums.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "total", "n")
    written = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")
        written.append(batch)

    query = sums.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/state").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        raise ValueError(f"the stream found no file in {source}")
    return spark.read.schema(sums.schema).parquet(f"{out}/{written[-1]}")
