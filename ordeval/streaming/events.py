"""Extension (the reference has no streaming): daily event counts with a watermark, drained once."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordeval.sources.shared import new_path


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each day and type; rows later than the watermark are left out of closed days."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("day"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("day.start").alias("day"), "event_type", "n", "total")
    )


def drained_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Everything that is there now, through the streaming engine, with its checkpoint in the shared folder.

    The update mode's last row of each day and type is its count.
    """
    at = new_path(spark, "stream")
    schema = spark.read.parquet(path).schema
    # a single file can't be watched, its folder with a name filter can
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    query = daily_counts(source).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    last = F.max_by(F.struct("n", "total"), "batch").alias("x")
    return rows.groupBy("day", "event_type").agg(last).select("day", "event_type", "x.n", F.round("x.total", 6).alias("total"))
