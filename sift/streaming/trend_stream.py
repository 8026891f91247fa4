"""Streaming daily trend (count per day x label) over landed log rows.

Event time is the log ``timestamp``; a one-day watermark bounds the state.
Unlike the batch trend (F5), rows later than the watermark are dropped, and
in append mode a day is emitted only once the watermark passes it; complete
mode emits every day seen (used to check equality with the batch trend).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sift.schemas import ANALYSIS_LOG


def trend_stream(spark: SparkSession, log_dir: str, watermark: str = "1 day"):
    logs = spark.readStream.schema(ANALYSIS_LOG).parquet(log_dir)
    return (logs.withColumn("ts", F.col("timestamp").cast("timestamp"))
            .withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 day").alias("w"), F.col("predicted_label"))
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.to_date(F.col("w.start")).alias("dt"), "predicted_label", "n"))


def run_trend(spark: SparkSession, log_dir: str, out_dir: str, checkpoint: str):
    """Write the windowed counts to parquet (append) and stop when caught up."""
    q = (trend_stream(spark, log_dir).writeStream.outputMode("append").format("parquet")
         .option("path", out_dir).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
