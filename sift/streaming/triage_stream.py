"""Incremental triage of newly landed post files.

``readStream`` over a folder of JSON post files (explicit schema) ->
``foreachBatch``: batch triage (D13) -> first-write-wins append (A14) into a
parquet log folder. Key uniqueness comes from A14's anti join against what
is stored, not from streaming ``dropDuplicates`` (which would keep every id
in state for ever). Each micro-batch writes to its own ``batch_id=`` folder
in overwrite mode, so a batch replayed after a failure replaces its own
output. The folder is named by the id that the stream keeps in its checkpoint
and the batch number, so a new checkpoint or a second stream into the same log
folder (one at a time) adds to what is stored. Of equal ids in one batch the
post whose file landed first wins. ``trigger(availableNow=True)`` processes what has landed and stops,
which is the streaming form of the reference's daily job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sift.operators.store import append_first_write
from sift.operators.triage import batch_triage, sweep_log_rows
from sift.schemas import POST


def run_incremental_triage(spark: SparkSession, landing_dir: str, log_dir: str, checkpoint: str,
                           scorer=None, **triage_kw):
    """Process all files landed so far; returns the finished query."""
    stream = (spark.readStream.schema(POST).json(landing_dir)
              .withColumn("__landed", F.col("_metadata.file_modification_time")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        stream_id = spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]
        t = batch_triage(batch, scorer, "text", **triage_kw)
        rows = sweep_log_rows(t, "text", keep=[F.col("__landed").alias("arrival")])
        append_first_write(spark, rows, log_dir, f"{stream_id}-{batch_id}")

    q = (stream.writeStream.foreachBatch(handle)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
