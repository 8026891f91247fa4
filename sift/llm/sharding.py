"""Sharding: contiguous shards of nearly equal bytes from global prefix sums.

Rows keep the order of their id. Each range of ids reports its bytes and rows;
the running sums of those totals (one row per range) are added to the running
sums inside each range, which gives every row its global byte offset and row
number. A row belongs to the shard whose equal target its first byte falls in,
so a shard differs from the target by at most one row at each end.

Defined results: a null text has no bytes (size 1, CRC of no bytes); null ids
come first; rows with equal ids are ordered by size, then CRC (rows equal in
all three are alike). An empty table gives no rows. Extra columns
are ignored (``start * n_shards`` must fit in a long). Only narrow rows (id, size, CRC) are shuffled, never texts, and
hot sources or copies do not matter, as ranges are cut by id rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import materialize, order_buckets, order_key, partitions


def byte_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot, start`` of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spark = docs.sparkSession
    rows = materialize(docs.select(
        F.col(id_col).alias("id"), order_key(id_col).alias("k"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")), "sizes")
    cuts = order_buckets(rows, F.col("k"), 4 * partitions(spark))
    rows = rows.withColumn("bucket", cuts.of(F.col("k")))
    totals = (rows.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
              .orderBy("bucket").collect())  # one row per range
    offsets, b, n = [], 0, 0
    for t in totals:
        offsets.append((t["bucket"], b, n))
        b, n = b + t["bytes"], n + t["n"]
    total = max(b, 1)
    offsets = spark.createDataFrame(offsets, "bucket int, bytes_before long, rows_before long")
    w = Window.partitionBy("bucket").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    placed = materialize(
        rows.withColumn("run", F.sum("size").over(w)).withColumn("rn", F.count(F.lit(1)).over(w))
        .join(F.broadcast(offsets), "bucket")  # at most one row per range
        .select("id", "size", "crc", (F.col("bytes_before") + F.col("run") - F.col("size")).alias("start"),
                (F.col("rows_before") + F.col("rn") - 1).alias("row"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(start * {n_shards}) div {total}")).cast("int")),
        "shards")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(firsts), "shard")
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("row") - F.col("first")).alias("slot"), "start"))
