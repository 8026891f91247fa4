"""Parallelism for CPU-heavy narrow stages.

Text operators are CPU-bound per row. A table stored as one large
unsplittable file (one parquet row group) arrives as one input partition
and would run every regex on one core. ``spread`` hash-partitions such an
input by its row key when it has fewer partitions than the cluster has
cores; on large inputs (many splits) it is a no-op, so no shuffle is added
at scale. Hash partitioning on a key (not round-robin) keeps task retries
deterministic after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, salt_by: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with a lookup ``table`` (one row a key) whose keys may
    each occur in a large share of the rows: the table is repeated ``SALTS``
    times, and a row picks its copy by a hash of ``salt_by``."""
    copies = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*([salt_by] if isinstance(salt_by, str) else salt_by)), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the column ``name`` computed once, where it stands. The optimizer
    moves a later filter on it (or on what derives from it) below the projections and
    writes the whole expression out at each use; it does not look
    through a generator, and exploding a one-element array keeps each row."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(name)).alias(name)).select(*df.columns)


def spread(df: DataFrame, key: str, min_partitions: int | None = None) -> DataFrame:
    sc = df.sparkSession.sparkContext
    target = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
