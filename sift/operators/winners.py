"""One full row per key, without carrying full rows through an aggregate.

``min(struct(order, ..., text))`` cannot use hash aggregation (structs and
strings have no fixed-size buffer), so it sorts whole rows. Here the
order and a hash of the row are packed into one decimal(38), whose minimum per key is a
hash aggregate over two narrow columns; the winning rows are then picked by
an equi-join on key and packed value. Columns that a later
step does not read (the text, say) are pruned from both sides. A hot key is combined
map-side in the first step and spread by the packed value in the second.

Ties of the order go to the row with the smaller hash, null orders come first,
null keys are a key, and wholly equal rows are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LONG = -(2**63)


def _as_long(df: DataFrame, order_col: str) -> Column | None:
    kind, c = df.schema[order_col].dataType, F.col(order_col)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    return None


def _packed(df: DataFrame, key: str, order_col: str, tie_cols: list[str], last: bool) -> Column:
    tie = F.xxhash64(*tie_cols) if tie_cols else F.lit(0).cast("long")
    long = _as_long(df, order_col)
    if long is None:  # other types: a narrow struct, still without the row
        return F.struct(F.col(order_col).alias("o"), tie.alias("t"))
    order = F.coalesce(long, F.lit(MIN_LONG)).cast("decimal(19,0)")
    # 2**63 steps an order; the hash loses its sign bit
    tie = F.shiftrightunsigned(tie, 1).cast("decimal(19,0)")
    packed = (order * F.expr("9223372036854775808BD")).cast("decimal(38,0)")
    return (packed - tie if last else packed + tie).cast("decimal(38,0)")


def one_per_key(df: DataFrame, key: str, order_col: str, last: bool = False, unique_order: bool = False) -> DataFrame:
    """The row with the smallest (``last``: largest) ``order_col`` of each ``key``.
    ``unique_order``: no two rows of a key share an order, so nothing breaks ties."""
    ties = [] if unique_order else [f.name for f in df.schema if f.name not in (key, order_col) and not _has_map(f.dataType)]
    marked = df.withColumn("__p", _packed(df, key, order_col, ties, last))
    best = marked.groupBy(key).agg((F.max if last else F.min)("__p").alias("__best"))
    best = best.select(F.col(key).alias("__key"), "__best")
    won = marked.join(best, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__best"))).select(*df.columns)
    return won if unique_order or any(_has_map(f.dataType) for f in df.schema) else won.distinct()


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))
