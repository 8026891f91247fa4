"""Rows with the part of a large table that they need, block by block.

A join of every text with every table row that it holds makes more rows than
there is text: words or terms repeat from text to text. Here rows are dealt
into blocks of about ``BLOCK_BYTES``; a block asks once for each table row that
any of its texts needs, and one task then meets a block's table rows
followed by its rows, and looks the one up in the other. What is shuffled is the
rows twice and, a block, the distinct table rows, so it grows with the
input; nothing is shuffled per hit.

Rows are written once to the shared checkpoint folder, with the number that
deals them out: both passes then read the same rows, whatever made them, and equal
rows go to different blocks. Columns of any type that Arrow and Parquet carry pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.session import stored

BLOCK_BYTES = 16 << 20


def _per_block(look: Callable, args: list[str | int]):
    """A block's table rows come first, in their order; ``look`` makes of them what maps rows."""
    def run(batches):
        block, held, found = None, [], None
        for b in batches:
            at, is_row = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if at[lo] != block:
                    block, held, found = at[lo], [b.column(2).slice(0, 0)], None
                if not is_row[lo]:
                    held.append(b.column(2).slice(lo, hi - lo))
                    continue
                if found is None:
                    found, held = look(pa.concat_arrays(held)), []
                rows = b.column(3).slice(lo, hi - lo)
                for first, cols in found(*[rows.field(a) if isinstance(a, str) else b.column(a).slice(lo, hi - lo) for a in args]):
                    yield pa.RecordBatch.from_arrays([rows.slice(first, len(cols[0])), *cols], ["row", *[f"c{i}" for i in range(len(cols))]])
    return run


def in_blocks(df: DataFrame, size: Column, wanted: Callable[[DataFrame], DataFrame], table: DataFrame, look: Callable,
              args: list[str | Callable[[Callable[[str], Column]], Column]], fields: list[tuple[str, str]]) -> DataFrame:
    """``df`` with ``fields`` (name, type), which must be new names.

    ``size`` is about the bytes of a row's text. ``wanted`` maps rows that lie together by
    ``__block`` to distinct ``__block, __h``. ``table`` has ``__h`` and a struct ``__p``.
    ``look(p)`` gets a block's ``__p`` (an Arrow array in ascending order) and returns
    a function from the ``args`` (Arrow arrays: columns, or what is made of them) of its rows to (first row, columns of ``fields``)
    pieces in order."""
    held = stored(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"),
                            F.xxhash64(F.monotonically_increasing_id()).alias("__deal")), "sift-blocks", "zstd")
    total = held.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("n")).first()["n"]
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_BYTES))
    dealt = held.select(F.pmod("__deal", F.lit(n)).cast("int").alias("__block"), "__row")
    of_row = lambda c: F.col("__row")[c]
    rows = dealt.select("__block", *[(of_row(a) if isinstance(a, str) else a(of_row)).alias(f"__a{i}") for i, a in enumerate(args)])
    asked = wanted(rows.repartitionById(n, "__block")).join(table, "__h")
    row_type, p_type = (dict(x.dtypes)[c] for x, c in ((held, "__row"), (table, "__p")))
    both = (asked.select("__block", F.lit(False).alias("__is_row"), "__p", F.lit(None).cast(held.schema["__row"].dataType).alias("__row"))
            .unionByName(dealt.select("__block", F.lit(True).alias("__is_row"), F.lit(None).cast(table.schema["__p"].dataType).alias("__p"), "__row")))
    ready = both.repartitionById(n, "__block").sortWithinPartitions("__block", "__is_row", "__p")
    made = [a for a in args if not isinstance(a, str)]  # columns go to the workers once, within the row
    ready = ready.select("*", *[a(of_row).alias(f"__a{i}") for i, a in enumerate(made)])
    at = [a if isinstance(a, str) else 4 + made.index(a) for a in args]
    schema = held.select("__row").schema
    for name, kind in fields:
        schema = schema.add(name, kind)
    out = ready.mapInArrow(_per_block(look, at), schema)
    return out.select(*[F.col("__row")[c].alias(c) for c in df.columns], *[name for name, _ in fields])
