"""Components of stored links, and joins with tables whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.common import materialize

HOT_KEYS = 1000  # bounds the broadcast of ``attach``


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every linked node of the pairs ``a, b``: the smallest node it reaches.

    Each round hooks a node to the smallest label around it, then to that
    label's own label, over edges whose ends are replaced by their labels, so
    both path lengths and edges shrink; a hub is met once per neighbour and
    its rows are combined before the shuffle."""
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]  # noqa: E731  an edge is one row
    around = lambda e: e.union(e.select("b", "a")).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"))
    edges = materialize(links.select(*pair("a", "b")).filter("a <> b").distinct(), "edges")
    now = materialize(around(edges).toDF("node", "label"), "labels")
    while True:
        # follow labels to the end: every label is smaller than its node, so these are trees
        while True:
            far = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = materialize(now.join(far, "label").select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")), "labels")
            now = step.select("node", "label")
            if not step.filter("moved").limit(1).count():
                break
        of = lambda c: now.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        edges = materialize(edges.join(of("a"), "a").join(of("b"), "b").select(*pair("la", "lb"))
                            .filter("a <> b").distinct(), "edges")
        if not edges.limit(1).count():
            return now
        # roots that still touch another component hook to the smallest around them
        hooks = around(edges).withColumnRenamed("a", "label")
        now = materialize(now.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def attach(rows: DataFrame, table: DataFrame, key: str, values: list[str], n: str = "rows") -> DataFrame:
    """``rows`` with ``values`` of ``table`` (one row a key, whose column ``n`` counts the
    rows of the key). Keys of a thousandth of all rows or more, of which there
    are at most ``HOT_KEYS``, are broadcast, so no task gets all of their rows."""
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_KEYS >= total
    hot = table.filter(is_hot).select(key, *values)
    cold = table.filter(~is_hot).select(key, *values)
    return (rows.join(F.broadcast(hot), key).select(*rows.columns, *values)
            .union(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key).select(*rows.columns, *values)))
