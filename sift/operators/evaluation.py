"""Classifier evaluation: F10-F15, H4, H6.

Inputs are prediction rows ``(true_label, pred_label, max_prob, entropy,
correct)``. Everything is a grouped aggregate over a tiny key space (labels
x labels), so Spark's partial aggregation reduces each task to a handful of
rows before the single small shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.schemas import DEFAULT_SCHEME, LabelScheme


def confusion(pred: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, t: str = "true_label",
              p: str = "pred_label") -> DataFrame:
    """counts for every (true, pred) pair including zeros, and the
    row-normalised share (4 dp)."""
    labels = list(scheme.labels)
    spark = pred.sparkSession
    grid = (spark.createDataFrame([(a, b) for a in labels for b in labels], f"{t} string, {p} string"))
    counts = pred.groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))
    g = F.broadcast(grid).join(counts, [t, p], "left").na.fill(0, ["n"])
    row_total = F.sum("n").over(Window.partitionBy(t))
    return g.withColumn("row_share", F.when(row_total > 0, F.round(F.col("n") / row_total, 4)).otherwise(0.0))


def crosstab_margins(pred: DataFrame, t: str = "true_label", p: str = "pred_label") -> DataFrame:
    """``cube`` counts; 'All' marks margin rows/columns (told by
    ``grouping``, so a null label keeps its own row)."""
    name = lambda c: F.when(F.col(f"__all_{c}") == 1, F.lit("All")).otherwise(F.col(c)).alias(c)
    return (pred.cube(t, p).agg(F.count(F.lit(1)).alias("n"), F.grouping(t).alias(f"__all_{t}"), F.grouping(p).alias(f"__all_{p}"))
            .select(name(t), name(p), "n"))


def class_report(pred: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, t: str = "true_label",
                 p: str = "pred_label") -> DataFrame:
    """per class precision, recall, F1, support (zero division -> 0),
    plus accuracy, macro avg and weighted avg rows. Rounded to 4 dp."""
    labels = list(scheme.labels)
    aggs = []
    for l in labels:
        aggs += [F.sum(F.when((F.col(t) == l) & (F.col(p) == l), 1).otherwise(0)).alias(f"tp_{l}"),
                 F.sum(F.when(F.col(p) == l, 1).otherwise(0)).alias(f"pp_{l}"),
                 F.sum(F.when(F.col(t) == l, 1).otherwise(0)).alias(f"sup_{l}")]
    aggs.append(F.count(F.lit(1)).alias("n"))
    # all rows come from the one row of counts, so the predictions are made once
    d = pred.agg(*aggs)
    d = d.withColumns({f"p_{l}": F.when(F.col(f"pp_{l}") > 0, F.col(f"tp_{l}") / F.col(f"pp_{l}")).otherwise(0.0) for l in labels}
                      | {f"r_{l}": F.when(F.col(f"sup_{l}") > 0, F.col(f"tp_{l}") / F.col(f"sup_{l}")).otherwise(0.0) for l in labels})
    p_r = {l: (F.col(f"p_{l}"), F.col(f"r_{l}")) for l in labels}
    d = d.withColumns({f"f_{l}": F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0) for l, (a, b) in p_r.items()})
    total = lambda cols: reduce(add, cols)
    n_rows = total(F.col(f"sup_{l}") for l in labels)
    accuracy = total(F.col(f"tp_{l}") for l in labels) / F.col("n")

    def row(name, precision, recall, f1, support):
        return F.struct(F.lit(name).alias("class"), *[F.round(c, 4).alias(k) for k, c in (("precision", precision), ("recall", recall), ("f1", f1))],
                        support.cast("long").alias("support"))
    rows = [row(l, *[F.col(f"{m}_{l}") for m in ("p", "r", "f", "sup")]) for l in labels]
    rows.append(row("accuracy", accuracy, accuracy, accuracy, F.col("n")))
    rows.append(row("macro avg", *[total(F.col(f"{m}_{l}") for l in labels) / len(labels) for m in "prf"], n_rows))
    rows.append(row("weighted avg", *[total(F.col(f"{m}_{l}") * F.col(f"sup_{l}") for l in labels) / n_rows for m in "prf"], n_rows))
    return d.select(F.inline(F.array(*rows)))


def kpi_gate(report: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME, min_f1: float = 0.70,
             min_critical_precision: float = 0.75) -> DataFrame:
    """H4: weighted F1 >= .70 and critical-class precision >= .75."""
    g = report.agg(F.max(F.when(F.col("class") == "weighted avg", F.col("f1"))).alias("weighted_f1"),
                   F.max(F.when(F.col("class") == scheme.critical, F.col("precision"))).alias("critical_precision"))
    return (g.withColumn("f1_pass", F.col("weighted_f1") >= min_f1)
            .withColumn("precision_pass", F.col("critical_precision") >= min_critical_precision)
            .withColumn("kpi_pass", F.col("f1_pass") & F.col("precision_pass")))


def error_patterns(pred: DataFrame, t: str = "true_label", p: str = "pred_label") -> DataFrame:
    """wrong (true, pred) pairs, most frequent first, with the overall error rate. The rate is a
    window over the aggregated pairs (a row per pair of labels)."""
    every = Window.partitionBy()
    wrong = ~F.col(t).eqNullSafe(F.col(p))
    g = pred.groupBy(t, p).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("error_rate", F.round(F.sum(F.when(wrong, F.col("n")).otherwise(0)).over(every) / F.sum("n").over(every), 4))
    return g.filter(wrong).orderBy(F.desc("n"), t, p)


def error_examples(pred: DataFrame, key: str, k: int = 5, t: str = "true_label", p: str = "pred_label") -> DataFrame:
    """the first ``k`` wrong rows by ``key``."""
    return pred.filter(~F.col(t).eqNullSafe(F.col(p))).orderBy(key).limit(k)


def calibration(pred: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """mean entropy when correct / wrong, accuracy, share per
    confidence band (from max_prob)."""
    band = F.when(F.col("max_prob") >= 0.75, "HIGH").when(F.col("max_prob") >= 0.5, "MEDIUM").otherwise("LOW")
    return pred.agg(
        F.round(F.avg(F.when(F.col("correct"), F.col("entropy"))), 4).alias("entropy_correct"),
        F.round(F.avg(F.when(~F.col("correct"), F.col("entropy"))), 4).alias("entropy_wrong"),
        F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"),
        *[F.round(F.avg((band == b).cast("double")), 4).alias(f"share_{b.lower()}") for b in ("HIGH", "MEDIUM", "LOW")])


def histogram(pred: DataFrame, value: str, by: str | None = None, bins: int = 20) -> DataFrame:
    """equal-width bins over [min, max] of ``value``; the maximum goes
    in the last bin (NumPy's convention). min and max are scalar subqueries, so
    nothing runs while the plan is built."""
    lo, hi = pred.agg(F.min(value).cast("double")).scalar(), pred.agg(F.max(value).cast("double")).scalar()
    d = pred.select(*([by] if by else []), F.col(value).alias("__v"), lo.alias("__lo"), hi.alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(
        F.least(F.floor((F.col("__v") - F.col("__lo")) / width), F.lit(bins - 1))).cast("int")
    return d.withColumn("bin", b).groupBy(*([by] if by else []), "bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(pred: DataFrame, value: str, by: str) -> DataFrame:
    """F15 box-plot data: exact quartiles per group. ``value`` is rounded to 4 digits first, so that a group holds a
    bounded number of distinct values (for an entropy some 16,000), which is what the exact percentile keeps."""
    q = F.percentile(F.round(value, 4), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = pred.groupBy(by).agg(q.alias("q"))
    return d.select(by, *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])
