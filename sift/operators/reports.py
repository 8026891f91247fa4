"""Analyst queries over ``analysis_logs``: G3-G6, B21-B23, B29, F4-F9.

``as_of`` (a date string) replaces the wall clock so results are
reproducible. Look-back bounds are midnight of ``as_of - days`` inclusive,
which also prunes a ``log_date``-partitioned table when one is used.
Top-N queries order by (timestamp desc, id) so ties are deterministic;
Spark plans ``orderBy().limit()`` as TakeOrderedAndProject (per-task top-N,
no full sort).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sift.schemas import DEFAULT_SCHEME, LabelScheme


def since(days: int, as_of: str):
    return F.date_sub(F.to_date(F.lit(as_of)), days).cast("timestamp_ntz")


def search_threats(logs: DataFrame, as_of: str, label: str = "", days_back: int = 7, limit: int = 20,
                   keyword: str = "", scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Label filter (ignored when unknown/empty), look-back (disabled
    when days_back <= 0), ILIKE keyword (% and _ stay wildcards), newest
    first, projected preview rows."""
    q = logs
    if label and label.upper() in scheme.labels:
        q = q.filter(F.col("predicted_label") == label.upper())
    if days_back > 0:
        q = q.filter(F.col("timestamp") >= since(days_back, as_of))
    if keyword:
        q = q.filter(F.col("input_text").ilike(f"%{keyword}%"))
    return (q.orderBy(F.col("timestamp").desc(), F.col("id"))
            .limit(limit)
            .select("id", "timestamp", F.substring("input_text", 1, 150).alias("text"),
                    F.col("predicted_label").alias("label"),
                    F.coalesce(F.col("risk_score"), F.lit(0)).alias("risk_score"), "confidence",
                    F.coalesce(F.round("entropy", 4), F.lit(0.0)).alias("entropy"),
                    F.col("pipeline_mode").alias("mode")))


def latest_triage(logs: DataFrame, limit: int = 20, mode: str = "SWEEP") -> DataFrame:
    """Newest ``limit`` sweep rows, 200-character preview."""
    return (logs.filter(F.col("pipeline_mode") == mode)
            .orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)
            .select("id", "timestamp", F.substring("input_text", 1, 200).alias("text"),
                    F.col("predicted_label").alias("label"), "confidence",
                    F.coalesce(F.round("entropy", 4), F.lit(0.0)).alias("entropy")))


def history(logs: DataFrame, limit: int = 25) -> DataFrame:
    """Newest ``limit`` rows with a 120-character preview plus '...'."""
    return (logs.orderBy(F.col("timestamp").desc(), F.col("id")).limit(limit)
            .select("id", "timestamp", F.concat(F.substring("input_text", 1, 120), F.lit("...")).alias("preview"),
                    F.col("predicted_label").alias("label"), "pipeline_mode"))


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Count per label."""
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def daily_stats(logs: DataFrame, feedback: DataFrame | None, as_of: str) -> DataFrame:
    """rows dated ``as_of``: per label count, mean entropy (4 dp), mean
    risk (1 dp), with the day's total and the feedback count on every row."""
    day = logs.filter(F.to_date("timestamp") == F.to_date(F.lit(as_of)))
    per = day.groupBy("predicted_label").agg(F.count(F.lit(1)).alias("n"),
                                             F.round(F.avg("entropy"), 4).alias("avg_entropy"),
                                             F.round(F.avg("risk_score"), 1).alias("avg_risk"))
    # The day's total is the sum over the (one row per label) aggregate.
    collected = F.lit(0).cast("long") if feedback is None else feedback.agg(F.count(F.lit(1))).scalar()  # a scalar subquery
    return per.select("*", F.sum("n").over(Window.partitionBy()).alias("total_today"), collected.alias("feedback_collected"))


def trend(logs: DataFrame, as_of: str, days: int = 7, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """one row per observed day since the bound, a count column per
    label (0 when absent). Pivot values are given, so no extra pass."""
    q = logs.filter(F.col("timestamp") >= since(days, as_of)).withColumn("dt", F.to_date("timestamp"))
    return (q.groupBy("dt").pivot("predicted_label", list(scheme.labels))
            .agg(F.count(F.lit(1))).na.fill(0, list(scheme.labels)))


def dashboard_counts(logs: DataFrame, as_of: str, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """today's and all-time counts per label and totals, one pass."""
    today = F.to_date("timestamp") == F.to_date(F.lit(as_of))
    aggs = []
    for l in scheme.labels:
        is_l = F.col("predicted_label") == l
        aggs.append(F.sum(F.when(is_l & today, 1).otherwise(0)).cast("long").alias(f"today_{l.lower()}"))
        aggs.append(F.sum(F.when(is_l, 1).otherwise(0)).cast("long").alias(f"all_{l.lower()}"))
    aggs.append(F.sum(F.when(today, 1).otherwise(0)).cast("long").alias("today_total"))
    aggs.append(F.count(F.lit(1)).alias("all_total"))
    return logs.agg(*aggs)


def batch_summary(results: DataFrame, label_col: str = "label", source_col: str = "source",
                  order_col: str = "ord", scheme: LabelScheme = DEFAULT_SCHEME):
    """counts per label, mean entropy (sum / max(n, 1)), percent of the
    critical label; and the top-3 sources by count (ties: first seen)."""
    aggs = [F.sum(F.when(F.col(label_col) == l, 1).otherwise(0)).cast("long").alias(f"n_{l.lower()}")
            for l in scheme.labels]
    n = F.count(F.lit(1))
    summary = results.agg(*aggs, n.alias("n"),
                          F.round(F.coalesce(F.sum("entropy"), F.lit(0.0)) / F.greatest(n, F.lit(1)), 4).alias("mean_entropy"),
                          F.round(F.sum(F.when(F.col(label_col) == scheme.critical, 1).otherwise(0)) * 100.0
                                  / F.greatest(n, F.lit(1)), 1).alias("pct_critical"))
    top = (results.groupBy(source_col).agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_seen"))
           .orderBy(F.col("n").desc(), F.col("first_seen")).limit(3))
    return summary, top
