"""Corpus curation: B1-B7, G1, F1-F3, F16, F17.

All per-row steps are narrow projections. The only exchanges are those of the exact
de-duplication: a hash aggregate of (hash, order), so that partial aggregation collapses a
hot duplicate group map-side, and the join that picks the winners' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sift.functions import text as X
from sift.operators.quarantine import observed_filter
from sift.operators.winners import one_per_key
from sift.schemas import CURATED_COLUMNS, SUBLABEL_COLUMNS


def majority_vote(c) -> Column:
    """B1: 1 iff the '1' votes are more than half; ties and empty -> 0."""
    arr = F.col(c) if isinstance(c, str) else c
    ones = F.aggregate(F.transform(arr, lambda v: v.try_cast("int")), F.lit(0),
                       lambda a, b: a + F.coalesce(b, F.lit(0)))
    return F.when(ones * 2 > F.size(arr), 1).otherwise(0).cast("int")


def threat_label(spam="is_noise_or_spam_text", violence="threat_incitement_to_violence",
                 toxic="toxicity", identity="identity_attack", insults="insults") -> Column:
    """B2: first match wins: spam SKIP, violence TINGGI, any of
    toxic/identity/insults WASPADA, else AMAN."""
    return (F.when(majority_vote(spam) == 1, "SKIP")
            .when(majority_vote(violence) == 1, "TINGGI")
            .when((majority_vote(toxic) == 1) | (majority_vote(identity) == 1)
                  | (majority_vote(insults) == 1), "WASPADA")
            .otherwise("AMAN"))


def label_corpus(df: DataFrame) -> DataFrame:
    return df.withColumn("label", threat_label())


def drop_skipped(df: DataFrame, label_col: str = "label") -> DataFrame:
    """B3; ``usable`` also counts what goes."""
    return df.filter(F.col(label_col) != "SKIP")


def usable(df: DataFrame, min_chars: int = 10, label_col: str = "label", text_col: str = "text") -> tuple[DataFrame, Observation]:
    """B3 and B4 with their report: the rows kept, and an observation of ``rows``, ``kept``,
    ``skipped`` and ``too_short`` (filled once the result was computed)."""
    return observed_filter(df, {"skipped": F.coalesce(F.col(label_col) == "SKIP", F.lit(True)),
                                "too_short": F.coalesce(F.length(text_col) < min_chars, F.lit(True))})


def min_length(df: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """At least ``n`` code points of the raw text."""
    return df.filter(F.length(text_col) >= n)


def with_text_hash(df: DataFrame, text_col: str = "text", out: str = "text_hash") -> DataFrame:
    return df.withColumn(out, X.text_hash(text_col))


def dedup_first(df: DataFrame, key: str, order_col: str, unique_order: bool = False) -> DataFrame:
    """G1: one row per ``key``, the one with the smallest ``order_col``
    (``operators.winners``: a hash aggregate of narrow columns, then an equi-join).
    ``unique_order``: the order is an id of the rows."""
    return one_per_key(df, key, order_col, unique_order=unique_order)


def sublabel_flags(df: DataFrame, cols=SUBLABEL_COLUMNS) -> DataFrame:
    """``{c}_agg`` majority flags."""
    return df.withColumns({f"{c}_agg": majority_vote(c) for c in cols})


def curate(df: DataFrame, order_col: str = "text_id", min_chars: int = 10) -> tuple[DataFrame, Observation]:
    """B2 -> B3 -> B4 -> B5/G1 -> B6 -> B7 on an annotated corpus, with the counts of the rows dropped (see ``usable``)."""
    kept, seen = usable(label_corpus(df), min_chars)
    out = sublabel_flags(dedup_first(with_text_hash(kept), "text_hash", order_col))
    return out.select(*CURATED_COLUMNS), seen


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Count per label and percent of all rows (1 decimal). The share
    is a window over the aggregated (one row per label) frame."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(label_col, "n", F.round(F.col("n") * 100.0 / total, 1).alias("pct"),
                         total.alias("total"))


def class_counts(df: DataFrame, *keys: str) -> DataFrame:
    """counts per key combination."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """F16: balanced weights n / (k * n_c)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return counts.select(label_col, "n_c",
                         (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))


def min_class_count(df: DataFrame, label_col: str = "label", warn_below: int = 2) -> DataFrame:
    """smallest class size and the warning flag."""
    return (df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.min("n").alias("min_class_count"))
            .withColumn("warn", F.col("min_class_count") < warn_below))
