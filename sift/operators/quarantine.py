"""Records split into valid rows and a quarantine, with counts.

One job writes both sides (``status=valid`` and ``status=bad`` folders) and
counts them on the way with ``observe``; there is no second pass for the counts. Each bad row
keeps its input and all of its reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.functions import text as X
from sift.operators import fusion as FU
from sift.schemas import DEFAULT_SCHEME, LabelScheme

# Reasons of a bad reply: it does not parse, or rules that the brief breaks.
REPLY_REASONS = ("parse", "label", "probability_sum", "confidence", "recommendation", "risk_score", "ambiguity_notes", "signals")


def check_replies(df: DataFrame, reply_col: str = "reply", signals: str | None = None, out: str = "reasons",
                  scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """B24 a, B25: the parsed struct ``expert``, ``parse_ok`` and the list of ``reasons``
    against a reply (empty: valid). The confidence is the band of the reply's own probabilities."""
    d = FU.parse_reply(df, reply_col).withColumn("__probs", S.map_to_probs(F.col("expert.probabilities"), scheme))
    d = d.withColumn("__confidence", S.confidence_band(F.col("__probs"), scheme))
    broken = FU.violations(F.col("expert.label"), "__probs", "__confidence", F.col("expert.recommendation"), F.col("expert.risk_score"),
                           F.col("expert.ambiguity_notes"), signals, scheme)
    return d.withColumn(out, F.when(F.col("parse_ok"), broken).otherwise(F.array(F.lit("parse")))).drop("__probs", "__confidence")


def string_array(c) -> Column:
    """B24 b: an optional fence (with or without ``json``) is taken off, then only a JSON
    array of strings is accepted; anything else is null."""
    raw = X.strip_u(F.col(c) if isinstance(c, str) else c)
    bare = X.strip_u(F.regexp_replace(F.regexp_replace(raw, r"\A```(json)?", ""), r"```\z", ""))
    value = F.try_parse_json(bare)
    kind = F.schema_of_variant(value)
    return F.when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_holds_null(bare, value), F.try_variant_get(value, "$", "array<string>"))


def _holds_null(bare: Column, value: Column) -> Column:
    """A JSON null among the strings (its type is hidden by that of the strings)."""
    return F.coalesce(F.exists(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isNull()), F.lit(False))


def split_write(df: DataFrame, path: str, reasons: str = "reasons", known: tuple[str, ...] = REPLY_REASONS
                ) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write ``df`` to ``path``, valid rows (no reasons) and bad ones apart, in one job.
    Returns both sides as read back and the counts: ``rows``, ``valid``, ``bad`` and one per
    ``known`` reason (a row counts once for each of its reasons)."""
    spark, seen = df.sparkSession, Observation()
    good = F.size(reasons) == 0
    marked = df.withColumn("status", F.when(good, "valid").otherwise("bad"))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), one(F.col("status") == "valid").alias("valid"),
                             one(F.col("status") == "bad").alias("bad"), *[one(F.array_contains(reasons, r)).alias(r) for r in known])
    counted.write.mode("overwrite").partitionBy("status").parquet(path)
    back = spark.read.schema(marked.schema).parquet(path)
    return (back.filter("status = 'valid'").drop("status", reasons), back.filter("status = 'bad'").drop("status"),
            {k: int(v) for k, v in seen.get.items()})


def observed_filter(df: DataFrame, drops: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """Drop the rows for which a condition holds, counting them by the first that
    does: the observation has ``rows``, ``kept`` and a count per name once the result was computed
    (a null condition drops nothing)."""
    seen, first = Observation(), F.lit(None).cast("string")
    for name, condition in reversed(list(drops.items())):
        first = F.when(condition, F.lit(name)).otherwise(first)
    marked = df.withColumn("__drop", first)
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__drop").isNull()).alias("kept"),
                             *[F.count_if(F.col("__drop") == n).alias(n) for n in drops])
    return counted.filter("__drop IS NULL").drop("__drop"), seen
