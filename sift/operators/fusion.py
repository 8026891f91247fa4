"""Expert replies and score fusion: B24, B25, B30, B32, D7, D8.

Replies arrive as a table of JSON text (one per document); parsing is
``from_json`` with a fixed schema, so malformed replies become null fields
and are routed to quarantine rather than failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.functions import text as X
from sift.schemas import DEFAULT_SCHEME, EXPERT_REPLY, RECOMMENDATIONS, SIGNAL_TYPES, SIGNIFICANCE, LabelScheme


def strip_fence(c) -> Column:
    """A reply starting with a code fence loses its first and last line."""
    raw = X.strip_u(F.col(c) if isinstance(c, str) else c)
    lines = F.split(raw, "\n")
    inner = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    return F.when(raw.startswith("```"), inner).otherwise(raw)


def parse_reply(df: DataFrame, reply_col: str = "reply", out: str = "expert") -> DataFrame:
    """Adds the parsed struct and ``parse_ok`` (label and probabilities present)."""
    parsed = F.from_json(strip_fence(reply_col), EXPERT_REPLY, {"mode": "PERMISSIVE"})
    return (df.withColumn(out, parsed)
            .withColumn("parse_ok", F.col(f"{out}.label").isNotNull() & F.col(f"{out}.probabilities").isNotNull()))


def key_phrase_digest(phrases, k: int = 5) -> Column:
    """First ``k`` phrases as ``'text' (label)`` joined by "; "."""
    p = F.col(phrases) if isinstance(phrases, str) else phrases
    parts = F.transform(F.slice(p, 1, k), lambda e: F.concat(F.lit("'"), e["text"], F.lit("' ("), e["label"], F.lit(")")))
    return F.array_join(parts, "; ")


def note_with_phrases(note, phrases, k: int = 5) -> Column:
    n = F.col(note) if isinstance(note, str) else note
    p = F.col(phrases) if isinstance(phrases, str) else phrases
    return F.when(F.coalesce(F.size(p), F.lit(0)) > 0,
                  F.concat(n, F.lit("\n\n[Key phrases: "), key_phrase_digest(p, k), F.lit("]"))).otherwise(n)


def fuse_frame(df: DataFrame, local: str, expert_probs: str, expert_label: str, out: str = "fused",
               scheme: LabelScheme = DEFAULT_SCHEME, w_local: float = 0.4, w_expert: float = 0.6) -> DataFrame:
    """D7 + D8 -> struct(label, probabilities, entropy, prediction_set, confidence, overridden).

    With a local score: per-label weighted mix rounded to 4, renormalised;
    label = arg-max; if the expert says the critical label and the fused label
    differs, the critical label wins with probability max(p, .5), renormalised.
    Without a local score the expert's label and probabilities stand. Every
    intermediate array is its own column, so each is computed once per row."""
    loc, ex, el = F.col(local), F.col(expert_probs), F.col(expert_label)
    ci = scheme.index(scheme.critical)
    d = df.withColumn("__fz", S.fuse(loc, ex, w_local, w_expert))
    d = d.withColumn("__lab", S.argmax_label(F.col("__fz"), scheme))
    d = d.withColumn("__ov", F.coalesce((el == scheme.critical) & (F.col("__lab") != scheme.critical)
                                        & loc.isNotNull() & ex.isNotNull(), F.lit(False)))
    bumped = F.transform(F.col("__fz"), lambda x, i: F.when(i == ci, F.greatest(x, F.lit(0.5))).otherwise(x))
    d = d.withColumn("__pr", F.when(loc.isNull(), ex).when(ex.isNull(), loc)
                     .when(F.col("__ov"), S.renormalize(bumped, guard_zero=False)).otherwise(F.col("__fz")))
    d = d.withColumn("__label", F.when(loc.isNull(), el).when(ex.isNull(), S.argmax_label(loc, scheme))
                     .when(F.col("__ov"), F.lit(scheme.critical)).otherwise(F.col("__lab")))
    pr = F.col("__pr")
    return (d.withColumn(out, F.struct(F.col("__label").alias("label"), pr.alias("probabilities"),
                                       S.entropy(pr).alias("entropy"),
                                       S.prediction_set(pr, 0.1, scheme).alias("prediction_set"),
                                       S.confidence_band(pr, scheme).alias("confidence"),
                                       F.col("__ov").alias("overridden")))
            .drop("__fz", "__lab", "__ov", "__pr", "__label"))


def violations(label, probs, confidence, recommendation, risk, note, signals=None,
               scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """List of rule names a brief breaks (empty = valid)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    lab, pr = c(label), c(probs)
    confidence, recommendation, risk = c(confidence), c(recommendation), c(risk)
    total = F.aggregate(pr, F.lit(0.0), lambda a, x: a + x)
    checks = [
        F.when(~F.coalesce(lab.isin(*scheme.labels), F.lit(False)), F.lit("label")),
        F.when(~F.coalesce((total >= 0.99) & (total <= 1.01), F.lit(False)), F.lit("probability_sum")),
        F.when(~F.coalesce(confidence.isin("HIGH", "MEDIUM", "LOW"), F.lit(False)), F.lit("confidence")),
        F.when(~F.coalesce(recommendation.isin(*RECOMMENDATIONS), F.lit(False)), F.lit("recommendation")),
        F.when(~F.coalesce((risk >= 0) & (risk <= 100), F.lit(False)), F.lit("risk_score")),
        F.when(~F.coalesce(F.length(X.strip_u(note)) >= 10, F.lit(False)), F.lit("ambiguity_notes")),
    ]
    if signals is not None:
        sg = F.col(signals) if isinstance(signals, str) else signals
        bad = F.exists(sg, lambda s: ~s["signal_type"].isin(*SIGNAL_TYPES) | ~s["significance"].isin(*SIGNIFICANCE))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit("signals")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def flatten_brief(df: DataFrame, brief: str = "brief") -> DataFrame:
    """Nested brief -> flat row."""
    b = F.col(brief)
    return df.select(
        *[c for c in df.columns if c != brief],
        b["classification"]["label"].alias("label"),
        b["classification"]["confidence"].alias("confidence"),
        F.round(b["classification"]["entropy"], 4).alias("entropy"),
        b["risk_score"].alias("risk_score"),
        b["recommendation"].alias("recommendation"),
        b["summary_narrative"].alias("summary"),
        b["ambiguity_notes"].alias("ambiguity"),
        F.transform(b["signals_detected"], lambda s: F.struct(s["signal_type"].alias("type"),
                                                            s["extracted_text"].alias("text"))).alias("signals"),
    )
