"""Composite triage paths: D13 (batch sweep), D14 (deep analysis), I3.

One narrow DataFrame plan: normalise -> signals -> score -> uncertainty ->
log rows / result rows. Scorers read the normalised text
(``operators.scoring``: a linear model as columns, a weight table, a Spark ML
pipeline, or an external model through ``predict_batch_udf``). When the scorer
is a Python UDF, write or persist the result if it feeds both the log and
the returned rows, so the model runs once per row. Within one plan the score
is pinned: filters on the label read it instead of computing it again.

The cascade (B27): only rows that the sweep does not call safe go on to
``deep_triage``, and the filter stands before its join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.functions import text as X
from sift.operators import fusion as FU
from sift.operators.normalize import normalize
from sift.operators.partitioning import pinned
from sift.operators.scoring import PROBS, Scorer
from sift.operators.signals import extract_signals
from sift.schemas import DEFAULT_SCHEME, LabelScheme

def batch_triage(df: DataFrame, scorer: Scorer | None, text_col: str = "text",
                 slang=None, emoji=None, lexicon=None, action_patterns=None,
                 urgency_patterns=None, alpha: float = 0.1,
                 scheme: LabelScheme = DEFAULT_SCHEME, preview_chars: int = 200) -> DataFrame:
    """D13. ``scorer`` adds ``local_probs`` to the normalised frame (null ->
    fallback; no scorer: all null). Adds the triage columns next to those of
    ``normalize`` and ``extract_signals``."""
    n = normalize(df, text_col, slang=slang, emoji=emoji)
    # scored before the signals: a later filter on the label then stands below them in the plan
    s = pinned(scorer(n), PROBS) if scorer is not None else n.withColumn(PROBS, F.lit(None).cast("array<double>"))
    s = extract_signals(s, text_col, ar_col="lang_mix.ar", lexicon=lexicon,
                        action_patterns=action_patterns, urgency_patterns=urgency_patterns)
    u = S.uncertainty(F.col(PROBS), alpha, scheme)
    # One withColumns per stage: every withColumn re-analyses the whole plan.
    return (s.withColumn("u", u)
            .withColumns({
                "id": X.short_id(text_col),
                "text_preview": X.preview(text_col, preview_chars),
                "label": F.col("u.label"),
                "confidence": F.col("u.confidence"),
                "entropy": F.round("u.entropy", 4),
                "probabilities": F.col("u.probabilities"),
                "prediction_set": F.col("u.prediction_set"),
                "is_ambiguous": F.col("u.is_ambiguous"),
            })
            .drop("u"))


def sweep_log_rows(triaged: DataFrame, text_col: str = "text", ts=None, keep=()) -> DataFrame:
    """Log rows of a sweep (A14 input): risk 0, mode SWEEP; ``keep`` lists
    further columns to carry (an arrival order, say)."""
    return triaged.select(
        F.col("id"), (ts if ts is not None else F.localtimestamp()).cast("timestamp_ntz").alias("timestamp"),
        F.lit(0.0).alias("latency_ms"), F.col(text_col).alias("input_text"),
        F.lit(None).cast("string").alias("true_label"), F.col("label").alias("predicted_label"),
        F.lit(0).alias("risk_score"), "confidence", "entropy", "is_ambiguous",
        F.lit("SWEEP").alias("pipeline_mode"), *keep)


def radar_log_rows(deep: DataFrame, text_col: str = "text", ts=None, latency_ms=None, keep=()) -> DataFrame:
    """Log rows of a deep analysis (A14 input): the final label, the expert's
    risk score, mode RADAR. Rows without a parsed reply have no result and
    are not logged."""
    return deep.filter("parse_ok").select(
        F.col("id"), (ts if ts is not None else F.localtimestamp()).cast("timestamp_ntz").alias("timestamp"),
        (latency_ms if latency_ms is not None else F.lit(0.0)).alias("latency_ms"), F.col(text_col).alias("input_text"),
        F.lit(None).cast("string").alias("true_label"), F.col("final_label").alias("predicted_label"),
        F.col("risk_score").cast("int").alias("risk_score"), F.col("final_confidence").alias("confidence"),
        F.col("final_entropy").alias("entropy"), (F.size("final_set") > 1).alias("is_ambiguous"),
        F.lit("RADAR").alias("pipeline_mode"), *keep)


def escalate(triaged: DataFrame, scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """Only non-safe rows go on to the costly stage."""
    return triaged.filter(F.col("label") != scheme.safe)


def deep_triage(triaged: DataFrame, replies: DataFrame, key: str, reply_col: str = "reply",
                scheme: LabelScheme = DEFAULT_SCHEME, local_col: str = PROBS, cascade: bool = True) -> DataFrame:
    """With ``cascade`` drop the rows that the sweep calls safe (B27), then
    join expert replies (left, on ``key``), parse, fuse with the local
    score (``local_col``, may be null), validate and build brief columns.
    Rows whose reply is missing or malformed get ``parse_ok = false``."""
    triaged = escalate(triaged, scheme) if cascade else triaged
    r = FU.parse_reply(replies.select(key, reply_col), reply_col)
    j = triaged.join(r, key, "left").withColumn("parse_ok", F.coalesce("parse_ok", F.lit(False)))
    j = (j.withColumn("__ex_probs", S.map_to_probs(F.col("expert.probabilities"), scheme))
         .withColumn("__ex_label", F.col("expert.label")))
    out = (FU.fuse_frame(j, local_col, "__ex_probs", "__ex_label", "f", scheme)
           .drop("__ex_probs", "__ex_label")
           .withColumn("final_label", F.col("f.label"))
           .withColumn("final_probs", F.col("f.probabilities"))
           .withColumn("final_entropy", F.round("f.entropy", 4))
           .withColumn("final_set", F.col("f.prediction_set"))
           .withColumn("final_confidence", F.col("f.confidence"))
           .withColumn("risk_score", F.col("expert.risk_score"))
           .withColumn("recommendation", F.col("expert.recommendation"))
           .withColumn("ambiguity_notes", FU.note_with_phrases(F.col("expert.ambiguity_notes"),
                                                               F.col("expert.key_phrases")))
           .drop("f"))
    v = FU.violations("final_label", "final_probs", "final_confidence", "recommendation",
                      "risk_score", F.col("expert.ambiguity_notes"), "signals", scheme)
    return out.withColumn("violations", F.when(F.col("parse_ok"), v).otherwise(F.array(F.lit("parse"))))


def transcript_gate(df: DataFrame, text_col: str = "text", min_chars: int = 5) -> DataFrame:
    """Transcripts shorter than ``min_chars`` after stripping get a reject
    reason and are not analysed further."""
    short = F.length(X.strip_u(text_col)) < min_chars
    return df.withColumn("reject_reason", F.when(short, F.lit("transcript too short")))
