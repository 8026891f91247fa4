"""Schemas and the label scheme shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class LabelScheme:
    """Ordered risk labels. Order matters: probabilities are arrays in this
    order, arg-max ties go to the earlier label, encoding is the index."""

    labels: tuple[str, ...] = ("AMAN", "WASPADA", "TINGGI")
    safe: str = "AMAN"
    fallback: str = "WASPADA"
    critical: str = "TINGGI"
    # Probabilities used when no score exists (fixed values).
    fallback_probs: tuple[float, ...] = (0.33, 0.34, 0.33)
    confidence_bands: tuple[tuple[float, str], ...] = field(
        default=((0.75, "HIGH"), (0.50, "MEDIUM")))
    low_confidence: str = "LOW"

    def index(self, label: str) -> int:
        return self.labels.index(label)


DEFAULT_SCHEME = LabelScheme()

SIGNAL = T.StructType([
    T.StructField("signal_type", T.StringType()),
    T.StructField("extracted_text", T.StringType()),
    T.StructField("significance", T.StringType()),
    T.StructField("context_explanation", T.StringType()),
])

SIGNAL_TYPES = ("ENTITY", "EUPHEMISM", "TEMPORAL", "CALL_TO_ACTION", "OTHER")
SIGNIFICANCE = ("HIGH", "MEDIUM", "LOW")
RECOMMENDATIONS = ("ARCHIVE", "MONITOR", "ESCALATE")

ANNOTATION_COLUMNS = (
    "toxicity", "identity_attack", "insults", "threat_incitement_to_violence",
    "profanity_obscenity", "polarized", "sexually_explicit", "is_noise_or_spam_text",
)
SUBLABEL_COLUMNS = ANNOTATION_COLUMNS[:7]

ANNOTATED = T.StructType(
    [T.StructField("text_id", T.StringType()), T.StructField("text", T.StringType()),
     T.StructField("topic", T.StringType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ANNOTATION_COLUMNS])

CURATED_COLUMNS = ["text_id", "text", "label", "text_hash", "topic"] + [
    f"{c}_agg" for c in SUBLABEL_COLUMNS]

CURATED = T.StructType(
    [T.StructField(c, T.StringType()) for c in CURATED_COLUMNS[:5]]
    + [T.StructField(c, T.IntegerType()) for c in CURATED_COLUMNS[5:]])

BALANCED = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "label", "source")])

POST = T.StructType([T.StructField(c, T.StringType()) for c in ("post_id", "text", "source", "url")])

ANALYSIS_LOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("true_label", T.StringType()),
    T.StructField("predicted_label", T.StringType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("is_ambiguous", T.BooleanType()),
    T.StructField("pipeline_mode", T.StringType()),
])

FEEDBACK_EVENT = T.StructType([
    T.StructField("text_hash", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("original_label", T.StringType()),
    T.StructField("corrected_label", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("seq", T.LongType()),
])

KEY_PHRASE = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "label", "reason")])

EXPERT_REPLY = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("probabilities", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("reasoning", T.StringType()),
    T.StructField("summary_narrative", T.StringType()),
    T.StructField("risk_score", T.LongType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("ambiguity_notes", T.StringType()),
    T.StructField("key_phrases", T.ArrayType(KEY_PHRASE)),
])

PREDICTIONS = T.StructType([
    T.StructField("true_label", T.StringType()),
    T.StructField("pred_label", T.StringType()),
    T.StructField("max_prob", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("correct", T.BooleanType()),
])

TRANSCRIPT_PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "reference", "hypothesis")])
