"""Probability-array expressions.

Probabilities are ``array<double>`` in the label scheme's order. Every
function is a JVM higher-order expression, so scoring stays in codegen.
Sums are taken in the reference's order (sorted order for the prediction
set, label order elsewhere), never through a reordered aggregate, because
float addition is not associative (0.7 + 0.2 < 0.9).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.schemas import DEFAULT_SCHEME, LabelScheme


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def labels_array(scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    return F.array(*[F.lit(l) for l in scheme.labels])


def argmax_label(probs, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """D3: label of the largest probability; ties go to the earlier label."""
    p = _c(probs)
    return F.element_at(labels_array(scheme), F.array_position(p, F.array_max(p)).cast("int"))


def entropy(probs) -> Column:
    """Shannon entropy in bits over p > 0 (unrounded)."""
    p = _c(probs)
    s = F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda acc, x: acc + x * F.log2(x))
    return F.lit(0.0) - s


def prediction_set(probs, alpha: float = 0.1, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """Labels by probability descending (ties in label order), added
    until the running sum reaches 1 - alpha."""
    threshold = 1.0 - alpha
    p = _c(probs)
    items = F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i")))
    ordered = F.array_sort(items, lambda a, b: F.when(a["p"] > b["p"], -1)
                           .when(a["p"] < b["p"], 1)
                           .otherwise(a["i"] - b["i"]))
    labs = labels_array(scheme)
    # One left fold in sorted order: a label joins while the running sum
    # before it is below the threshold (same float order as the reference).
    init = F.struct(F.lit(0.0).alias("acc"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(
        ordered, init,
        lambda st, s: F.struct((st["acc"] + s["p"]).alias("acc"),
                               F.when(st["acc"] < F.lit(threshold),
                                      F.array_append(st["out"], F.element_at(labs, s["i"] + 1)))
                               .otherwise(st["out"]).alias("out")),
        lambda st: st["out"])


def confidence_band(probs, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """Max >= .75 HIGH, >= .50 MEDIUM, else LOW."""
    m = F.array_max(_c(probs))
    out = None
    for bound, name in scheme.confidence_bands:
        out = F.when(m >= bound, name) if out is None else out.when(m >= bound, name)
    return out.otherwise(scheme.low_confidence)


def uncertainty(probs, alpha: float = 0.1, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """D2-D6, D9 as one struct. A null ``probs`` takes the fallback: label
    ``scheme.fallback``, fixed probabilities, entropy log2(k) (constant),
    all labels in order, LOW."""
    p = _c(probs)
    fb_probs = F.array(*[F.lit(float(x)) for x in scheme.fallback_probs])
    has = p.isNotNull()
    pset = F.when(has, prediction_set(p, alpha, scheme)).otherwise(labels_array(scheme))
    return F.struct(
        F.when(has, argmax_label(p, scheme)).otherwise(F.lit(scheme.fallback)).alias("label"),
        F.coalesce(p, fb_probs).alias("probabilities"),
        F.when(has, confidence_band(p, scheme)).otherwise(F.lit(scheme.low_confidence)).alias("confidence"),
        F.when(has, entropy(p)).otherwise(F.lit(math.log2(len(scheme.labels)))).alias("entropy"),
        pset.alias("prediction_set"),
        F.size(pset).alias("set_size"),
        (F.size(pset) > 1).alias("is_ambiguous"),
    )


def renormalize(probs, digits: int = 4, guard_zero: bool = True) -> Column:
    """Divide by the sum (label order) and round; unchanged when the sum is 0
    and ``guard_zero``."""
    p = _c(probs)
    total = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)
    scaled = F.transform(p, lambda x: F.round(x / total, digits))
    return F.when(total > 0, scaled).otherwise(p) if guard_zero else scaled


def fuse(local, expert, w_local: float = 0.4, w_expert: float = 0.6) -> Column:
    """D7 first step: per label round(w_l*local + w_e*expert, 4), then
    renormalise when the total is positive."""
    mixed = F.zip_with(_c(local), _c(expert),
                       lambda a, b: F.round(F.lit(w_local) * F.coalesce(a, F.lit(0.0))
                                            + F.lit(w_expert) * F.coalesce(b, F.lit(0.0)), 4))
    return renormalize(mixed)


def map_to_probs(m, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """``map<label, p>`` -> array in label order, missing labels -> 0."""
    mm = _c(m)
    arr = F.array(*[F.coalesce(F.try_element_at(mm, F.lit(l)), F.lit(0.0)) for l in scheme.labels])
    return F.when(mm.isNotNull(), arr)


def probs_to_map(probs, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    return F.map_from_arrays(labels_array(scheme), _c(probs))


def risk_band(score) -> Column:
    """<=30 low, <=60 medium, else high."""
    s = _c(score)
    return F.when(s <= 30, "low").when(s <= 60, "medium").otherwise("high")


# Recommendation -> shown text.
SHOWN_RECOMMENDATIONS = {"ARCHIVE": "ARSIP", "MONITOR": "PANTAU", "ESCALATE": "ESKALASI"}


def shown_recommendation(rec, shown: dict[str, str] | None = None) -> Column:
    """The text shown for a recommendation (unknown ones as they are)."""
    table = F.create_map(*[F.lit(x) for kv in (shown or SHOWN_RECOMMENDATIONS).items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(rec)), _c(rec))


def encode_label(label, scheme: LabelScheme = DEFAULT_SCHEME) -> Column:
    """Fixed index in the label order (not frequency order)."""
    return (F.array_position(labels_array(scheme), _c(label)) - 1).cast("int")
