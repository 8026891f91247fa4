"""Uncertainty and fusion (D2-D9, FIXTURES.md 9)."""

import math

from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.operators.fusion import fuse_frame, parse_reply


def _u(spark, probs):
    df = spark.createDataFrame([(probs,)], "p array<double>")
    return df.select(S.uncertainty(F.col("p")).alias("u")).collect()[0]["u"]


def test_float_edge_prediction_set(spark):
    u = _u(spark, [0.7, 0.2, 0.1])
    assert list(u["prediction_set"]) == ["AMAN", "WASPADA", "TINGGI"]  # 0.7+0.2 < 0.9


def test_ties_and_bands(spark):
    u = _u(spark, [0.4, 0.4, 0.2])
    assert u["label"] == "AMAN" and u["confidence"] == "LOW"
    u = _u(spark, [0.05, 0.9, 0.05])
    assert u["label"] == "WASPADA" and list(u["prediction_set"]) == ["WASPADA"]
    assert u["confidence"] == "HIGH" and not u["is_ambiguous"]


def test_entropy_bounds(spark):
    u = _u(spark, [1.0, 0.0, 0.0])
    assert u["entropy"] == 0.0
    u = _u(spark, [1 / 3, 1 / 3, 1 / 3])
    assert abs(u["entropy"] - math.log2(3)) < 1e-9


def test_fallback(spark):
    df = spark.createDataFrame([(None,)], "p array<double>")
    u = df.select(S.uncertainty(F.col("p")).alias("u")).collect()[0]["u"]
    assert u["label"] == "WASPADA" and list(u["probabilities"]) == [0.33, 0.34, 0.33]
    assert u["entropy"] == math.log2(3) and u["confidence"] == "LOW"
    assert list(u["prediction_set"]) == ["AMAN", "WASPADA", "TINGGI"]


def test_fusion_override(spark):
    df = spark.createDataFrame([([0.95, 0.03, 0.02], [0.3, 0.3, 0.4], "TINGGI"),
                                (None, [0.2, 0.3, 0.5], "TINGGI")],
                               "loc array<double>, ex array<double>, el string")
    rows = fuse_frame(df, "loc", "ex", "el", "f").collect()
    a, b = rows[0]["f"], rows[1]["f"]
    assert a["label"] == "TINGGI" and a["overridden"]
    assert list(a["probabilities"]) == [0.4473, 0.1534, 0.3994]  # bump to .5, renormalise
    assert b["label"] == "TINGGI" and list(b["probabilities"]) == [0.2, 0.3, 0.5] and not b["overridden"]


def test_parse_fenced_plain_broken(spark):
    body = '{"label": "AMAN", "probabilities": {"AMAN": 0.9, "WASPADA": 0.1}, "risk_score": 5}'
    df = spark.createDataFrame([(1, "```json\n" + body + "\n```"), (2, body), (3, "{broken")],
                               "id int, reply string")
    out = {r["id"]: r for r in parse_reply(df, "reply").collect()}
    assert out[1]["parse_ok"] and out[2]["parse_ok"] and not out[3]["parse_ok"]
    assert out[1]["expert"]["probabilities"]["AMAN"] == 0.9
