"""Scorers on normalised text and the cascade."""

import numpy as np

from sift.operators import scoring as SC
from sift.operators.normalize import normalize
from sift.operators.triage import batch_triage, deep_triage, radar_log_rows, sweep_log_rows
from sift.plans import derive as DV

MODEL = SC.LinearModel((300, 0, -200), {"bom": (-9000, 2000, 30000), "the": (4000, -100, -5000), "é": (1, 20000, 7)})
TEXTS = ["the the THE the", "bom", "a BOM in the é é", "", "   ", "theme bombs", "x " * 300 + "the", "é the"]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")


def test_scorers_agree(spark):
    n = normalize(frame(spark), "text")
    model = MODEL
    forms = [SC.linear_scorer(MODEL), SC.table_scorer(SC.weight_table(spark, MODEL), MODEL.bias, "doc_id"),
             SC.udf_scorer(lambda: model.probabilities)]
    got = [{r["doc_id"]: r["local_probs"] for r in f(n).select("doc_id", "local_probs").collect()} for f in forms]
    assert got[0] == got[1] == got[2]
    assert got[0][3] is None and got[0][4] is None
    e = np.exp([4.3, -0.1, -5.2])
    assert got[0][0] == [round(float(x), 4) for x in e / e.sum()]
    assert max(range(3), key=got[0][1].__getitem__) == 2


def test_table_scorer_makes_its_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    n = normalize(frame(spark), "text").select("doc_id", "normalized_text").mapInArrow(seen, "doc_id int, normalized_text string")
    out = SC.table_scorer(SC.weight_table(spark, MODEL), MODEL.bias, "doc_id")(n)
    assert len(out.collect()) == len(TEXTS) == calls.value
    vocabulary = n.repartition("doc_id")
    calls.value = 0
    assert len(SC.table_scorer(DV.vocabulary_weights(vocabulary), MODEL.bias, "doc_id")(vocabulary).collect()) == len(TEXTS) == calls.value


def test_external_model_that_fails_leaves_nulls(spark):
    def no_model():
        raise FileNotFoundError("model.bin")

    def breaks():
        def predict(texts):
            raise ValueError("bad batch")
        return predict
    for load, reason in ((no_model, "load: FileNotFoundError: model.bin"), (breaks, "ValueError: bad batch")):
        t = batch_triage(frame(spark), SC.udf_scorer(load))
        rows = t.select("local_probs", "label", "confidence", "model_error").distinct().collect()
        assert [tuple(r) for r in rows] == [(None, "WASPADA", "LOW", reason)]


def test_cascade_filters_before_the_join(spark):
    t = batch_triage(frame(spark), SC.linear_scorer(MODEL))
    reply = '{"label": "TINGGI", "probabilities": {"TINGGI": 0.9, "AMAN": 0.1}, "risk_score": 80, "recommendation": "ESCALATE", "ambiguity_notes": "long enough"}'
    replies = spark.createDataFrame([(1, reply), (0, reply), (7, "{broken")], "doc_id int, reply string")
    deep = deep_triage(t, replies, "doc_id")
    plan = deep._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter"):].splitlines()
    assert any("Filter" in line and "local_probs" in line for line in below)
    got = {r["doc_id"]: r for r in deep.collect()}
    assert 0 not in got and got[1]["parse_ok"] and got[1]["final_label"] == "TINGGI"  # doc 0 is safe
    assert not got[2]["parse_ok"] and not got[7]["parse_ok"]
    assert sum(1 for _ in deep_triage(t, replies, "doc_id", cascade=False).collect()) == len(TEXTS)
    log = radar_log_rows(deep).collect()
    assert [(r["pipeline_mode"], r["predicted_label"], r["risk_score"]) for r in log] == [("RADAR", "TINGGI", 80)]
    assert sweep_log_rows(t).filter("risk_score = 0 AND pipeline_mode = 'SWEEP'").count() == len(TEXTS)


def test_score_is_computed_once(spark):
    """A filter on the label reads the score; it does not spell the model out again."""
    t = batch_triage(frame(spark), SC.linear_scorer(MODEL)).filter("label <> 'AMAN'").select("doc_id")
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("exp(") <= 6  # three scores, spelled out once or twice
