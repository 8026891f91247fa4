"""First write wins, upsert, analyst queries (FIXTURES.md 10-12)."""

import datetime as dt

from pyspark.sql import functions as F

from sift.operators import evaluation as EV
from sift.operators import reports as R
from sift.operators import store as ST


def _logs(spark, rows):
    return spark.createDataFrame(rows, "id string, timestamp timestamp_ntz, predicted_label string, "
                                       "input_text string, arrival long")


def test_first_write_wins_idempotent(spark):
    t = dt.datetime(2024, 1, 2)
    b1 = _logs(spark, [("a", t, "AMAN", "x", 1), ("a", t, "TINGGI", "y", 2), ("b", t, "AMAN", "z", 3)])
    stored = ST.new_log_rows(b1, None)
    assert {r["id"]: r["predicted_label"] for r in stored.collect()} == {"a": "AMAN", "b": "AMAN"}
    b2 = _logs(spark, [("a", t, "WASPADA", "q", 4), ("c", t, "AMAN", "w", 5)])
    added = ST.new_log_rows(b2, stored)
    assert [r["id"] for r in added.collect()] == ["c"]
    assert ST.new_log_rows(b2, stored.unionByName(added)).count() == 0


def test_append_first_write_replay(spark, tmpdir_path):
    t = dt.datetime(2024, 1, 2)
    b = _logs(spark, [("a", t, "AMAN", "x", 1)])
    path = f"{tmpdir_path}/logs"
    ST.append_first_write(spark, b, path, "0")
    ST.append_first_write(spark, b, path, "0")  # replay of the same batch
    assert spark.read.parquet(path).count() == 1


def test_feedback_upsert_keeps_first_original(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    ev = spark.createDataFrame([("h", t1, "AMAN", "WASPADA", None, 1), ("h", t2, "TINGGI", "TINGGI", "n", 2)],
                               "text_hash string, timestamp timestamp_ntz, original_label string, "
                               "corrected_label string, notes string, seq long")
    r = ST.resolve_feedback(ev).collect()[0]
    assert r["original_label"] == "AMAN" and r["corrected_label"] == "TINGGI" and r["notes"] == "n"
    r2 = ST.resolve_feedback(ev.filter("seq = 1")).collect()[0]
    assert r2["notes"] == ""


def test_search_bounds(spark):
    rows = [("a", dt.datetime(2024, 1, 23, 0, 0, 0), "TINGGI", "k 50% off", 1),
            ("b", dt.datetime(2024, 1, 22, 23, 59, 59), "TINGGI", "k", 2),
            ("c", dt.datetime(2024, 1, 29), "AMAN", "k_x", 3)]
    logs = _logs(spark, rows).withColumn("risk_score", F.lit(None).cast("int")) \
        .withColumn("confidence", F.lit("LOW")).withColumn("entropy", F.lit(None).cast("double")) \
        .withColumn("pipeline_mode", F.lit("SWEEP"))
    got = R.search_threats(logs, "2024-01-30", label="tinggi", days_back=7).collect()
    assert [r["id"] for r in got] == ["a"] and got[0]["risk_score"] == 0 and got[0]["entropy"] == 0.0
    assert len(R.search_threats(logs, "2024-01-30", label="", days_back=0, keyword="_").collect()) == 3


def test_report_zero_division(spark):
    pred = spark.createDataFrame([("AMAN", "AMAN"), ("WASPADA", "AMAN"), ("AMAN", "WASPADA")],
                                 "true_label string, pred_label string")
    rep = {r["class"]: r for r in EV.class_report(pred).collect()}
    assert rep["TINGGI"]["precision"] == 0.0 and rep["TINGGI"]["support"] == 0
    assert rep["accuracy"]["f1"] == round(1 / 3, 4)
    conf = EV.confusion(pred).collect()
    assert len(conf) == 9


def test_class_report_makes_its_predictions_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    rows = [("AMAN", "AMAN")] * 3 + [("AMAN", "TINGGI"), ("TINGGI", "AMAN"), ("WASPADA", None)]
    pred = spark.createDataFrame(rows, "true_label string, pred_label string").mapInArrow(seen, "true_label string, pred_label string")
    assert EV.class_report(pred).count() == 6 and len(EV.class_report(pred).collect()) == 6
    calls.value = 0
    got = [tuple(r) for r in EV.class_report(pred).collect()]
    assert calls.value == len(rows)
    assert got[0] == ("AMAN", 0.75, 0.75, 0.75, 4) and got[3:] == [
        ("accuracy", 0.5, 0.5, 0.5, 6), ("macro avg", 0.25, 0.25, 0.25, 6), ("weighted avg", 0.5, 0.5, 0.5, 6)]


def test_training_reads_its_rows_once(spark):
    from sift.operators import ml as ML
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    rows = [(f"{w} word{i}", l) for i in range(5) for w, l in (("calm", "AMAN"), ("odd", "WASPADA"), ("bad", "TINGGI"))]
    df = spark.createDataFrame(rows, "text string, label string").mapInArrow(seen, "text string, label string")
    model = ML.train_classifier(df, max_iter=3, num_features=64)
    assert calls.value == len(rows) and len(model.stages) == 4
