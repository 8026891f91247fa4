"""Composed reports and single operators that the queries also cover."""

import json

from pyspark.sql import functions as F

from sift.operators import evaluation as EV
from sift.operators import ml as ML
from sift.operators import report_docs as RD
from sift.sources import files as SF


def _pred(spark):
    rows = [("AMAN", "AMAN"), ("AMAN", "TINGGI"), ("TINGGI", "TINGGI"), ("WASPADA", "AMAN"), ("AMAN", "TINGGI")]
    return spark.createDataFrame([(i, t, p, t == p, 0.1 * i) for i, (t, p) in enumerate(rows)], "id int, true_label string, pred_label string, correct boolean, entropy double")


def test_training_report_round_trip_in_one_document(spark, tmpdir_path):
    train = spark.createDataFrame([("AMAN",)] * 6 + [("TINGGI",)] * 2, "label string")
    doc = RD.training_report(train, _pred(spark), {"epochs": "3"})
    plan = doc._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    SF.write_report(doc, f"{tmpdir_path}/r")
    back = SF.read_report(spark, f"{tmpdir_path}/r", RD.TRAINING_REPORT)
    assert back.collect() == doc.collect() and back.count() == 1
    r = back.first()
    assert r["confusion_matrix"] == [[1, 0, 2], [1, 0, 0], [0, 0, 1]] and r["class_weights"] == {"AMAN": 0.666667, "TINGGI": 2.0}
    assert r["results"]["critical_precision"] == 0.3333 and r["passing_criteria"]["weighted_f1_pass"] is False
    # the same document as another program writes it, indented
    with open(f"{tmpdir_path}/indented.json", "w") as f:
        json.dump(json.loads(doc.toJSON().first()), f, indent=2)
    again = SF.read_report(spark, f"{tmpdir_path}/indented.json", RD.TRAINING_REPORT)
    assert sorted(map(tuple, RD.leaves(again).collect())) == sorted(map(tuple, RD.leaves(doc).collect()))


def test_reports_of_empty_inputs(spark):
    none = _pred(spark).limit(0)
    assert RD.selection_report(none, {"a": "b"}).first()["confusion_matrix"] == [[0] * 3] * 3
    pairs = spark.createDataFrame([], "name string, reference string, hypothesis string")
    doc, rows = RD.wer_report(pairs, {"language": "x"})
    assert doc.first()["num_files"] == 0 and doc.first()["average_wer"] is None and rows.count() == 0
    split = spark.createDataFrame([], "label string, split string")
    r = RD.dataset_report(split, split, {"A": "b"}, {"c": "d"}).first()
    assert r["rows"]["cleaned_rows"] == 0 and r["class_distribution"]["train"] is None


def test_wer_report_keeps_failures_as_rows(spark):
    pairs = spark.createDataFrame([("a", "x y", "x z"), ("b", "x", None), ("c", "", "q")], "name string, reference string, hypothesis string")
    doc, rows = RD.wer_report(pairs, {"language": "x"})
    r = doc.first()
    assert (r["num_files"], r["num_failed"], r["average_wer"], r["status"]) == (1, 2, 0.5, "retrain")
    assert r["errors"] == {"missing text": 1, "empty reference": 1} and rows.count() == 3


def test_errors_and_quartiles(spark):
    pred = _pred(spark)
    assert [tuple(r) for r in EV.error_patterns(pred).collect()] == [("AMAN", "TINGGI", 2, 0.6), ("WASPADA", "AMAN", 1, 0.6)]
    assert [r["id"] for r in EV.error_examples(pred, "id", 2).collect()] == [1, 3]
    q = {r["correct"]: (r["q1"], r["q2"], r["q3"]) for r in EV.quartiles(pred, "entropy", "correct").collect()}
    assert q == {True: (0.05, 0.1, 0.15), False: (0.2, 0.3, 0.35)}
    assert {r["bin"]: r["n"] for r in EV.histogram(pred, "entropy", None, 2).collect()} == {0: 2, 1: 3}
    assert EV.histogram(pred.limit(0), "entropy").count() == 0


def test_vectors_attach_and_lay_out(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [0.0, 2.0])], "vec_id int, embedding array<float>")
    df = spark.createDataFrame([(1, "AMAN"), (2, "AMAN"), (3, "TINGGI"), (9, "AMAN")], "doc_id int, label string").withColumn("entropy", F.lit(0.5)).withColumn("text", F.lit("abc"))
    got = {r["doc_id"]: r["unit"] for r in ML.attach_vectors(df, v, "doc_id", "vec_id").collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] is None and got[9] is None
    assert {(r["x"], r["y"]) for r in ML.layout_2d(df, "doc_id").collect()} == {(0.5, 3.0)}
    placed = ML.layout_2d(df, "doc_id", v.filter("embedding IS NOT NULL")).collect()
    assert {r["doc_id"]: r["label"] for r in placed} == {1: "AMAN", 3: "TINGGI"}
