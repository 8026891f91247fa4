"""Report sink/scan (A12, A13) and model operators."""

import os

from pyspark.sql import functions as F

from sift.operators import ml as ML
from sift.sources import files as SF


def test_report_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([("AMAN", 5), ("TINGGI", 1)], "label string, n long")
    rep = df.agg(SF.counts_map(df, "label", "n").alias("class_distribution"), F.sum("n").alias("rows"))
    path = os.path.join(tmpdir_path, "report")
    SF.write_report(rep, path)
    back = SF.read_report(spark, path, "class_distribution map<string,bigint>, rows bigint").collect()[0]
    assert back["class_distribution"] == {"AMAN": 5, "TINGGI": 1} and back["rows"] == 6


def test_weighted_training_and_scoring(spark):
    rows = ([(f"aman {i} tenang damai", "AMAN") for i in range(20)]
            + [(f"waspada {i} kasar", "WASPADA") for i in range(8)]
            + [(f"tinggi {i} serang bakar", "TINGGI") for i in range(4)])
    df = spark.createDataFrame(rows, "text string, label string")
    model = ML.train_classifier(df, "text", weighted=True, num_features=1 << 10, max_iter=20)
    pred = ML.predictions(model, df).collect()
    assert len(pred) == 32 and all(0 <= r["max_prob"] <= 1 for r in pred)
    acc = sum(r["correct"] for r in pred) / len(pred)
    assert acc > 0.9


def test_pca_centres(spark):
    rows = [(i, [float(i), float(2 * i), 1.0], i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int")
    out, pca = ML.pca_2d(df, "embedding")
    xs = [r["x"] for r in out.collect()]
    assert abs(sum(xs)) < 1e-6  # centred before projection
    assert pca.explainedVariance[0] > 0.99
