"""Models: H1, H2, H5, D1, D10, D11 with Spark ML (distributed fitting).

The text classifier is ``RegexTokenizer -> HashingTF -> IDF ->
LogisticRegression`` over normalised text; labels are encoded by the fixed
label order (B28), not by frequency. Class weighting (H2) uses F16's
balanced weights as ``weightCol``. Scoring (D1) turns the model's
probability vector into the library's ``array<double>`` in label order.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions import scores as S
from sift.functions.text import WS
from sift.operators.curation import class_weights
from sift.schemas import DEFAULT_SCHEME, LabelScheme
from sift.session import stored


OUTPUTS = ("__tokens", "__tf", "__features", "__raw", "__probability", "__prediction")


def feature_stages(text_col: str = "text", num_features: int = 1 << 18) -> list:
    return [RegexTokenizer(inputCol=text_col, outputCol="__tokens", pattern=f"{WS}+", toLowercase=True),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features),
            IDF(inputCol="__tf", outputCol="__features")]


def classifier(max_iter: int = 50, reg: float = 0.01, weight_col: str | None = None) -> LogisticRegression:
    lr = LogisticRegression(featuresCol="__features", labelCol="__label", family="multinomial",
                            maxIter=max_iter, regParam=reg, probabilityCol="__probability",
                            predictionCol="__prediction", rawPredictionCol="__raw")
    return lr.setWeightCol(weight_col) if weight_col else lr


def _labelled(df: DataFrame, label_col: str, weighted: bool, scheme: LabelScheme) -> DataFrame:
    d = df.withColumn("__label", S.encode_label(F.col(label_col), scheme).cast("double"))
    if not weighted:
        return d.withColumn("__w", F.lit(1.0))
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias("__w"))
    return d.join(F.broadcast(w), label_col)  # one row per class


def _features(model, d: DataFrame) -> DataFrame:
    """What fitting reads, kept while it runs: every pass of the optimizer reads the
    stored vectors instead of computing texts and tokens again."""
    return model.transform(d).select("__features", "__label", "__w").persist()


def train_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                     weighted: bool = False, scheme: LabelScheme = DEFAULT_SCHEME, num_features: int = 1 << 18, **kw) -> PipelineModel:
    """H1 (plain) / H2 (balanced class weights). Texts are best given normalised
    (``normalize``), as the triage scores normalised texts. The rows are written once to the shared
    checkpoint folder, as fitting reads them twice; a small sample then lies in few partitions."""
    d = stored(_labelled(df, label_col, weighted, scheme).select(text_col, "__label", "__w"), "sift-train")
    features = Pipeline(stages=feature_stages(text_col, num_features)).fit(d)
    ready = _features(features, d)
    try:
        return PipelineModel(stages=[*features.stages, classifier(weight_col="__w", **kw).fit(ready)])
    finally:
        ready.unpersist()


def select_model(df: DataFrame, key: str, text_col: str = "text", label_col: str = "label", regs: tuple[float, ...] = (0.001, 0.01, 0.1),
                 valid_frac: float = 0.2, seed: int = 42, max_iter: int = 30, num_features: int = 1 << 18,
                 scheme: LabelScheme = DEFAULT_SCHEME) -> tuple[PipelineModel, list[tuple]]:
    """H2: class-weighted training with the best of several candidates by weighted F1 on a
    stratified validation split (exact per class, by a seeded hash of ``key``). Feature
    stages are fitted once, on the training side; all candidates read the
    same stored vectors, beside which no texts are kept (the split itself is written once). Returns the model and a row per candidate: ``reg, weighted_f1, chosen``
    (ties: the stronger regularisation)."""
    from sift.operators.sampling import stratified_split
    split = stratified_split(df.select(key, text_col, label_col), label_col, key, valid_frac, seed)
    ready: list[DataFrame] = []
    try:
        train = _labelled(split.filter("split = 'train'"), label_col, True, scheme)
        features = Pipeline(stages=feature_stages(text_col, num_features)).fit(train)
        valid = split.filter("split = 'test'").withColumn("__label", S.encode_label(F.col(label_col), scheme).cast("double")).withColumn("__w", F.lit(1.0))
        ready = [_features(features, train), _features(features, valid)]
        f1 = MulticlassClassificationEvaluator(labelCol="__label", predictionCol="__prediction", metricName="weightedFMeasure")
        tried = []
        for reg in regs:
            model = classifier(max_iter, reg, "__w").fit(ready[0])
            tried.append((round(f1.evaluate(model.transform(ready[1])), 4), reg, model))
        best = max(tried, key=lambda t: t[:2])
        return PipelineModel(stages=[*features.stages, best[2]]), [(reg, score, reg == best[1]) for score, reg, _ in tried]
    finally:
        for d in ready:
            d.unpersist()


def score(model: PipelineModel, df: DataFrame, out: str = "probs") -> DataFrame:
    """Model probabilities as array<double> in label order."""
    s = model.transform(df)
    return s.withColumn(out, vector_to_array("__probability")).drop(*OUTPUTS)


def predictions(model: PipelineModel, df: DataFrame, label_col: str = "label",
                scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """H6: true / predicted label, max probability, entropy, correct."""
    s = score(model, df)
    u = S.uncertainty(F.col("probs"), 0.1, scheme)
    return (s.withColumn("u", u)
            .select(F.col(label_col).alias("true_label"), F.col("u.label").alias("pred_label"),
                    F.array_max("probs").alias("max_prob"), F.round("u.entropy", 4).alias("entropy"))
            .withColumn("correct", F.col("true_label") == F.col("pred_label")))


def unit_vectors(df: DataFrame, col: str = "embedding", out: str = "unit") -> DataFrame:
    """L2-normalised vectors (array<double>); null vectors and null rows stay null."""
    d = df.withColumn("__v", array_to_vector(F.coalesce(col, F.array(F.lit(0.0)).cast("array<float>"))))
    d = Normalizer(inputCol="__v", outputCol="__u", p=2.0).transform(d)
    return d.withColumn(out, F.when(F.col(col).isNotNull(), vector_to_array("__u"))).drop("__v", "__u")


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str, vec_key: str, col: str = "embedding", out: str = "unit") -> DataFrame:
    """Each row with its unit vector (left join on the key)."""
    v = unit_vectors(vectors, col, out).select(F.col(vec_key).alias("__k"), out)
    return df.join(v, F.col(key) == F.col("__k"), "left").drop("__k")


def layout_2d(triaged: DataFrame, key: str, vectors: DataFrame | None = None, vec_key: str = "vec_id", col: str = "embedding",
              text_col: str = "text") -> DataFrame:
    """``key, x, y, label`` of triaged rows: the two principal components of their
    vectors, or, without a table of vectors, entropy and text length."""
    if vectors is None:
        return triaged.select(key, F.col("entropy").alias("x"), F.length(text_col).cast("double").alias("y"), "label")
    rows = triaged.select(key, "label").join(vectors.select(F.col(vec_key).alias(key), col), key)
    return pca_2d(rows, col)[0].select(key, "x", "y", "label")


def pca_2d(df: DataFrame, col: str = "embedding", k: int = 2):
    """Centred PCA to ``k`` dimensions; returns (rows with x, y, model)
    where ``model.explainedVariance`` is the variance ratio. Spark's PCA
    does not centre, so a mean-only StandardScaler runs first."""
    d = df.withColumn("__v", array_to_vector(col))
    sc = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False).fit(d)
    c = sc.transform(d)
    pca = PCA(k=k, inputCol="__c", outputCol="__p").fit(c)
    out = pca.transform(c).withColumn("__a", vector_to_array("__p"))
    out = out.select(*[x for x in df.columns if x != col],
                     *[F.col("__a")[i].alias(n) for i, n in enumerate(["x", "y", "z"][:k])])
    return out, pca


def retrain_from_feedback(corpus: DataFrame, feedback: DataFrame, corpus_key: str, n_per_class: int = 200,
                          min_feedback: int = 50, text_col: str = "text", **kw) -> PipelineModel | None:
    """H5: if the feedback count reaches the gate (F18), apply corrections (E8),
    draw a balanced sample (G7) and fit (H1). Returns the model or None."""
    from sift.operators.sampling import balanced_sample
    from sift.operators.store import apply_feedback, retrain_gate
    if not retrain_gate(feedback, min_feedback).first()["ready"]:  # one row decides whether to train at all
        return None
    fixed = apply_feedback(corpus, feedback, corpus_key).select(*corpus.columns)
    sample = balanced_sample(fixed, "label", corpus_key, n_per_class, source_col="sample_source")
    return train_classifier(sample, text_col, **kw)
