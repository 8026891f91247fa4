"""Class probabilities from the normalised text.

A scorer takes the normalised frame and returns it with ``local_probs``
(``array<double>`` in label order; null where the model has no answer, which
the triage turns into its fallback). Three kinds:

* ``linear_scorer`` - a multinomial linear model over token counts as column
  expressions, for up to ``MAX_INLINE_TOKENS`` tokens: no UDF, no shuffle;
* ``table_scorer`` - the same model with its weights in a table of any size: distinct
  tokens of a text are joined with the weights by token;
* ``udf_scorer`` - any external model through ``predict_batch_udf``: loaded
  once a Python worker, fed Arrow batches. A model that cannot be loaded or fails leaves nulls.

Weights are integers (thousandths), so sums do not depend on their order; the
score of a class is (bias + sum of weights over all tokens / number of tokens) / 1000,
probabilities are its softmax, rounded to 4 digits. A text without tokens has no answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.functions import text as X

MAX_INLINE_TOKENS = 200
PROBS = "local_probs"

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class LinearModel:
    """Lower-case token -> weights in thousandths, and biases, in label order."""

    bias: tuple[int, ...]
    weights: dict[str, tuple[int, ...]]

    def probabilities(self, texts) -> np.ndarray:
        """Rows of probabilities; NaN for texts without tokens."""
        out = np.full((len(texts), len(self.bias)), np.nan)
        none = (0,) * len(self.bias)
        for i, t in enumerate(texts):
            tokens = [w for w in (t or "").lower().split(" ") if w]
            if tokens:
                total = np.sum([self.weights.get(w, none) for w in tokens], axis=0, dtype=np.int64)
                e = np.exp((np.array(self.bias) + total / len(tokens)) / 1000)
                out[i] = e / e.sum()
        return out


def _finish(df: DataFrame, totals: list[Column], bias, count: Column) -> DataFrame:
    """Class scores from summed weights, each stage projected once."""
    d = df.withColumns({f"__s{i}": F.exp((F.lit(b) + t / F.greatest(count, F.lit(1))) / 1000.0) for i, (b, t) in enumerate(zip(bias, totals))})
    exps = [F.col(f"__s{i}") for i in range(len(bias))]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    d = d.withColumn("__sum", total)
    probs = F.array(*[F.round(e / F.col("__sum"), 4) for e in exps])
    return d.withColumn(PROBS, F.when(count > 0, probs)).drop("__sum", *[f"__s{i}" for i in range(len(bias))])


def linear_scorer(model: LinearModel, text_col: str = "normalized_text") -> Scorer:
    """Column form. Tokens are counted by removing them from the text with its
    spaces doubled: each token then has two spaces of its own."""
    if len(model.weights) > MAX_INLINE_TOKENS:
        raise ValueError(f"{len(model.weights)} tokens: use table_scorer beyond {MAX_INLINE_TOKENS}")

    def run(df: DataFrame) -> DataFrame:
        low = F.lower(text_col)
        d = df.withColumn("__padded", F.concat(F.lit(" "), F.replace(low, F.lit(" "), F.lit("  ")), F.lit(" ")))
        d = d.withColumns({f"__n{i}": (F.octet_length("__padded") - F.octet_length(F.replace(F.col("__padded"), F.lit(f" {w} "), F.lit(""))))
                           / F.lit(len(w.encode()) + 2) for i, w in enumerate(model.weights)})
        totals = []
        for c in range(len(model.bias)):
            t = F.lit(0)
            for i, w in enumerate(model.weights.values()):
                if w[c]:
                    t = t + F.col(f"__n{i}") * F.lit(w[c])
            totals.append(t)
        d = _finish(d, totals, model.bias, X.count_spaced_tokens(F.col(text_col)))
        return d.drop("__padded", *[f"__n{i}" for i in range(len(model.weights))])
    return run


def weight_table(spark, model: LinearModel) -> DataFrame:
    """``token, weights`` rows of a model."""
    return spark.createDataFrame([(w, list(v)) for w, v in model.weights.items()], "token string, weights array<int>")


def table_scorer(weights: DataFrame, bias: tuple[int, ...], key: str, text_col: str = "normalized_text") -> Scorer:
    """Join form for weights of any size (``token, weights``, one row a token).
    ``key`` is a unique, non-null key of the scored frame. The frame is dealt out by it once: texts
    are made once, and each text's tokens are counted and summed where it lies. A token meets its weights
    with at most one narrow row a text; adaptive execution splits a token that very many texts hold."""
    def run(df: DataFrame) -> DataFrame:
        df = df.repartition(key)
        # outer: an inner explode has the optimizer ask for the size of the token array below the deal, which makes the texts a second time
        tokens = (df.select(key, F.explode_outer(F.split(F.lower(text_col), " ")).alias("token")).filter("token <> ''")
                  .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")))
        hits = tokens.join(weights.select("token", "weights"), "token")
        # the join asks that its key is not null; for the aggregate's own that stays above the deal, which both sides then share
        sums = hits.groupBy(key).agg(F.max(key).alias("__k"), *[F.sum(F.col("n") * F.col("weights")[c]).alias(f"__t{c}") for c in range(len(bias))]).drop(key)
        d = df.join(sums, df[key] == sums["__k"], "left").drop("__k")
        totals = [F.coalesce(F.col(f"__t{c}"), F.lit(0)) for c in range(len(bias))]
        d = _finish(d, totals, bias, X.count_spaced_tokens(F.col(text_col)))
        return d.drop(*[f"__t{c}" for c in range(len(bias))])
    return run


def udf_scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]], n_labels: int = 3, text_col: str = "normalized_text",
               batch_size: int = 1000) -> Scorer:
    """External model: ``load()`` runs once a worker and returns a function from
    an array of texts to rows of probabilities (NaN: no answer). If loading
    or predicting fails, the batch's answers are null, and ``model_error`` says why."""
    def make():
        try:
            model, reason = load(), None
        except Exception as e:  # noqa: BLE001
            model, reason = None, f"{type(e).__name__}: {e}"

        def predict(texts: np.ndarray):
            none = np.full((len(texts), n_labels), np.nan)
            if model is None:
                return {"probs": none, "error": np.array([f"load: {reason}"] * len(texts))}
            try:
                return {"probs": np.asarray(model(texts), dtype=float), "error": np.array([""] * len(texts))}
            except Exception as e:  # noqa: BLE001
                return {"probs": none, "error": np.array([f"{type(e).__name__}: {e}"] * len(texts))}
        return predict

    kind = T.StructType([T.StructField("probs", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def run(df: DataFrame) -> DataFrame:
        predict = predict_batch_udf(make, return_type=kind, batch_size=batch_size)
        d = df.withColumn("__m", predict(F.coalesce(F.col(text_col), F.lit(""))))
        rounded = F.transform("__m.probs", lambda x: F.round(x, 4))
        return (d.withColumn(PROBS, F.when(~F.exists("__m.probs", lambda x: x.isNull() | F.isnan(x)), rounded))
                .withColumn("model_error", F.nullif(F.col("__m.error"), F.lit(""))).drop("__m"))
    return run


def pipeline_scorer(model) -> Scorer:
    """A fitted Spark ML pipeline (``operators.ml``) as scorer; the frame has the model's text column."""
    from sift.operators.ml import score
    return lambda df: score(model, df, PROBS)
