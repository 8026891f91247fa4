"""Composed reports: A12, A13, H3, I2.

A report is one nested document made of several small frames (counts, metrics, a matrix,
parameters). Each part is reduced to one row holding its value; the rows are
united and folded to one row by part number. There is no cross join, and one write makes the
document. Parts are small by construction: one row a class, a pair of classes, a
parameter. Rows that grow with the data (the files of a transcript evaluation) are
written beside the document, not into it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.operators import evaluation as EV
from sift.operators import wer as WR
from sift.operators.curation import class_counts, class_weights
from sift.schemas import DEFAULT_SCHEME, LabelScheme

ROW = T.StructType([T.StructField("precision", T.DoubleType()), T.StructField("recall", T.DoubleType()),
                    T.StructField("f1", T.DoubleType()), T.StructField("support", T.LongType())])
COUNTS = T.MapType(T.StringType(), T.LongType())
RESULTS = T.StructType([T.StructField(c, T.DoubleType()) for c in ("weighted_f1", "macro_f1", "critical_precision", "critical_recall")])
CRITERIA = T.StructType([T.StructField("weighted_f1_min", T.DoubleType()), T.StructField("critical_precision_min", T.DoubleType()),
                         T.StructField("weighted_f1_pass", T.BooleanType()), T.StructField("critical_precision_pass", T.BooleanType())])
MATRIX = T.ArrayType(T.ArrayType(T.LongType()))
DATASET_REPORT = T.StructType([
    T.StructField("rows", T.StructType([T.StructField(c, T.LongType()) for c in ("raw_rows", "cleaned_rows", "train_rows", "test_rows")])),
    T.StructField("class_distribution", T.StructType([T.StructField("train", COUNTS), T.StructField("test", COUNTS)])),
    T.StructField("label_mapping", T.MapType(T.StringType(), T.StringType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType()))])
TRAINING_REPORT = T.StructType([
    T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("class_weights", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("results", RESULTS), T.StructField("classification_report", T.MapType(T.StringType(), ROW)),
    T.StructField("confusion_matrix", MATRIX), T.StructField("passing_criteria", CRITERIA)])
SELECTION_REPORT = T.StructType([f for f in TRAINING_REPORT if f.name in ("params", "results", "confusion_matrix")])
WER_REPORT = T.StructType([
    T.StructField("params", T.MapType(T.StringType(), T.StringType())), T.StructField("num_files", T.LongType()),
    T.StructField("num_failed", T.LongType()), T.StructField("average_wer", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("errors", COUNTS)])


def map_of(df: DataFrame, key: str, value: Column | str) -> DataFrame:
    """One row: ``{key: value}`` over a frame with few keys (a null key is "null")."""
    value = F.col(value) if isinstance(value, str) else value
    return df.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(F.col(key).cast("string"), F.lit("null")), value))).alias("v"))


def row_of(df: DataFrame) -> DataFrame:
    """One row: a one-row frame's columns as a struct."""
    return df.agg(F.first(F.struct(*df.columns)).alias("v"))


def const(spark: SparkSession, value: dict[str, str]) -> DataFrame:
    return spark.range(1).select(F.create_map(*[F.lit(str(x)) for kv in value.items() for x in kv]).alias("v"))


def compose(parts: dict[str, DataFrame], schema: T.StructType) -> DataFrame:
    """One row with a column per part. Each part is a frame of one row with the column
    ``v`` in the type that ``schema`` gives it; a part without a row is null."""
    as_text = [df.select(F.lit(i).alias("part"), F.to_json(F.struct("v")).alias("j")) for i, df in enumerate(parts.values())]
    rows = reduce(DataFrame.unionAll, as_text)
    one = rows.agg(*[F.max(F.when(F.col("part") == i, F.col("j"))).alias(f"j{i}") for i in range(len(parts))])
    return one.select(*[F.from_json(f"j{i}", T.StructType([T.StructField("v", schema[n].dataType)]))["v"].alias(n) for i, n in enumerate(parts)])


def _matrix(pred: DataFrame, scheme: LabelScheme) -> DataFrame:
    """Counts in label order, rows by true label."""
    order = {label: i for i, label in enumerate(scheme.labels)}
    at = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col(c))
    cells = EV.confusion(pred, scheme).select(at("true_label").alias("i"), at("pred_label").alias("j"), F.col("n").cast("long").alias("n"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "n"))), lambda x: x["n"]).alias("row"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda x: x["row"]).alias("v"))


def _results(report: DataFrame, scheme: LabelScheme) -> DataFrame:
    pick = lambda name, c: F.max(F.when(F.col("class") == name, F.col(c)))
    return row_of(report.agg(pick("weighted avg", "f1").alias("weighted_f1"), pick("macro avg", "f1").alias("macro_f1"),
                             pick(scheme.critical, "precision").alias("critical_precision"), pick(scheme.critical, "recall").alias("critical_recall")))


def dataset_report(raw: DataFrame, split: DataFrame, label_mapping: dict[str, str], params: dict[str, str]) -> DataFrame:
    """Counts of a curation run: ``split`` holds ``label`` and ``split`` ('train' / 'test') of the kept rows."""
    spark = raw.sparkSession
    n = lambda c: F.count_if(F.col("split") == c)
    sizes = split.agg(F.count(F.lit(1)).alias("cleaned_rows"), n("train").alias("train_rows"), n("test").alias("test_rows"))
    raw_n = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    both = raw_n.unionByName(sizes, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("raw_rows", "cleaned_rows", "train_rows", "test_rows")])
    per = class_counts(split, "split", "label").groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("label", F.lit("null")), "n"))).alias("m"))
    sides = per.agg(*[F.first(F.when(F.col("split") == s, F.col("m")), ignorenulls=True).alias(s) for s in ("train", "test")])
    return compose({"rows": row_of(both), "class_distribution": row_of(sides), "label_mapping": const(spark, label_mapping),
                    "params": const(spark, params)}, DATASET_REPORT)


def training_report(train: DataFrame, pred: DataFrame, params: dict[str, str], scheme: LabelScheme = DEFAULT_SCHEME,
                    min_f1: float = 0.70, min_critical_precision: float = 0.75) -> DataFrame:
    """H3: class weights of the training rows (``label``), and metrics, report, matrix and gates of ``pred``."""
    report = EV.class_report(pred, scheme)
    gate = EV.kpi_gate(report, scheme, min_f1, min_critical_precision).select(
        F.lit(min_f1).alias("weighted_f1_min"), F.lit(min_critical_precision).alias("critical_precision_min"),
        F.col("f1_pass").alias("weighted_f1_pass"), F.col("precision_pass").alias("critical_precision_pass"))
    return compose({"params": const(train.sparkSession, params), "class_weights": map_of(class_weights(train), "label", F.round("weight", 6)),
                    "results": _results(report, scheme), "classification_report": map_of(report, "class", F.struct("precision", "recall", "f1", "support")),
                    "confusion_matrix": _matrix(pred, scheme), "passing_criteria": row_of(gate)}, TRAINING_REPORT)


def selection_report(pred: DataFrame, params: dict[str, str], scheme: LabelScheme = DEFAULT_SCHEME) -> DataFrame:
    """The shorter report of a few-shot or selected model."""
    return compose({"params": const(pred.sparkSession, params), "results": _results(EV.class_report(pred, scheme), scheme),
                    "confusion_matrix": _matrix(pred, scheme)}, SELECTION_REPORT)


def wer_report(pairs: DataFrame, params: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(document, rows). The rows are every file with its rates or its error, for a table of their own;
    the document has the mean over the files without an error, the band, and the errors' counts."""
    rows = WR.with_wer(pairs).select("name", "w.*")
    total = rows.agg(F.round(F.avg(F.when(F.col("error").isNull(), F.col("wer"))), 4).alias("average_wer"),
                     F.count_if(F.col("error").isNull()).alias("num_files"), F.count_if(F.col("error").isNotNull()).alias("num_failed"))
    total = total.withColumn("status", WR.wer_status(F.col("average_wer")))
    one = lambda c: total.select(F.col(c).alias("v"))
    errors = map_of(rows.filter("error IS NOT NULL").groupBy("error").agg(F.count(F.lit(1)).alias("n")), "error", "n")
    doc = compose({"params": const(pairs.sparkSession, params), **{c: one(c) for c in ("num_files", "num_failed", "average_wer", "status")},
                   "errors": errors}, WER_REPORT)
    return doc, rows


def leaves(report: DataFrame) -> DataFrame:
    """A report's values as rows ``path, value``, whatever its sections."""
    def walk(c: Column, kind: T.DataType, path: str):
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in walk(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StructType):
            return [F.flatten(F.transform(F.map_entries(c), lambda e: F.array(*[
                F.struct(F.concat(F.lit(f"{path}."), e["key"], F.lit(f".{f.name}")).alias("path"), e["value"][f.name].cast("string").alias("value"))
                for f in kind.valueType])))]
        if isinstance(kind, T.MapType):
            return [F.transform(F.map_entries(c), lambda e: F.struct(F.concat(F.lit(f"{path}."), e["key"]).alias("path"), e["value"].cast("string").alias("value")))]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            return [F.flatten(F.transform(c, lambda row, i: F.transform(row, lambda x, j: F.struct(
                F.concat(F.lit(f"{path}."), i.cast("string"), F.lit("."), j.cast("string")).alias("path"), x.cast("string").alias("value")))))]
        return [F.array(F.struct(F.lit(path).alias("path"), c.cast("string").alias("value")))]
    empty = F.array().cast("array<struct<path:string,value:string>>")
    parts = [F.coalesce(x, empty) for f in report.schema for x in walk(F.col(f.name), f.dataType, f.name)]
    return report.select(F.explode(F.concat(*parts)).alias("x")).select("x.path", "x.value")
