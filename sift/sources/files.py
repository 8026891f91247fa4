"""Corpus files, reports and media inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.schemas import ANNOTATED, CURATED


def read_annotated(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: annotated corpus with the fixed schema (landed files)."""
    return spark.read.schema(ANNOTATED).format(fmt).load(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A2: raw snapshot as parquet."""
    df.write.mode("overwrite").parquet(path)


def read_corpus_csv(spark: SparkSession, path: str, schema: T.StructType = CURATED) -> DataFrame:
    """A3: CSV with header; texts may hold newlines and quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_corpus(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """A4: both splits in one write, partitioned by split (parquet default)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    if fmt == "csv":
        # spaces at the edges of texts are kept
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report frame (structs / maps) as JSON."""
    report.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A report as one JSON document, on one line or indented, by its schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def counts_map(df: DataFrame, key: str, value: str) -> Column:
    """Aggregate expression: ``{key: value}`` map over the frame (for A12)."""
    return F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), F.col(value))))


def media_inventory(spark: SparkSession, root: str, extensions=("wav", "mp3", "m4a", "flac", "ogg")) -> DataFrame:
    """Files under ``root`` whose lower-cased extension is allowed
    (path, name, length). Only metadata is read (content column dropped)."""
    d = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
         .select("path", "length"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (d.filter(ext.isin(*[e.lower() for e in extensions]))
            .withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest JSON object ``{file: reference}`` -> (name, reference)."""
    txt = spark.read.text(path, wholetext=True)
    return txt.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "reference"))
