"""Helpers shared by the operators of this subpackage.

* ``materialize`` cuts lineage with a Parquet table in the folder that the
  cluster names in ``spark.checkpoint.dir`` (shared by driver and executors,
  so it survives lost executors). A scratch folder is used only in local sessions
  without that setting (tests); elsewhere its absence is an error.
* ``order_buckets`` splits an ordered key into even ranges, from which global
  running sums and neighbours are built without one task seeing all rows.
"""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sift import session

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MIN_LONG = -(2**63)
BATCH_ROWS = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return session.scratch_path(spark, f"sift-llm/{name}")


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Batches of at most ``rows`` rows between Spark and the workers for what runs inside: where rows hold
    whole texts or sets, batches of the usual 10,000 rows lie beside the heap, several a task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(int(was), rows) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add (any case)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def row_hash(df: DataFrame) -> Column:
    """Hash of a whole row; columns that hold maps, which have no hash, go by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in df.dtypes])


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns, and all others in one struct ``__rest``: an operator that adds
    columns then meets none of the same name, and carries columns of any type."""
    rest = [c for c in df.columns if c not in needed]
    return df.select(*needed, (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__rest"))


def unpacked(df: DataFrame, columns: list[str], *needed: str) -> DataFrame:
    """``columns`` of a frame made by ``packed`` with the same ``needed``, in their order."""
    return df.select(*[F.col(c) if c in needed else F.col("__rest")[c].alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def order_key(col: str) -> Column:
    """An integer id as a non-null sort key: null ids come first."""
    return F.coalesce(F.col(col).cast("long"), F.lit(MIN_LONG))


@dataclass
class Buckets:
    """Lower bounds (values that occur in the data, ascending) of even ranges."""

    bounds: list[int]

    def of(self, key: Column) -> Column:
        """Index of the range that holds ``key``: a coarse then a fine scan
        over the bounds, so about 2 * sqrt(len) comparisons a row."""
        b, step = self.bounds, max(1, int(len(self.bounds) ** 0.5))
        if len(b) <= 1:
            return F.lit(0)
        ge = lambda arr: F.size(F.filter(arr, lambda x: x <= key))
        lit = lambda xs: F.from_json(F.lit("[" + ",".join(map(str, xs)) + "]"), "array<bigint>")
        coarse = F.greatest(ge(lit(b[::step])) - 1, F.lit(0))
        return (coarse * step + ge(F.slice(lit(b), coarse * step + 1, step)) - 1).cast("int")


def order_buckets(df: DataFrame, key: Column, n: int) -> Buckets:
    """At most ``n`` + 1 ranges of nearly equal row counts. Only the bounds
    (``n`` numbers, whatever the input) reach the driver."""
    probs = [i / n for i in range(n)]
    r = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, probs, 20 * n).alias("q")).first()
    if r["lo"] is None:
        return Buckets([])
    return Buckets(sorted({r["lo"], *r["q"]}))


class WordHashes(dict):
    """64-bit hashes of words (str or bytes); forgets all beyond a bound."""

    def __missing__(self, w):
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


word_hash = WordHashes()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, keep: Column | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, label`` of about ``rows`` labelled documents (the bound of a
    classifier's training sample), chosen by a hash of the id. Labels that are null are left
    out; of several labels of an id the largest counts, of several
    rows of an id the text of the smallest hash."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    if keep is not None:
        known = known.filter(keep)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(n, 1))) < rows)  # about ``rows`` rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return (texts.join(F.broadcast(picked), "id").groupBy("id", "label")
            .agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("id", "text", "label"))
