"""Result logs, feedback and the response cache: A14, A15, A16, A18, B23, E5, E8, G15, F18.

Storage is plain parquet; key contracts are enforced by the operators:

* ``analysis_logs`` - first write wins per ``id``: within a batch the
  earliest arrival per id is kept, then ids already stored are removed with a
  left-anti join. The log lies under ``path/batch_id=.../day=...``, so date look-backs
  prune days. The ids alone lie under ``path_ids/buckets=N/batch_id=.../bucket=...``
  by hash: a batch reads the buckets it can hit, and no log row.
* ``feedback_logs`` - append-only events with a ``seq``; the resolved view
  keeps the *first* original label and the *latest* correction per key.
* the response cache - ``read_through`` computes each missing key once and adds
  what it computed.

Winners per key are found by ``operators.winners`` (hash aggregates of narrow columns).
Appends are idempotent per batch: each batch writes
to its own ``batch_id=`` folders in overwrite mode, so a re-run of the same
batch (after an executor or driver loss) replaces its own output instead of
duplicating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.operators.partitioning import salted_lookup
from sift.operators.winners import one_per_key
from sift.schemas import ANALYSIS_LOG

ID_BUCKETS = 64


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Earliest row per ``key`` by ``order_col``."""
    return one_per_key(df, key, order_col)


def new_log_rows(batch: DataFrame, existing: DataFrame | None, key: str = "id",
                 arrival: str = "arrival") -> DataFrame:
    """Rows of ``batch`` that would be inserted: the first per id
    within the batch, and only ids not already in ``existing``."""
    if existing is not None:  # before the winners are picked, so that rows without a chance are not shuffled again
        batch = batch.join(existing.select(key), key, "left_anti").select(*batch.columns)
    return first_per_key(batch, key, arrival)


def id_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ID_BUCKETS)).cast("int")


def _ids_path(path: str) -> str:
    return f"{path.rstrip('/')}_ids/buckets={ID_BUCKETS}"


def _read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Only a missing path counts as "nothing stored"; any other read error is raised,
    as rows stored before would be written twice."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_ids(spark: SparkSession, path: str, buckets: list[int] | None = None, but_batch: str | None = None,
               key: str = "id") -> DataFrame | None:
    """Ids in the log at ``path`` (``id``), only of the given hash ``buckets``; None where
    nothing is stored. A log written without its id folder is read itself."""
    kind = ANALYSIS_LOG[key]
    batch = T.StructField("batch_id", T.StringType())
    ids = _read_if_there(spark, _ids_path(path), T.StructType([kind, batch, T.StructField("bucket", T.IntegerType())]))
    if ids is None:
        ids = _read_if_there(spark, path, T.StructType([kind, batch]))
        buckets = None
    if ids is None:
        return None
    if but_batch is not None:
        ids = ids.filter(F.col("batch_id") != but_batch)
    return (ids if buckets is None else ids.filter(F.col("bucket").isin(buckets))).select(key)


def append_first_write(spark: SparkSession, batch: DataFrame, path: str, batch_id: str,
                       key: str = "id", arrival: str = "arrival") -> DataFrame:
    """Append the new rows of one batch to the log at ``path`` and
    return them. What the batch itself wrote before is left out of account and replaced.

    ``batch_id`` names the batch among all writers of ``path``: a second
    writer must not reuse it (``streaming.triage_stream`` puts the stream's own
    id in front). The log is written before the ids: a batch that fails between is
    replayed under its own name."""
    batch = batch.persist()  # read for the buckets, the winners and the rows
    try:
        hit = sorted(r[0] for r in batch.select(id_bucket(key)).distinct().collect())  # at most ID_BUCKETS numbers
        rows = new_log_rows(batch, stored_ids(spark, path, hit, batch_id, key), key, arrival)
        cols = [f.name for f in ANALYSIS_LOG.fields if f.name in rows.columns]
        mine = f"{path.rstrip('/')}/batch_id={batch_id}"
        day = F.to_date("timestamp") if "timestamp" in cols else F.lit(None).cast("date")
        rows.select(*cols, day.alias("day")).write.mode("overwrite").partitionBy("day").parquet(mine)
    finally:
        batch.unpersist()
    written = spark.read.schema(T.StructType([ANALYSIS_LOG[c] for c in cols])).parquet(mine)
    (written.select(key, id_bucket(key).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
     .parquet(f"{_ids_path(path)}/batch_id={batch_id}"))
    return written


def read_log(spark: SparkSession, path: str, as_of: str | None = None, days_back: int = 0) -> DataFrame:
    """The log; with ``as_of`` and ``days_back`` only the days that a look-back (B23) can reach."""
    log = spark.read.schema(T.StructType([*ANALYSIS_LOG.fields, T.StructField("batch_id", T.StringType()),
                                          T.StructField("day", T.DateType())])).parquet(path)
    if as_of is not None and days_back > 0:
        log = log.filter(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days_back))
    return log


def resolve_feedback(events: DataFrame, key: str = "text_hash", seq: str = "seq") -> DataFrame:
    """One row per key: first original label, latest timestamp /
    correction / notes (null notes -> ""). Ties of ``seq`` go by a hash of the row."""
    cols = events.select(key, "timestamp", "original_label", "corrected_label", "notes", seq)
    first = one_per_key(cols, key, seq).select(F.col(key).alias("__k"), "original_label")
    last = one_per_key(cols, key, seq, last=True).select(
        key, "timestamp", "corrected_label", F.coalesce("notes", F.lit("")).alias("notes"))
    n = events.groupBy(F.col(key).alias("__n")).agg(F.count(F.lit(1)).alias("n_events"))
    return (last.join(first, F.col(key).eqNullSafe(F.col("__k"))).join(n, F.col(key).eqNullSafe(F.col("__n")))
            .select(key, "timestamp", "original_label", "corrected_label", "notes", "n_events"))


def apply_feedback(corpus: DataFrame, feedback: DataFrame, corpus_key: str, fb_key: str = "text_hash",
                   label_col: str = "label") -> DataFrame:
    """Corrected labels override corpus labels (left join on the key)."""
    fb = feedback.select(F.col(fb_key).alias("__fk"), F.col("corrected_label").alias("__corr"))
    j = corpus.join(fb, corpus[corpus_key] == fb["__fk"], "left")
    return (j.withColumn("label_source", F.when(F.col("__corr").isNotNull(), "feedback").otherwise("corpus"))
            .withColumn(label_col, F.coalesce(F.col("__corr"), F.col(label_col)))
            .drop("__fk", "__corr"))


def retrain_gate(feedback: DataFrame, threshold: int = 50) -> DataFrame:
    """feedback count and whether it reaches the retrain threshold."""
    return feedback.agg(F.count(F.lit(1)).alias("feedback_count")).withColumn(
        "ready", F.col("feedback_count") >= threshold)


def request_key(df: DataFrame, cols: list[str]) -> DataFrame:
    """Canonical request key = sha256 of the JSON of the request fields
    in sorted name order."""
    return df.withColumn("cache_key", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])), 256))


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str = "cache_key", response: str = "response") -> DataFrame:
    """``requests`` with ``response`` and ``hit``. The cache is looked up once per
    distinct key; the requests, of which very many may share a key, then take the key's
    result from a salted lookup."""
    keys = requests.select(key).filter(F.col(key).isNotNull()).distinct()
    found = keys.join(cache.select(key, response), key)
    out = salted_lookup(requests, found, key, salt_by=[c for c in requests.columns if c != key] or [key], how="left")
    return out.select(*requests.columns, response, F.col(response).isNotNull().alias("hit"))


def read_through(requests: DataFrame, path: str, batch_id: str, compute: Callable[[DataFrame], DataFrame], fields: list[str],
                 key: str = "cache_key", response: str = "response") -> DataFrame:
    """Answers every request from the cache at ``path`` (``key, response``), and
    has ``compute`` answer each missing distinct key once: it gets ``key`` and
    ``fields`` and returns ``key, response``. What it answers (null: no answer) is added to the
    cache under ``batch_id=...`` in one job before the requests are joined, so a later run
    finds it; a replay of the batch computes and replaces its own part. ``hit`` tells what was stored before."""
    spark = requests.sparkSession
    schema = T.StructType([requests.schema[key], T.StructField(response, T.StringType()), T.StructField("batch_id", T.StringType())])
    stored = _read_if_there(spark, path, schema)
    before = None if stored is None else stored.filter(F.col("batch_id") != batch_id)
    missing = requests.select(key, *fields).filter(F.col(key).isNotNull()).distinct()  # equal keys are equal requests
    if before is not None:
        missing = missing.join(before.select(key), key, "left_anti")
    computed = compute(missing).select(key, F.col(response).cast("string").alias(response)).filter(F.col(response).isNotNull())
    mine = f"{path.rstrip('/')}/batch_id={batch_id}"
    computed.write.mode("overwrite").parquet(mine)
    new = spark.read.schema(T.StructType(schema.fields[:2])).parquet(mine).withColumn("__hit", F.lit(False))
    known = new if before is None else new.unionByName(before.select(key, response, F.lit(True).alias("__hit")))
    out = salted_lookup(requests, known, key, salt_by=[c for c in requests.columns if c != key] or [key], how="left")
    return out.select(*requests.columns, response, F.coalesce("__hit", F.lit(False)).alias("hit"))
