"""Winners per key, the id store, date pruning and the read-through cache."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sift.operators import curation as C
from sift.operators import store as ST
from sift.operators.winners import one_per_key
from sift.plans.queries import REGISTRY
from sift.schemas import ANALYSIS_LOG

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(df):
    return [r[0] for r in df.select(F.input_file_name()).distinct().collect()]


def test_winners_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None, "c", "d"]), rnd.choice([None, 1, 2, 3]), rnd.choice(["x", "y"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(4)
    for last in (False, True):
        got = {r["k"]: r["o"] for r in one_per_key(df, "k", "o", last=last).collect()}
        want = {k: (max if last else min)([o for x, o, _ in rows if x == k], key=lambda o: -1 if o is None else o) for k in {r[0] for r in rows}}
        assert got == want
        assert one_per_key(df, "k", "o", last=last).count() == len(want)  # ties and repeated rows give one row
    ts = df.withColumn("o", F.timestamp_seconds("o").cast("timestamp_ntz"))
    assert one_per_key(ts, "k", "o").count() == 5
    words = df.withColumn("o", F.col("o").cast("string"))
    assert {r["k"] for r in one_per_key(words, "k", "o").collect()} == {"a", "b", "c", "d", None}
    assert one_per_key(df.limit(0), "k", "o").count() == 0


def test_winners_of_far_orders(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([("a", big, "x"), ("a", -big - 1, "y"), ("a", 0, "z"), ("b", big, "p"), ("b", big - 1, "q")], "k string, o long, v string")
    assert {r["k"]: r["v"] for r in one_per_key(df, "k", "o").collect()} == {"a": "y", "b": "q"}
    assert {r["k"]: r["v"] for r in one_per_key(df, "k", "o", last=True).collect()} == {"a": "x", "b": "p"}


def test_no_sort_aggregate_and_no_text_above_the_hash(spark):
    for name in ("curated_corpus", "dedup_documents", "class_distribution", "min_class_count", "log_first_write", "feedback_upsert",
                 "apply_feedback", "source_counts"):
        assert "SortAggregate" not in _plan(REGISTRY[name](spark, SF)), name
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    counts = C.class_counts(C.dedup_first(C.with_text_hash(df), "text_hash", "doc_id", unique_order=True), "source")
    plan = _plan(counts)
    above = plan[:plan.index("sha2(")]
    assert "text#" not in above


def _log(spark, rows):
    full = [(i, dt.datetime(2024, 1, d), 0.0, f"text {i}", None, "AMAN", 0, "LOW", 0.1, False, mode, a) for i, d, mode, a in rows]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ANALYSIS_LOG)
    return spark.createDataFrame(full, kinds + ", arrival long")


def test_id_store_reads_only_buckets_it_can_hit(spark, tmpdir_path):
    path = f"{tmpdir_path}/log"
    first = _log(spark, [(f"id{i}", 1 + i % 5, "SWEEP", i) for i in range(200)])
    assert ST.append_first_write(spark, first, path, "s-0").count() == 200
    assert ST.append_first_write(spark, first, path, "s-0").count() == 200  # a replay replaces itself
    second = _log(spark, [("id3", 9, "RADAR", 1), ("new", 9, "RADAR", 2), ("new", 8, "RADAR", 3)])
    added = ST.append_first_write(spark, second, path, "r-0").collect()
    assert [(r["id"], r["timestamp"].day, r["pipeline_mode"]) for r in added] == [("new", 9, "RADAR")]
    log = ST.read_log(spark, path)
    assert log.count() == 201 and log.select("id").distinct().count() == 201
    hit = sorted({r[0] for r in second.select(ST.id_bucket("id")).collect()})
    ids = ST.stored_ids(spark, path, hit, "r-0")
    plan = _plan(ids)
    assert "PartitionFilters: [" in plan and "bucket#" in plan[plan.index("PartitionFilters"):]
    files = {f.split("bucket=")[1].split("/")[0] for f in _files(ids)}
    assert files <= {str(b) for b in hit} and len(files) < ST.ID_BUCKETS
    assert "input_text" not in plan


def test_look_back_prunes_days(spark, tmpdir_path):
    path = f"{tmpdir_path}/log"
    ST.append_first_write(spark, _log(spark, [(f"i{d}", d, "SWEEP", d) for d in range(1, 29)]), path, "a")
    some = ST.read_log(spark, path, "2024-01-28", 3)
    assert {f.split("day=")[1][:10] for f in _files(some)} == {f"2024-01-{d}" for d in (25, 26, 27, 28)}
    from sift.operators import reports as R
    full = R.search_threats(ST.read_log(spark, path), "2024-01-28", days_back=3)
    assert sorted(map(str, R.search_threats(some, "2024-01-28", days_back=3).collect())) == sorted(map(str, full.collect()))


def test_log_without_an_id_folder_still_counts(spark, tmpdir_path):
    path = f"{tmpdir_path}/log"
    _log(spark, [("a", 1, "SWEEP", 1)]).drop("arrival").write.parquet(f"{path}/batch_id=old")
    added = ST.append_first_write(spark, _log(spark, [("a", 1, "SWEEP", 1), ("b", 1, "SWEEP", 1)]), path, "n")
    assert [r["id"] for r in added.collect()] == ["b"]


def test_read_through_cache(spark, tmpdir_path):
    path, calls = f"{tmpdir_path}/cache", spark.sparkContext.accumulator(0)
    req = ST.request_key(spark.createDataFrame([(i, ["x", "y", "z", None][i % 4]) for i in range(400)], "n int, q string"), ["q"])

    def compute(missing):
        def answer(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b
        return missing.mapInArrow(answer, "cache_key string, q string").select("cache_key", F.when(F.col("q") != "z", F.upper("q")).alias("response"))

    one = ST.read_through(req.filter("q = 'x'"), path, "1", compute, ["q"])
    assert one.count() == 100 and one.filter("NOT hit AND response = 'X'").count() == 100 and calls.value == 1
    two = {(r["q"], r["response"], r["hit"]): r["count"] for r in ST.read_through(req, path, "2", compute, ["q"]).groupBy("q", "response", "hit").count().collect()}
    assert two == {("x", "X", True): 100, ("y", "Y", False): 100, ("z", None, False): 100, (None, None, False): 100}
    assert calls.value == 4  # y, z and null, once each; x came from the cache
    three = ST.read_through(req.filter("q IN ('x', 'y')"), path, "3", compute, ["q"])
    assert three.filter("hit").count() == 200 and calls.value == 4
    again = ST.read_through(req.filter("q = 'y'"), path, "2", compute, ["q"])  # a replay of batch 2
    assert again.filter("NOT hit AND response = 'Y'").count() == 100
