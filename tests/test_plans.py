"""Plan-shape checks: the scale properties the operators promise."""

from pyspark.sql import functions as F

from sift.operators import curation as C
from sift.operators import sampling as SM
from sift.plans.queries import REGISTRY

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_triage_is_narrow(spark):
    p = _plan(REGISTRY["batch_triage"](spark, SF))
    # the only exchange is the hash spread of a single-split input
    assert p.count("Exchange") <= 1
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "BatchEvalPython" not in p  # no row-at-a-time Python UDF


def test_rollup_makes_its_signals_once(spark):
    p = REGISTRY["signal_rollup"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("aggregate(concat(") == 1  # the fold over a text's signals


def test_dedup_partial_aggregation(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(30)], "id int, text string")
    p = _plan(C.dedup_first(C.with_text_hash(df), "text_hash", "id"))
    assert "partial_min" in p and "Window" not in p


def test_split_reads_its_input_once_and_leaves_no_cache(spark):
    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(f"k{i}", "A" if i % 4 else "B") for i in range(200)], "text_id string, label string").mapInArrow(
        seen, "text_id string, label string")
    split = SM.stratified_split(df, "label", "text_id")
    assert split.filter("split = 'test'").count() == 40 and calls.value == 200
    assert "InMemoryTableScan" not in _plan(split) and "Cartesian" not in _plan(split) and "NestedLoop" not in _plan(split)


def test_scan_prunes_columns(spark):
    p = _plan(REGISTRY["dedup_documents"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in p
    assert "TakeOrderedAndProject" in _plan(REGISTRY["search_threats"](spark, SF))


def test_small_sample_group_limit(spark):
    df = spark.createDataFrame([(f"k{i}", "A" if i % 4 else "B") for i in range(200)], "text_id string, label string")
    p = SM.first_k_per_group(df, "label", "text_id", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_sample_equal_around_the_window_bound(spark, monkeypatch):
    rows = [(f"k{i}", None if i % 7 == 0 else "A" if i % 4 else "B") for i in range(300)]
    df = spark.createDataFrame(rows, "text_id string, label string")

    def picked(k):
        return sorted(r.text_id for r in SM.first_k_per_group(df, "label", "text_id", k).collect())

    ks = (1, 42, 43, 44, 200, 400)  # 43 rows have no class
    by_window = [picked(k) for k in ks]
    monkeypatch.setattr(SM, "WINDOW_K", 0)
    assert [picked(k) for k in ks] == by_window


def test_split_treats_null_as_a_class(spark):
    df = spark.createDataFrame([(f"k{i}", "A" if i % 2 else None) for i in range(100)], "text_id string, label string")
    n = {tuple(r) for r in SM.stratified_split(df, "label", "text_id").groupBy("label", "split").count().collect()}
    assert n == {("A", "test", 10), ("A", "train", 40), (None, "test", 10), (None, "train", 40)}


def test_sources_keep_every_row(spark):
    q = REGISTRY["source_fallback"](spark, SF)
    es = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'es'").count()
    assert q.filter("target = 'es'").count() == es > 0
