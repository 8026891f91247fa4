"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line. The metric is the batch-triage wall time over
the whole documents table (throughput in ``docs_per_sec``); per-query wall times are in
``queries``. Every query is forced end to end with an aggregate over all
output columns (no collect of rows to the driver). One warm-up pass on the
smallest scale factor runs first so JIT compilation is not billed to the
first timed query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

HEADLINE = [
    "batch_triage", "normalize_text", "pattern_signals", "lexicon_signals", "curated_corpus",
    "dedup_documents", "stratified_split", "balanced_sample", "log_first_write", "feedback_upsert",
    "search_threats", "trend_pivot", "class_report", "confusion", "token_highlights",
    "deep_triage", "wer_corpus", "strip_html",
]
WARMUP_DIR = "/root/testdata/sf0.001"


def force(df):
    cols = [F.col(c) for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash(*cols)).alias("h")).collect()[0]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sift.session import local_session
    from sift.plans.queries import REGISTRY
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = [n for n in HEADLINE if n in REGISTRY]
    if os.path.isdir(WARMUP_DIR):
        for n in names:
            try:
                force(REGISTRY[n](spark, WARMUP_DIR))
            except Exception:  # noqa: BLE001
                pass
    times, rows = {}, {}
    for n in names:
        t0 = time.perf_counter()
        try:
            r = force(REGISTRY[n](spark, sf_dir))
            rows[n] = int(r["n"])
            times[n] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            times[n] = None
            print(f"# {n} failed: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    tri = times.get("batch_triage")
    out = {
        "metric": "batch_triage_sec",
        "value": tri,
        "unit": "sec",
        "docs_per_sec": round(docs / tri, 1) if tri else None,
        "total_sec": round(sum(v for v in times.values() if v), 3),
        "queries": times,
        "rows": rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "documents": docs,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
