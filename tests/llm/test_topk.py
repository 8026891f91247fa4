"""op5: exact top-k against brute force, and what a worker gets at once."""

import random

import pytest
from pyspark.sql import functions as F

from sift.llm import topk


def brute(rows, step, k):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    queries, out = {}, []
    for i, v in rows:
        if i % step == 0:
            queries[i] = min(queries.get(i, v), v)
    for q, v in queries.items():
        s = sorted((-sum(a * b for a, b in zip(v, c)), i) for i, c in rows if i != q)[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def found(spark, rows, step, k=5):
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % step == 0, k).collect())


@pytest.mark.parametrize("big", [2, 300, 10**5, 10**9 // 4])
def test_every_kind_of_number_and_odd_rows(spark, big):
    r = random.Random(big)
    rows = [(r.randrange(-100, 200), [r.randint(-big, big) for _ in range(r.randrange(0, 6))]) for _ in range(300)]
    rows += [(None, [1]), (7, None), (14, [1, None])]
    assert found(spark, rows, 7) == brute(rows, 7, 5)


def test_ties_few_rows_and_no_rows(spark):
    ties = [(i, [1, 2] if i % 3 else [i % 4, 1]) for i in range(1500)]
    assert found(spark, ties, 50) == brute(ties, 50, 5)
    few = [(7 * i, [i]) for i in range(3)]
    assert found(spark, few, 7) == brute(few, 7, 5)
    assert found(spark, [(7, [3]), (7, [1])], 7) == found(spark, [], 7) == found(spark, [(1, [3])], 7) == []


def test_a_worker_gets_few_blocks_at_once(spark, monkeypatch):
    """Pairs of blocks, each with both blocks, once went to a worker by the partition."""
    frame = type(spark.range(0))
    plain = frame.mapInArrow

    def watched(self, fn, *args, **more):
        def run(batches):
            def seen():
                for b in batches:
                    if b.nbytes > 1_500_000:
                        raise MemoryError(f"{b.nbytes} bytes at once")
                    yield b
            return fn(seen())
        return plain(self, run, *args, **more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    monkeypatch.setattr(topk, "C_BLOCK", 100)
    monkeypatch.setattr(topk, "Q_BLOCK", 20)
    r = random.Random(4)
    rows = [(i, [r.randint(-99, 99) for _ in range(64)]) for i in range(4000)]
    assert [x for x in found(spark, rows, 10, 1) if x[0] % 200 == 0] == brute(rows, 200, 1)
