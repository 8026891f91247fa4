"""Word error rate over a table of transcript pairs.

Word alignment is a dynamic program with no built-in, so it is an
Arrow ``pandas_udf`` (K1): each task gets Arrow batches of pairs and
computes the table's rows with NumPy for many pairs at once, one row in memory (so long
transcripts do not blow up). The corpus report around it (manifest join, status bands,
mean) is plain DataFrame work.

Among minimum-cost alignments the one with the most hits is taken; then
S, D, I follow from hits, cost and the two lengths:
S = (N - H) + (P - H) - cost, D = N - H - S, I = P - H - S.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WER_SCHEMA = T.StructType([
    T.StructField("wer", T.DoubleType()), T.StructField("mer", T.DoubleType()),
    T.StructField("wil", T.DoubleType()), T.StructField("wip", T.DoubleType()),
    T.StructField("hits", T.IntegerType()), T.StructField("substitutions", T.IntegerType()),
    T.StructField("deletions", T.IntegerType()), T.StructField("insertions", T.IntegerType()),
    T.StructField("ref_words", T.IntegerType()), T.StructField("hyp_words", T.IntegerType()),
    T.StructField("error", T.StringType()),
])

# Cost and hits share one integer key: cost * BIG - hits, minimised.
_BIG = 1 << 32
CELLS = 400_000  # cells of one row of the table, over all pairs aligned together


def _groups(pairs: list[tuple[list, list]]):
    """Positions of pairs to align together: of similar lengths, within ``CELLS`` cells."""
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    now: list[int] = []
    for i in order:
        if now and (len(now) + 1) * (len(pairs[i][1]) + 1) > CELLS:
            yield now
            now = []
        now.append(i)
    if now:
        yield now


def align_counts(pairs: list[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """(minimum edit cost, maximum hits among minimum-cost alignments) of (reference,
    hypothesis) word lists. A row of the table is computed for many pairs at once: shorter hypotheses are
    padded at their end, which leaves the cells before it as they are, and a pair
    leaves with the last word of its reference."""
    cost, hits = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for some in _groups(pairs):
        some.sort(key=lambda i: -len(pairs[i][0]))
        vocab: dict[str, int] = {}
        n = np.array([len(pairs[i][0]) for i in some])
        m = np.array([len(pairs[i][1]) for i in some])
        ref, hyp = np.full((len(some), n.max(initial=0)), -2), np.full((len(some), m.max(initial=0)), -1)
        for k, i in enumerate(some):
            for grid, words in ((ref, pairs[i][0]), (hyp, pairs[i][1])):
                grid[k, :len(words)] = [vocab.setdefault(w, len(vocab)) for w in words]
        steps = np.arange(hyp.shape[1] + 1, dtype=np.int64) * _BIG  # j insertions
        prev = np.tile(steps, (len(some), 1))
        key = np.zeros(len(some), np.int64)
        active = len(some)
        for i in range(n.max(initial=0) + 1):
            if i:
                row = prev[:active]
                cand = np.empty_like(row)
                cand[:, 0] = i * _BIG
                # hit (-1 in the key) or substitution, or deletion
                np.minimum(row[:, :-1] + np.where(hyp[:active] == ref[:active, i - 1:i], -1, _BIG), row[:, 1:] + _BIG, out=cand[:, 1:])
                cand -= steps  # insertions chain left to right: min over k <= j of cand[k] + (j - k) * BIG
                np.minimum.accumulate(cand, axis=1, out=cand)
                cand += steps
                prev = cand
            left = int(np.searchsorted(-n, -i))  # references with more than i words
            done = slice(left, active)
            key[done] = prev[done][np.arange(active - left), m[done]]
            active = left
            if not active:
                break
        c = np.where(key > 0, (key + _BIG - 1) // _BIG, 0)
        cost[some], hits[some] = c, c * _BIG - key
    return cost, hits


def _rows(reference, hypothesis) -> pd.DataFrame:
    texts = [(r, h) for r, h in zip(reference, hypothesis)]
    missing = np.array([r is None or h is None for r, h in texts], bool)
    pairs = [([], []) if gone else (r.split(), h.split()) for gone, (r, h) in zip(missing, texts)]
    n, p = np.array([len(r) for r, _ in pairs], np.int64), np.array([len(h) for _, h in pairs], np.int64)
    ok = ~missing & (n > 0)
    cost, hits = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    at = np.nonzero(ok)[0]
    cost[at], hits[at] = align_counts([pairs[i] for i in at])
    s = n + p - 2 * hits - cost
    d, ins = n - hits - s, p - hits - s
    with np.errstate(divide="ignore", invalid="ignore"):
        wip = np.where(p > 0, (hits / n) * (hits / p), 0.0)
        shares = {"wer": cost / n, "mer": np.where(hits + cost > 0, cost / (hits + cost), 0.0), "wil": 1 - wip, "wip": wip}
    out = pd.DataFrame({k: [round(x, 4) if o else None for x, o in zip(v.tolist(), ok)] for k, v in shares.items()}, dtype=float)
    for k, v in {"hits": hits, "substitutions": s, "deletions": d, "insertions": ins}.items():
        out[k] = pd.Series(v).where(ok).astype("Int32")
    out["ref_words"], out["hyp_words"] = (pd.Series(v).where(~missing).astype("Int32") for v in (n, p))
    out["error"] = np.where(missing, "missing text", np.where(ok, None, "empty reference"))
    return out


@F.pandas_udf(WER_SCHEMA)
def word_error(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """K1: Arrow-batched WER per pair."""
    return _rows(reference, hypothesis)


def with_wer(df: DataFrame, ref: str = "reference", hyp: str = "hypothesis", out: str = "w") -> DataFrame:
    return df.withColumn(out, word_error(F.col(ref), F.col(hyp)))


def wer_status(wer: Column) -> Column:
    """F19 band: < .15 good, < .30 acceptable, else retrain."""
    return F.when(wer < 0.15, "good").when(wer < 0.30, "acceptable").otherwise("retrain")


def corpus_report(pairs: DataFrame, ref: str = "reference", hyp: str = "hypothesis") -> DataFrame:
    """Mean WER over rows without an error, row counts, status."""
    w = with_wer(pairs, ref, hyp)
    ok = F.col("w.error").isNull()
    return (w.agg(F.round(F.avg(F.when(ok, F.col("w.wer"))), 4).alias("mean_wer"),
                  F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("n_ok"),
                  F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("n_failed"))
            .withColumn("status", wer_status(F.col("mean_wer"))))


def manifest_pairs(files: DataFrame, manifest_json: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Manifest ``{file: reference}`` (one JSON object per row) is
    exploded and inner-joined to the inventory on base name; hypotheses
    (name, hypothesis) are joined on the same name. Missing files drop out."""
    m = (manifest_json.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "reference")))
    names = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return m.join(names, "name").join(hypotheses, "name", "left")
