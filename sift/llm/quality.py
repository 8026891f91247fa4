"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata (the text's size).

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum
is taken in linear time, as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 over
the ``RANK`` factors. Features: words hashed into ``WORD_SLOTS`` (log counts
of length one a text) and ``len(STATS)`` statistics, each one-hot in bins that
are cut at quantiles of the training sample.

Training: about ``SAMPLE`` labelled rows (a documented bound) whose
crc32(id as text) mod 4 is not 2, by Adam on the driver with a fixed seed;
labels, lang, source and id are never inputs. Scoring is one narrow pass over
whole texts, without a shuffle, by matrix products over small groups of texts.

Defined results: null and empty texts are scored as empty ones; without
labelled rows of both labels every score is the share of label 1 (0.5 without
any). Columns named as an output are replaced, others pass through; repeated
rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sift.llm.common import labelled_sample, without, word_hash

SAMPLE = 4000
RANK = 8
WORD_SLOTS = 2048
BINS = 10
STATS = ("size", "words", "word_length", "upper", "digits", "marks", "exclaim", "bars", "wide", "distinct",
         "lines", "same_lines", "same_words")
ACCEPT = 0.7
GROUP = 256  # texts in one matrix

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'\"-!|"]] = True


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, hashed word vector of length one)."""
    data = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.lower().split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    size, n = max(1, len(data)), max(1, len(words))
    distinct = set(words)
    stats = np.array([np.log1p(len(data)), np.log1p(len(words)), len(data) / n, count[_UPPER].sum() / size, count[_DIGIT].sum() / size,
                      count[_MARK].sum() / size, count[33] / n, count[124] / n, count[128:].sum() / size, len(distinct) / n,
                      len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
                      sum(a == b for a, b in zip(words, words[1:])) / n])
    v = np.zeros(WORD_SLOTS)
    if words:
        h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
        v = np.log1p(np.bincount((h & np.uint64(WORD_SLOTS - 1)).astype(np.int64), minlength=WORD_SLOTS))
        v /= np.sqrt((v * v).sum())
    return stats, v


@dataclass
class Machine:
    cuts: np.ndarray  # (statistics, BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray

    def design(self, stats: np.ndarray, words: np.ndarray) -> np.ndarray:
        return design(self.cuts, stats, words)

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((s * s).sum(1) - (x * x) @ (self.v * self.v).sum(1))


def design(cuts: np.ndarray, stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    n, k = stats.shape
    hot = np.zeros((n, k, BINS))
    at = (stats[:, :, None] > cuts[None]).sum(2)
    np.put_along_axis(hot, at[:, :, None], 1.0, 2)
    return np.concatenate([hot.reshape(n, k * BINS), words], 1)


def fit(stats: np.ndarray, words: np.ndarray, label: np.ndarray, epochs: int = 12, seed: int = 5) -> Machine:
    n, k = stats.shape[0], len(STATS)
    size = k * BINS + WORD_SLOTS
    share = float(label.mean()) if n else 0.5
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if n == 0 or share in (0.0, 1.0):
        return Machine(np.zeros((k, BINS - 1)), prior, np.zeros(size), np.zeros((size, RANK)))
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rng = np.random.default_rng(seed)
    m = Machine(cuts, prior, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    params = [np.array([m.w0]), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            at = order[lo:lo + 64]
            x = design(cuts, stats[at], words[at])
            m.w0 = float(params[0][0])
            z = np.clip(m.logits(x), -30, 30)
            d = (1 / (1 + np.exp(-z)) - label[at]) / len(at)
            s = x @ m.v
            grads = [np.array([d.sum()]), x.T @ d + 1e-4 * m.w,
                     x.T @ (d[:, None] * s) - (x * x).T @ d[:, None] * m.v + 1e-3 * m.v]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.w0 = float(params[0][0])
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never trained on: crc32(id as text) mod 4 is 2 (a null id's text is empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _rows(batches):
    for b in batches:
        out = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([s.tobytes() for s, _ in out], pa.binary()),
             pa.array([zlib.compress(v.astype(np.float32).tobytes(), 1) for _, v in out], pa.binary()), b.column(2)],
            ["id", "stats", "words", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    rows = labelled_sample(docs, labels, "quality", sample, keep=~held_out("id")).select("id", "text", "label").mapInArrow(
        _rows, "id long, stats binary, words binary, label int").collect()  # about ``sample`` rows
    rows.sort(key=lambda r: (r["id"], r["stats"]))
    stats = np.array([np.frombuffer(r["stats"]) for r in rows]).reshape(-1, len(STATS))
    words = np.array([np.frombuffer(zlib.decompress(r["words"]), np.float32) for r in rows]).reshape(-1, WORD_SLOTS)
    return fit(stats, words.astype(np.float64), np.array([float(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``held_out``, ``score`` and ``predicted``."""
    df = without(docs, "held_out", "score", "predicted").withColumn("held_out", held_out(id_col))
    schema = StructType([*df.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            for lo in range(0, b.num_rows, GROUP):
                part = b.slice(lo, GROUP)
                got = [features(t or "") for t in part.column(at).to_pylist()]
                x = model.design(np.array([s for s, _ in got]), np.array([v for _, v in got]))
                p = 1 / (1 + np.exp(-np.clip(model.logits(x), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= ACCEPT).astype(np.int32))],
                                                 [*part.schema.names, "score", "predicted"])

    return df.mapInArrow(run, schema)
