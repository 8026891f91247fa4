"""Toxicity: cumulative-link ordinal regression of severity grades.

One weight vector over sparse word features is shared by all thresholds:
P(grade > g) = sigmoid(w . x - theta_g), theta ascending. The output is the
expected severity, the sum of these probabilities; features are the words of
the text and their first 4 and 5 letters, valued log2(1 + count).

Training: at most about ``SAMPLE`` labelled rows (a documented bound), of near
copies one (by the smallest hash of their 5-word runs). Labels say toxic or
not; grades split the toxic rows: grade 0 is label 0, grade 2 a toxic row with
``SEVERE`` or more occurrences of indicative words (those far more frequent
in toxic rows), grade 1 any other toxic row. Features are words whose share of
toxic rows is off by ``SCREEN`` standard errors (at most ``MAX_FEATURES``), under
an L1 penalty. The model is fitted by accelerated proximal gradient steps on
the driver; scoring is one narrow pass over whole texts, without a shuffle.

Defined results: null and empty texts have no features and get the base rate
(no rejection); without labelled rows of both labels nothing is rejected.
Columns named as an output are replaced, others pass through; repeated rows
each give a row; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from sift.llm.common import labelled_sample, without

SAMPLE = 4000
MAX_FEATURES = 1000
SCREEN = 5.0  # standard errors
SEVERE = 4
LEVELS = 2  # thresholds: grades 0, 1, 2
REJECT = 0.1  # of P(grade > 0): clean labelled rows stay below 0.01
STEMS = (4, 5)
letters = re.compile(r"[^\W\d_]+").findall


def word_features(w: str) -> list[str]:
    """The word, and its beginnings (``abcd*``), which inflected forms share."""
    return [w, *(w[:n] + "*" for n in STEMS if len(w) >= n)]


class _Known(dict):
    """A word's features that a model weighs; forgets all beyond a bound."""

    def __init__(self, weights: dict):
        super().__init__()
        self.weights = weights

    def __missing__(self, w):
        if len(self) > 300_000:
            self.clear()
        f = self[w] = tuple(x for x in word_features(w) if x in self.weights)
        return f


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: list[float]

    def __post_init__(self):
        self.known = _Known(self.weights)

    def __reduce__(self):
        return Model, (self.weights, self.thresholds)

    def logit(self, text: str) -> float:
        known = self.known.__getitem__
        found = Counter(f for fs in filter(None, map(known, letters(text.lower()))) for f in fs)
        return sum(self.weights[f] * math.log2(1 + n) for f, n in sorted(found.items()))

    def above(self, text: str) -> list[float]:
        """P(grade > g) for each threshold."""
        z = self.logit(text)
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - z)))) for t in self.thresholds]


def _sketch(words: list[str]) -> int:
    if len(words) < 5:
        return xxhash.xxh3_64_intdigest(" ".join(words))
    return min(xxhash.xxh3_64_intdigest(" ".join(words[i:i + 5])) for i in range(len(words) - 4))


def _rows(batches):
    """(sketch, label, words, counts) of each text; words as one string, counts as 32-bit integers."""
    for b in batches:
        out = {"sketch": [], "label": b.column(2).to_pylist(), "words": [], "counts": []}
        for t in b.column(1).to_pylist():
            ws = letters(t.lower())
            c = Counter()
            for w, n in Counter(ws).items():
                for f in word_features(w):
                    c[f] += n
            out["sketch"].append(_sketch(ws) - 2**63)
            out["words"].append(" ".join(c))
            out["counts"].append(np.fromiter(c.values(), np.int32, len(c)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["sketch"], pa.int64()), pa.array(out["label"], pa.int32()),
                                          pa.array(out["words"], pa.string()), pa.array(out["counts"], pa.binary())],
                                         ["sketch", "label", "words", "counts"])


def indicative(rows: list, least: int) -> set[str]:
    """Words at least 20 times as frequent among toxic rows as among others."""
    seen = [Counter(), Counter()]
    n = [1, 1]
    for label, words, _ in rows:
        seen[label].update(words)
        n[label] += 1
    return {w for w, c in seen[1].items() if c >= least and c / n[1] >= 20 * (seen[0][w] + 0.5) / n[0]}


def telling(rows: list, least: int, z: float = SCREEN) -> list[str]:
    """Words in at least ``least`` rows whose share of toxic rows is off by ``z``
    standard errors, most telling first."""
    share = sum(r[0] for r in rows) / len(rows)
    seen, toxic = Counter(), Counter()
    for label, words, _ in rows:
        seen.update(words)
        if label:
            toxic.update(words)
    off = {w: abs(toxic[w] - n * share) / math.sqrt(n * share * (1 - share)) for w, n in seen.items() if n >= least}
    return sorted((w for w, x in off.items() if x >= z), key=lambda w: (-off[w], w))[:MAX_FEATURES]


def fit_rows(rows: list, l1: float = 1e-4, steps: int = 400) -> Model:
    """Fit from (label 0 or 1, words, counts) rows."""
    n = len(rows)
    if n == 0 or len({r[0] for r in rows}) < 2:
        return Model({}, [50.0] * LEVELS)
    least = max(4, n // 400)
    marks = indicative(rows, least)
    grade = np.array([0 if not label else 2 if sum(c for w, c in zip(words, counts) if w in marks) >= SEVERE else 1
                      for label, words, counts in rows])
    names = telling(rows, least)
    at = {w: i for i, w in enumerate(names)}
    x = np.zeros((n, len(names)))
    for i, (_, words, counts) in enumerate(rows):
        for w, k in zip(words, counts):
            if w in at:
                x[i, at[w]] = math.log2(1 + k)
    norm = np.sqrt(np.einsum("ij,ij->j", x, x) / n) + 1e-9  # features of one scale
    x /= norm
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    every = np.arange(n)

    def gradient(w, theta):
        p = sig((x @ w)[:, None] - theta)  # P(grade > g)
        lower, upper = np.maximum(grade - 1, 0), np.minimum(grade, LEVELS - 1)
        up, down = np.where(grade > 0, p[every, lower], 1.0), np.where(grade < LEVELS, p[every, upper], 0.0)
        own = np.maximum(up - down, 1e-9)  # probability of the row's own grade
        d_up = np.where(grade > 0, up * (1 - up), 0.0) / own
        d_down = np.where(grade < LEVELS, down * (1 - down), 0.0) / own
        return x.T @ (d_down - d_up) / n, np.array([(d_up[grade - 1 == g].sum() - d_down[grade == g].sum()) / n for g in range(LEVELS)])

    # the loss is convex in (w, theta); its curvature is at most that of two logistic terms
    u = np.ones(len(names) + 1)
    for _ in range(30):
        v = x @ u[:-1] + u[-1]
        u = np.append(x.T @ v, v.sum()) / n
        top = float(np.linalg.norm(u))
        u /= top
    rate = 1 / (0.5 * top + 1e-9)
    share = np.clip([(grade > g).mean() for g in range(LEVELS)], 1e-4, 1 - 1e-4)
    w, theta = np.zeros(len(names)), np.log((1 - share) / share)
    theta[1:] = np.maximum(theta[1:], theta[:-1] + 1e-2)
    ahead_w, ahead_t, k = w, theta, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        g_w, g_t = gradient(ahead_w, ahead_t)
        new_w = ahead_w - rate * g_w
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
        new_t = ahead_t - rate * g_t
        new_t[1:] = np.maximum(new_t[1:], new_t[:-1] + 1e-2)
        k, last = (1 + math.sqrt(1 + 4 * k * k)) / 2, k
        ahead_w, ahead_t = new_w + (last - 1) / k * (new_w - w), np.sort(new_t + (last - 1) / k * (new_t - theta))
        w, theta = new_w, new_t
    return Model({names[i]: float(w[i] / norm[i]) for i in np.nonzero(w)[0]}, [float(t) for t in theta])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, "toxic", sample).select("id", "text", "label").mapInArrow(
        _rows, "sketch long, label int, words string, counts binary").collect()  # about ``sample`` rows
    one, shared = {}, {}
    for s, label, words, counts in sorted(rows, key=lambda x: (x[0], x[1], len(x[3]))):
        if s not in one:  # a word of many rows is held once
            one[s] = int(label > 0), [shared.setdefault(w, w) for w in words.split()], np.frombuffer(counts, np.int32)
    del rows
    return fit_rows(list(one.values()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``p_toxic`` (P(grade > 0)), ``p_severe``, ``severity`` (expected grade) and ``grade``."""
    names = ("p_toxic", "p_severe", "severity", "grade")
    df = without(docs, *names)
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in names[:3]], StructField("grade", IntegerType())])

    def run(batches):
        for b in batches:
            ps = [model.above(t or "") for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array([p[g] for p in ps], pa.float64()) for g in range(LEVELS)],
                 pa.array([sum(p) for p in ps], pa.float64()), pa.array([sum(x >= 0.5 for x in p) for p in ps], pa.int32())],
                [*b.schema.names, *names])

    return df.mapInArrow(run, schema)
