"""D12 token-score highlights and F20 tokenizer comparison.

Highlights work in-row on a document's token and score arrays (no shuffle:
a document's tokens never leave its row).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.functions import text as X

# Special tokens dropped and sub-word marks stripped.
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "[PAD]", "<s>", "</s>", "<pad>")
SUBWORD_MARKS = ("##", "▁")


HIGHLIGHT = "array<struct<pos: int, token: string, score: double>>"


def _round4(x: np.ndarray) -> np.ndarray:
    """Spark's round(x, 4): half up on the shortest decimal form of the double. Only
    values that may be ties are looked at one by one."""
    y = x * 1e4
    out = np.floor(y + 0.5) / 1e4
    for i in np.nonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)[0]:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Start in the flat values and length of each list (null: 0)."""
    start = lists.offsets.to_numpy()[:-1].astype(np.int64)
    return start, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def top_tokens(tokens: pa.ListArray, scores: pa.ListArray, top: int) -> pa.ListArray:
    """Highlights of a batch of documents, on the flattened lists: segments are reduced by their
    bounds and ranked by one sort of (document, rounded score, position)."""
    t0, tn = _flat(tokens)
    s0, sn = _flat(scores)
    n = np.minimum(tn, sn)
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    word = tokens.values.take(pa.array(t0[doc] + pos))
    score = scores.values.take(pa.array(s0[doc] + pos))
    clean = word
    for mark in SUBWORD_MARKS:
        clean = pc.replace_substring(clean, mark, "")
    keep = pc.and_(pc.and_(pc.is_valid(word), pc.is_valid(score)),
                   pc.and_(pc.invert(pc.is_in(word, pa.array(SPECIAL_TOKENS, word.type))), pc.not_equal(clean, "")))
    at = np.nonzero(pc.fill_null(keep, False).to_numpy(zero_copy_only=False))[0]
    doc, pos, value = doc[at], pos[at], score.to_numpy(zero_copy_only=False)[at].astype(np.float64)
    count = np.bincount(doc, minlength=len(n))
    begin = np.cumsum(count) - count
    some = begin[count > 0]
    low, high = np.zeros(len(n)), np.zeros(len(n))
    if len(some):
        low[count > 0], high[count > 0] = np.minimum.reduceat(value, some), np.maximum.reduceat(value, some)
    width = np.where(high != low, high - low, 1.0)
    scaled = _round4((value - low[doc]) / width[doc])
    order = np.argsort(doc * 20_002 + np.rint(10_000 - scaled * 1e4).astype(np.int64), kind="stable")  # ties stay by position
    rank = np.arange(len(order)) - begin[doc[order]]
    order = order[rank < top]
    items = pa.StructArray.from_arrays([pa.array(pos[order].astype(np.int32)), clean.take(pa.array(at[order])).cast(pa.string()), pa.array(scaled[order])],
                                       ["pos", "token", "score"])
    null = pc.or_(pc.is_null(tokens), pc.is_null(scores))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.minimum(count, top))].astype(np.int32)), items, mask=null)


def highlights(df: DataFrame, tokens: str, scores: str, top: int = 15, out: str = "highlights") -> DataFrame:
    """D12 per document row, by Arrow kernels over the row's token and score arrays: no
    shuffle, a document never leaves its task, and no token becomes a Python object. Drop
    special tokens, strip sub-word marks (drop emptied tokens), min-max scale per document
    (range 0 -> divide by 1), round to 4, sort by score descending (stable by position), keep the first
    ``top``. Lists of unequal length are read to the end of the shorter; a null list
    gives null, null tokens and scores are dropped."""
    @F.arrow_udf(HIGHLIGHT)
    def run(t: pa.Array, s: pa.Array) -> pa.Array:
        return top_tokens(t, s, top)
    return df.withColumn(out, run(F.col(tokens), F.col(scores)))


PIECE_RE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}" + X.WS[1:]


def tokenizer_compare(df: DataFrame, text_col: str = "text", by: str = "lang") -> DataFrame:
    """per category, mean whitespace-word count vs mean word-piece count
    (letter/digit runs and single punctuation marks), delta and reduction %."""
    d = df.select(by, X.token_count(text_col).alias("a"),
                  F.size(F.regexp_extract_all(F.col(text_col), F.lit(PIECE_RE), 0)).alias("b"))
    g = d.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("a").alias("avg_words"),
                          F.avg("b").alias("avg_pieces"))
    return g.select(by, "n_docs", F.round("avg_words", 4).alias("avg_words"),
                    F.round("avg_pieces", 4).alias("avg_pieces"),
                    F.round(F.col("avg_pieces") - F.col("avg_words"), 2).alias("delta"),
                    F.round(F.when(F.col("avg_pieces") > 0, (F.col("avg_pieces") - F.col("avg_words")) * 100.0
                                   / F.col("avg_pieces")).otherwise(0.0), 2).alias("reduction_pct"))
