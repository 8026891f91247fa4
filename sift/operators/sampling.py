"""Seeded, exact, partition-independent sampling and splits: G7-G12.

Order inside a group is a seeded sha256 of the row key (``seeded_hash``),
never ``rand()``, so results do not depend on partitioning and another
engine can reproduce them.

Exact "first k of each class" for large k (stratified / positional splits)
does not rank a whole class in one window task. ``rank_cutoffs`` finds, per
class, the (hash, key) of the k-th row with a bucket histogram: counts per
(class, hash prefix) are partially aggregated, a cumulative sum over that
small table locates the bucket holding the k-th row, and only the rows of
that one bucket (about n_c / 65536 of the class) are ranked. The cut-offs
(one row per class) are joined back, salted. For k up to ``WINDOW_K`` a plain ``row_number() <= k``
is used: Spark plans it with a partial WindowGroupLimit, so each task ships
at most k rows per class. Beyond, Spark has no such limit and the cut-offs
pick the same rows.

Keys are unique. Null classes form a class of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.operators.partitioning import SALTS
from sift.session import stored

# Hash prefix used for the histogram: 4 hex digits = 65,536 buckets per class.
BUCKET_HEX_DIGITS = 4
# Largest k that Spark plans with a WindowGroupLimit by default.
WINDOW_K = 1000


def seeded_hash(key, seed: int = 42) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(k.cast("string"), F.lit(f":{seed}")), 256)


def _bucket(h: Column) -> Column:
    return F.conv(F.substring(h, 1, BUCKET_HEX_DIGITS), 16, 10).cast("long")


def _join_class(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` in which nulls match; ``right``'s copies of ``on`` go."""
    names = {c: f"__right_{c}" for c in on}
    right = right.withColumnsRenamed(names)
    cond = [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()]
    return left.join(right, cond, how).drop(*names.values())


def rank_cutoffs(df: DataFrame, group: str, h: str, key: str, k_of_n) -> DataFrame:
    """Per group: ``(group, n, k, cut_h, cut_key)`` where the rows with
    ``(h, key) <= (cut_h, cut_key)`` are exactly the first ``k`` rows of the
    group in ``(h, key)`` order. ``k_of_n`` maps the group size column to k."""
    hist = (df.select(group, _bucket(F.col(h)).alias("b"))
            .groupBy(group, "b").agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy(group).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (hist.withColumn("cum", F.sum("cnt").over(w))
           .withColumn("n", F.sum("cnt").over(Window.partitionBy(group))))
    cum = cum.withColumn("k", k_of_n(F.col("n")).cast("long"))
    edge = (cum.filter((F.col("k") > 0) & (F.col("cum") >= F.col("k")) & (F.col("cum") - F.col("cnt") < F.col("k")))
            .select(group, "b", "n", "k", (F.col("k") - (F.col("cum") - F.col("cnt"))).alias("r")))
    sizes = cum.select(group, "n", "k").distinct()
    in_edge = _join_class(df.select(group, h, key, _bucket(F.col(h)).alias("b")),
                          edge.select(group, "b", "r"), [group, "b"])
    rw = Window.partitionBy(group).orderBy(h, key)
    cut = (in_edge.withColumn("rn", F.row_number().over(rw))
           .filter(F.col("rn") == F.col("r"))
           .select(group, F.col(h).alias("cut_h"), F.col(key).alias("cut_key")))
    return _join_class(sizes, cut, [group], "left")


def _before_cut(h: str, key: str) -> Column:
    return F.col("cut_h").isNotNull() & (
        (F.col(h) < F.col("cut_h")) | ((F.col(h) == F.col("cut_h")) & (F.col(key) <= F.col("cut_key"))))


def _hashed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with its seeded hash ``__h``, written once to the shared checkpoint folder: the
    histogram, the edge buckets and the assignment read it instead of computing ``df`` again.
    Callers pass the columns they need back, not texts."""
    return stored(df.withColumn("__h", seeded_hash(key, seed)), "sift-split")


def _attach(df: DataFrame, cuts: DataFrame, group: str, key: str) -> DataFrame:
    """Each row with its class's cut-offs. One row per class, repeated per salt, as a class may
    hold most rows; adaptive execution broadcasts the table where it is small."""
    copies = cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return _join_class(salted, copies, [group, "__salt"], "left").drop("__salt")


def stratified_split(df: DataFrame, label: str = "label", key: str = "text_id",
                     test_fraction: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Per class exactly round(test_fraction * n_c) rows go to ``test``
    (first in seeded-hash order), the rest to ``train``."""
    hdf = _hashed(df, key, seed)
    cuts = rank_cutoffs(hdf, label, "__h", key, lambda n: F.round(n * F.lit(test_fraction)))
    j = _attach(hdf, cuts, label, key)
    return (j.withColumn(out, F.when(_before_cut("__h", key), "test").otherwise("train"))
            .drop("__h", "n", "k", "cut_h", "cut_key"))


def positional_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Shuffle by seeded hash, first int(train_fraction * n) rows train."""
    hdf = _hashed(df.withColumn("__g", F.lit(1)), key, seed)
    cuts = rank_cutoffs(hdf, "__g", "__h", key, lambda n: F.floor(n * F.lit(train_fraction)))
    j = _attach(hdf, cuts, "__g", key)
    return (j.withColumn(out, F.when(_before_cut("__h", key), "train").otherwise("test"))
            .drop("__h", "__g", "n", "k", "cut_h", "cut_key"))


def first_k_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 42,
                      rank_col: str | None = None) -> DataFrame:
    """Up to ``k`` rows per group in seeded-hash order (``min(k, n_c)``)."""
    if k > WINDOW_K:
        hdf = _hashed(df, key, seed)
        cuts = rank_cutoffs(hdf, group, "__h", key, lambda n: F.least(n, F.lit(k)))
        df = _attach(hdf, cuts, group, key).filter(_before_cut("__h", key)).drop("__h", "n", "k", "cut_h", "cut_key")
        if not rank_col:
            return df
    w = Window.partitionBy(group).orderBy(seeded_hash(key, seed), F.col(key))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def oversample(df: DataFrame, group: str, key: str, n: int, seed: int = 42,
               source_col: str = "source", tag: str = "oversampled") -> DataFrame:
    """G9 (re-aimed): for classes with fewer than ``n`` rows, extra copies of
    their rows (with replacement, round-robin in seeded order) up to ``n``.
    Only rows of short classes (fewer than n each) are ranked."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    short = sizes.filter(F.col("__n") < n)
    rows = _join_class(df, short, [group])
    w = Window.partitionBy(group).orderBy(seeded_hash(key, seed), F.col(key))
    ranked = rows.withColumn("__r", F.row_number().over(w))
    deficit = F.lit(n) - F.col("__n")
    copies = F.floor(deficit / F.col("__n")) + F.when(F.col("__r") <= deficit % F.col("__n"), 1).otherwise(0)
    out = (ranked.withColumn("__copies", copies.cast("int"))
           .filter(F.col("__copies") > 0)
           .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
           .withColumn(source_col, F.lit(tag))
           .drop("__n", "__r", "__copies"))
    return out


def balanced_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42,
                    source_col: str = "source", sampled_tag: str = "original",
                    top_up: bool = True) -> DataFrame:
    """Exactly ``n`` rows per class without replacement where the class
    has them; all rows of a smaller class, topped up by G9 when ``top_up``."""
    picked = first_k_per_group(df, group, key, n, seed).withColumn(source_col, F.lit(sampled_tag))
    picked = picked.withColumn("copy", F.lit(0))
    if not top_up:
        return picked
    return picked.unionByName(oversample(df, group, key, n, seed, source_col))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A total order by seeded hash (range-partitioned sort)."""
    return df.orderBy(seeded_hash(key, seed), F.col(key))
