"""Mixing sources to target weights by pivotal dependent rounding.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share the words of all documents; no target exceeds ``cap`` times its source's
words, and the excess is shared again by weight until none does. A document of
a source is to be taken target / words times on average: the whole part of
that rate surely, the fraction by rounding.

Rounding: two fractional documents a, b are paired and words are moved between
them, so that size_a * p_a + size_b * p_b stays, until one becomes 0 or 1; the
direction is drawn so that each keeps its expected value. The other goes on to
the next pair. Documents are dealt to buckets by a hash of their id, each
(source, bucket) group is rounded as a stream in id order and leaves at most
one fractional document; these residuals meet, 64 buckets at a time, in the
next level of a reduction tree, and the last one of a source goes to the
nearer of 0 and 1. So a source's taken words miss its target by at most half
of one document. The draws hash ids and the tree depends on the row count alone, so
reruns agree whatever the partitions.

Defined results: a null or empty text has size 0 and takes part with 0 words;
the null source is a source; null ids are documents (ordered first); repeated
rows are documents each. Equal sizes and ids are ordered by size. An empty
table gives no rows. Further columns, of any name and type, go through ``apply_mix``. A hot source
is spread over all buckets, wholly equal rows are one row with a count; only narrow rows
are shuffled for the rounding.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import GAP, materialize, order_key, partitions, row_hash

WEIGHTS = (5, 2, 1)
GROUP_ROWS = 1024  # documents a bucket, all sources together
FAN_IN = 6  # 2**6 buckets meet in one of the next level
CHUNK = 100_000  # equal rows that a task writes out
SALTS = 16
ROWS = ("src string, bucket long, k long, id long, tag long, size long, source_size long, target double, "
        "whole int, m long, plus long, p double, copies int")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text."""
    t = F.coalesce(text, F.lit(""))
    # gaps between words, plus one if there is any word
    inner = F.regexp_replace(t, rf"^{GAP}|{GAP}$", "")
    return F.when(F.length(inner) == 0, F.lit(0)).otherwise(
        F.size(F.split(inner, GAP))).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: tuple = WEIGHTS) -> DataFrame:
    """``src, source_size, target`` from rows of ``src, size``, ``m`` times each."""
    spark = sizes.sparkSession
    n = partitions(spark)
    # A global rank: ranges in order, numbered inside each, plus the rows of the ranges before.
    ranked = materialize(
        sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")).withColumn("last", F.col("src").isNull())
        .repartitionByRange(n, "last", "src").sortWithinPartitions("last", "src")
        .withColumn("at", F.monotonically_increasing_id()), "sources")
    ranges = ranked.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).orderBy("range").collect()
    before, rows = 0, []  # one row a range
    for r in ranges:
        rows.append((r["range"], before))
        before += r["n"]
    place = spark.createDataFrame(rows, "range long, before long")
    weight = F.expr("CASE pmod(before + at - shiftleft(range, 33), {}) {} END".format(
        len(weights), " ".join(f"WHEN {i} THEN {float(w)}D" for i, w in enumerate(weights))))
    src = materialize(ranked.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(place), "range")
                      .select("src", "source_size", weight.alias("w")), "weights")
    s = src.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    total, level, capped = float(s["total"] or 0), float(s["total"] or 0) / (s["w"] or 1), -1
    while True:
        full = F.col("w") * level >= F.col("source_size") * cap
        s = src.agg(F.sum(F.when(full, F.col("source_size") * cap)).alias("held"), F.sum(F.when(~full, F.col("w"))).alias("w"),
                    F.sum(full.cast("long")).alias("n")).first()
        if not s["w"] or s["n"] == capped:
            break
        level, capped = (total - (s["held"] or 0.0)) / s["w"], s["n"]
    return src.select("src", "source_size", F.least(F.col("w") * level, F.col("source_size") * cap).alias("target"))


def _draw(seed: int, *ids) -> float:
    return xxhash.xxh3_64_intdigest(repr(ids).encode(), seed) / 2.0**64


def pivot(a: tuple, b: tuple, u: float) -> tuple[float, float]:
    """New probabilities of two documents (size, p), one of them 0 or 1."""
    (sa, pa_), (sb, pb) = a, b
    up, down = min(sa * (1 - pa_), sb * pb), min(sa * pa_, sb * (1 - pb))  # words that can move to a, to b
    if u * (up + down) < down:
        return _snap(pa_ + up / sa), _snap(pb - up / sb)
    return _snap(pa_ - down / sa), _snap(pb + down / sb)


def _snap(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _round(rows: DataFrame, seed: int, final: bool) -> DataFrame:
    """Round each (src, bucket) group; its one fractional row keeps null copies."""
    names = [f.split()[0] for f in ROWS.split(", ")]
    at = {n: i for i, n in enumerate(names)}
    SIZE, P, WHOLE, COPIES, ID, TAG = (at[n] for n in ("size", "p", "whole", "copies", "id", "tag"))
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[t])
                        for n, t in (f.split() for f in ROWS.split(", "))])

    def run(batches):
        key, held = None, None

        def settled(row, p):
            row[P], row[COPIES] = p, row[WHOLE] + int(p)
            return row

        def left(row):
            if final:
                return settled(row, float(row[P] >= 0.5))
            return row

        for b in batches:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in b.columns))):
                if (row[0], row[1]) != key:
                    if held is not None:
                        out.append(left(held))
                    key, held = (row[0], row[1]), None
                row[P] = _snap(row[P])
                if row[P] in (0.0, 1.0) or not row[SIZE]:
                    out.append(settled(row, row[P] if row[SIZE] else 0.0))
                elif held is None:
                    held = row
                else:
                    u = _draw(seed, held[ID], held[TAG], row[ID], row[TAG])
                    pair = held, row
                    held = None
                    for x, p in zip(pair, pivot((pair[0][SIZE], pair[0][P]), (pair[1][SIZE], pair[1][P]), u)):
                        x[P] = p
                        if p in (0.0, 1.0):
                            out.append(settled(x, p))
                        else:
                            held = x
            yield _batch(out)
        if held is not None:
            yield _batch([left(held)])

    def _batch(out):
        cols = zip(*out) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return (rows.select(*names).repartition(partitions(rows.sparkSession), "src", "bucket")
            .sortWithinPartitions("src", "bucket", "k", "size", "tag", "p").mapInArrow(run, ROWS))


def mix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               cap: float = 3.0, weights: tuple = WEIGHTS, seed: int = 7) -> DataFrame:
    """``k, id, tag, source, size, source_size, target, m, whole, plus`` of every group of ``m`` wholly
    equal rows (``tag`` is their hash): ``plus`` of them are taken ``whole`` + 1 times, the others
    ``whole`` times. Equal rows are alike, so their fractions are summed: whole ones are taken, and one
    row stands for the rest in the rounding."""
    narrow = docs.select(
        F.col(source_col).cast("string").alias("src"), F.col(id_col).cast("long").alias("id"), order_key(id_col).alias("k"),
        row_hash(docs).alias("tag"), word_count(F.col(text_col)).alias("size"))
    narrow = materialize(narrow.groupBy("src", "id", "k", "tag", "size").agg(F.count(F.lit(1)).alias("m")), "narrow")
    targets = source_targets(narrow, cap, weights)
    n = narrow.count()
    bits = max(0, math.ceil(math.log2(max(1, n / GROUP_ROWS))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = narrow.alias("d").join(targets.alias("t"), F.col("d.src").eqNullSafe(F.col("t.src"))).select(
        F.col("d.src").alias("src"), F.pmod(F.xxhash64("k", "tag", F.lit(seed)), F.lit(1 << bits)).alias("bucket"),
        "k", "id", "tag", "size", "m", "source_size", "target", F.floor(rate + 1e-9).cast("int").alias("whole"),
        F.when(F.col("size") > 0, F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-9))).otherwise(F.lit(0.0)).alias("f"))
    rows = rows.withColumn("plus", F.floor(F.col("m") * F.col("f") + 1e-9).cast("long"))
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("m") * F.col("f") - F.col("plus"))).withColumn("copies", F.lit(None).cast("int")).drop("f")
    done = None
    while True:
        level = materialize(_round(rows, seed, bits == 0), "level")
        part = level.filter(F.col("copies").isNotNull())
        done = part if done is None else done.unionByName(part)
        if bits == 0:
            break
        rows = level.filter(F.col("copies").isNull()).withColumn("bucket", F.shiftright("bucket", FAN_IN))
        bits = max(0, bits - FAN_IN)
        seed += 1
    return done.select("k", "id", "tag", F.col("src").alias("source"), "size", "source_size", "target", "m", "whole",
                       (F.col("plus") + F.col("copies") - F.col("whole")).alias("plus"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cap: float = 3.0, weights: tuple = WEIGHTS, seed: int = 7) -> DataFrame:
    """``id, tag, source, size, source_size, target, copies`` of every document."""
    groups = mix_groups(docs, id_col, text_col, source_col, cap, weights, seed)
    # rows of a large group are written out by several tasks
    part = groups.withColumn("c", F.explode(F.expr(f"sequence(0L, (m - 1) div {CHUNK})")))
    if groups.filter(F.col("m") > CHUNK).limit(1).count():
        part = part.repartition(partitions(docs.sparkSession), "k", "tag", "c")
    row = F.explode(F.expr(f"sequence(c * {CHUNK} + 1, least(m, (c + 1) * {CHUNK}))"))
    return part.withColumn("i", row).select("id", "tag", "source", "size", "source_size", "target",
                                            (F.col("whole") + (F.col("i") <= F.col("plus")).cast("int")).alias("copies"))


def apply_mix(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document as many times as ``mix_groups`` of the same frame takes it, with
    its columns. Only rows that are wholly equal to others are numbered: within their input partition, plus the rows of the
    partitions before, so that no task gets all of a large group."""
    cols = docs.columns
    row = docs.select(F.struct(*cols).alias("row"), order_key(id_col).alias("k"), row_hash(docs).alias("tag"), F.spark_partition_id().alias("part"))
    single = groups.filter("m = 1").select("k", "tag", (F.col("whole") + F.col("plus")).cast("int").alias("copies"))
    taken = row.join(single.filter("copies > 0"), ["k", "tag"]).select("row", "copies")
    if groups.filter("m > 1").limit(1).count():
        many = groups.filter("m > 1").select("k", "tag", "whole", "plus", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = row.withColumn("salt", F.col("part") % SALTS)
        # stored, so that the numbers of the two reads agree
        again = materialize(salted.join(many, ["k", "tag", "salt"]).drop("salt"), "repeated")
        before = Window.partitionBy("k", "tag").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        start = again.groupBy("k", "tag", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        within = F.row_number().over(Window.partitionBy("k", "tag", "part").orderBy(F.lit(0)))
        numbered = again.withColumn("i", within).join(start.select("k", "tag", "part", "start"), ["k", "tag", "part"])
        copies = (F.col("whole") + (F.col("start") + F.col("i") <= F.col("plus")).cast("int")).alias("copies")
        taken = taken.unionByName(numbered.select("row", copies).filter("copies > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
