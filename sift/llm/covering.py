"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if more than half of the text's 3-word shingles
(repeats included) have it in their XXH64. Fingerprints link at ``RADIUS`` or
fewer differing bits; a document's component is what it reaches by links.

Tables: bit i of a fingerprint gets a non-zero vector of RADIUS + 1 bits, and
for each of the 15 non-zero vectors v a table keeps the bits whose vector has an odd
product with v. The vectors of at most RADIUS differing bits span less
than the whole space, so some v is orthogonal to all of them: that table
keeps none of the differing bits, and the pair shares its bucket. No pair is
lost, whatever the data.

Equal fingerprints are one node. A bucket of up to ``BUCKET`` nodes is compared in one
task, which gives a spanning forest of its links, not all pairs. Larger
buckets are split: their nodes agree in the kept bits, so the same
construction over the free bits gives 15 smaller buckets of which again one holds
any pair. Each split halves the free bits (32, 16, 8 at most), so after two a
bucket has at most 2**8 different nodes. Which buckets are split is told by
hashes of their names, of which there are at most ``SPLIT_SLOTS``: a bucket
split for no need costs room, never a link.

Defined results: null and empty texts, and texts without words, have
fingerprint zero and are linked like others; with fewer than three words the
whole sequence is the one shingle. Null ids are rows like others; a component's id is the smallest
id that is not null (null if there is none). Rows of one id are rows each.
Whole texts are used, extra columns ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sift.llm.common import materialize, partitions
from sift.llm.links import attach, components

WIDTH = 3
RADIUS = 3
BUCKET = 1024
SPLIT_SLOTS = 1 << 20  # bounds the broadcast that names large buckets
STEP_WORDS = 100_000
U = np.uint64


def words(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split touch A-Z and the bytes 20, 09-0D only."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def simhash(text: str | None) -> int:
    """64-bit fingerprint; bit sums of long texts are taken in steps."""
    w = words(text)
    if not w:
        return 0
    joined, ends = b" ".join(w), list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    m, last, digest = max(1, len(w) - WIDTH + 1), min(len(w), WIDTH) - 1, xxhash.xxh64_digest
    sums = np.zeros(64, np.int64)
    for lo in range(0, m, STEP_WORDS):
        hi = min(m, lo + STEP_WORDS)
        h = b"".join([digest(joined[s:e - 1], 42) for s, e in zip(starts[lo:hi], ends[lo + last:hi + last])])  # big-endian
        sums += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > m).tobytes(), "big")


def covering(bits: list[int]) -> list[int]:
    """Masks over the given bit positions, one of which keeps none of any RADIUS of them."""
    vectors = 2 ** (RADIUS + 1) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((1 + i % vectors) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def split(kept: int) -> list[int]:
    """Masks of the tables into which a bucket with these kept bits is split."""
    return [kept | m for m in covering([b for b in range(64) if not kept >> b & 1])]


def _tables(masks: list[list[int]]):
    """(path, node) rows -> a (path, bucket, node) row for each mask of the path."""
    table = np.array(masks, U)

    def run(batches):
        for b in batches:
            path = b.column(0).to_numpy(zero_copy_only=False)
            node = b.column(1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(node), 50_000):
                p, x = path[lo:lo + 50_000], node[lo:lo + 50_000]
                n = table.shape[1]
                below = (p[:, None] * n + np.arange(n)).reshape(-1)
                bucket = (x.view(U)[:, None] & table[p]).reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(below.astype(np.int32)), pa.array(bucket), pa.array(np.repeat(x, n))],
                                                 ["path", "bucket", "node"])
    return run


def forest(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Positions (a, b) of links that join whatever is joined by links within ``x``."""
    a, b = [], []
    left = np.arange(len(x))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(x[left] ^ x[at]) <= RADIUS
            if near.any():
                found = left[near].tolist()
                a += [at] * len(found)
                b += found
                todo += found
                left = left[~near]
    return a, b


def _compare(batches):
    """Rows sorted by path and bucket -> links; a bucket has BUCKET nodes at most, or
    as many as its free bits give."""
    rest = None

    def links(path, bucket, node):
        new = np.r_[True, (path[1:] != path[:-1]) | (bucket[1:] != bucket[:-1])]
        start = np.nonzero(new)[0]
        size = np.diff(np.r_[start, len(node)])
        two = start[size == 2]
        two = two[np.bitwise_count(node[two].view(U) ^ node[two + 1].view(U)) <= RADIUS]
        a, b = [node[two]], [node[two + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            some = node[s:s + n]
            i, j = forest(some.view(U))
            a.append(some[i] if i else some[:0])
            b.append(some[j] if j else some[:0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate(c) for c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        last = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))[0]
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield links(*[c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield links(*rest)


def links(nodes: DataFrame) -> DataFrame:
    """``a, b``: verified links that join every component of the distinct
    fingerprints ``node``."""
    p = partitions(nodes.sparkSession)
    masks, found, rows = [split(0)], None, nodes.select(F.lit(0).alias("path"), "node")
    while True:
        free = 64 - min(m.bit_count() for some in masks for m in some)
        rows = rows.mapInArrow(_tables(masks), "path int, bucket long, node long")
        large = None
        if 1 << free > BUCKET:
            rows = materialize(rows, "covering-rows").withColumn("slot", F.pmod(F.xxhash64("path", "bucket"), F.lit(SPLIT_SLOTS)))
            slots = materialize(rows.groupBy("path", "bucket", "slot").count().filter(F.col("count") > BUCKET).select("slot").distinct(), "covering-large")
            if slots.limit(1).count():
                large = rows.join(F.broadcast(slots), "slot", "left_semi").select("path", "node")
                rows = rows.join(F.broadcast(slots), "slot", "left_anti")
        got = materialize(rows.select("path", "bucket", "node").repartition(p, "path", "bucket").sortWithinPartitions("path", "bucket", "node")
                          .mapInArrow(_compare, "a long, b long").distinct(), "covering-links")
        found = got if found is None else found.union(got)
        if large is None:
            return found
        masks, rows = [split(m) for some in masks for m in some], large


def _fingerprints(batches):
    for b in batches:
        texts = b.column(1)
        for lo in range(0, len(texts), 256):
            got = [simhash(t.as_py()) for t in texts.slice(lo, 256)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(np.array(got, U).view(np.int64))], ["id", "node"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, node``: each row's id as a long and its fingerprint as a signed 64-bit number."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints, "id long, node long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, links). Membership has one row a document: ``id, fingerprint``
    (16 hex digits) and ``component_id`` (the smallest id reachable by links, itself included).
    Links are pairs ``a, b`` of different fingerprints that span every component."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    nodes = materialize(rows.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows")), "simhash-nodes")
    found = links(nodes)
    named = nodes.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = materialize(named.join(least, "label").select("node", "component_id", "rows"), "simhash-components")
    out = attach(rows, of_node, "node", ["component_id"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"), found
