"""Exact top-k search by distributed histogram selection.

Candidates and queries are packed into matrices of bounded size. A grid deals them
out: a cell meets a share of the queries with a share of the candidates, one task a
cell. It holds its share of the queries and the ``k`` best scores of each, and
streams the candidates, one matrix product a tile (the queries are a stated set
against all rows). No pass keeps or ships scores otherwise:

1. Each pass splits every query's current score interval into ``BINS`` bins
   and counts the scores in each; a cell reports a query's bins from the top
   until it has counted as many scores as are still wanted (lower bins cannot
   hold the k-th value). The sums over cells tell the bin of the k-th value,
   which is the interval of the next pass, until a bin is one integer wide.
2. A last pass keeps scores above the k-th value and, of those equal to it,
   each cell's ``k`` smallest ids; the final rank orders by score, then id.

Numbers are shuffled in the narrowest integers that hold them. A share of the candidates is
about ``C_SHARE`` bytes, one of the queries ``Q_SHARE`` at most, so that what is
shuffled grows with the rows, and a task's memory does not.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; empty vectors score 0; a vector shorter than
another counts as padded with zeros. Rows repeated among the candidates are
candidates each; a repeated query id is one query, with its smallest vector,
and no row of that id is its own candidate. With no queries or candidates the
result is empty. Inner products must fit in 63 bits, else an error is raised.
A vector that a third of all rows share only makes ties, which each cell cuts
to ``k`` before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import materialize, small_batches

BINS = 1 << 20
C_BLOCK, Q_BLOCK = 8192, 1024
BLOCK_BYTES = 1 << 20
C_SHARE, Q_SHARE = 64 << 20, 8 << 20
TILE = 512  # queries of a product: with a block of candidates, 16 MB of scores
GROUP = 64  # scores of which only the largest is looked at first


def quantised(col: str, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component, or null for a vector that takes no part."""
    x = F.col(col)
    ok = ~F.exists(x, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(True)))
    return F.when(ok, F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("long")))


def _matrix(vecs: pa.ListArray, dim: int, kind) -> np.ndarray:
    """Rows padded with zeros to ``dim``."""
    ends = np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset:vecs.offset + len(vecs) + 1].astype(np.int64)
    flat = vecs.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    size = np.diff(ends)
    m = np.zeros((len(vecs), dim), kind)
    row = np.repeat(np.arange(len(vecs)), size)
    m[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)] = flat
    return m


def _blocks(rows: DataFrame, dim: int, size: int, kind) -> DataFrame:
    """Pack (id, v) rows of each task into blocks of at most ``size`` rows, numbered one after another."""
    def pack(batches):
        ids, mats, held, at = [], [], 0, 7919 * TaskContext.get().partitionId()

        def emit():
            return pa.RecordBatch.from_pydict({"n": [at], "ids": [np.concatenate(ids).tobytes()], "mat": [np.concatenate(mats).tobytes()]})

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                part = b.slice(lo, size - held)
                ids.append(part.column(0).to_numpy().astype(np.int64))
                mats.append(_matrix(part.column(1), dim, kind))
                held, lo = held + part.num_rows, lo + part.num_rows
                if held == size:
                    yield emit()
                    ids, mats, held, at = [], [], 0, at + 1
        if held:
            yield emit()

    return rows.select("id", "v").mapInArrow(pack, "n long, ids binary, mat binary")


class _Best:
    """The ``k`` best of each query's scores in [lo, hi) among the candidates seen: larger
    scores first, of equal ones the smaller ids. ``want`` 0 takes none."""

    def __init__(self, ids, mat, lo, hi, want, k: int, kind, most: int):
        self.ids, self.k, self.kind = ids, k, kind
        self.mat = mat
        self.least = -np.inf if kind != np.int64 else np.iinfo(np.int64).min
        lo = np.where(want > 0, lo, most + 1)  # above every score
        # numbers beyond every score may be rounded
        self.lo, self.hi = lo.astype(kind), hi.astype(kind) if (hi <= most).any() else None
        self.score = np.full((len(ids), k), self.least, kind)
        self.id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.order = np.argsort(ids, kind="stable")
        self.buffer = np.empty(0, kind)

    def see(self, c_ids, c_mat):
        c = c_mat.astype(self.kind)
        width = max(1, -(-len(c) // GROUP)) * GROUP
        at = np.searchsorted(self.ids, c_ids, sorter=self.order)
        at = self.order[np.minimum(at, len(self.ids) - 1)]
        own = np.flatnonzero(self.ids[at] == c_ids)  # no row is its own candidate
        for first in range(0, len(self.ids), TILE):
            q = self.mat[first:first + TILE]
            if len(self.buffer) < len(q) * width:
                self.buffer = np.empty(len(q) * width, self.kind)
            s = self.buffer[:len(q) * width].reshape(len(q), width)
            s[:, len(c):] = self.least
            np.matmul(q, c.T, out=s[:, :len(c)])
            mine = own[(at[own] >= first) & (at[own] < first + len(q))]
            s[at[mine] - first, mine] = self.least
            if self.hi is not None:
                s[s >= self.hi[first:first + len(q), None]] = self.least
            self._take(first, s, c_ids)

    def _take(self, first: int, s: np.ndarray, c_ids):
        n, width = s.shape
        groups = s.reshape(n, width // GROUP, GROUP)
        top = groups.max(2)
        floor = np.maximum(self.lo[first:first + n], self.score[first:first + n, -1])
        if top.shape[1] >= self.k:  # the k-th of the groups' largest: k scores are no smaller
            floor = np.maximum(floor, np.partition(top, -self.k, 1)[:, -self.k])
        row, group = np.nonzero((top >= floor[:, None]) & (top > self.least))
        if not len(row):
            return
        held = groups[row, group]
        hit, place = np.nonzero((held >= floor[row, None]) & (held > self.least))
        score, row, cid = held[hit, place], row[hit] + first, c_ids[group[hit] * GROUP + place]
        better = (score > self.score[row, -1]) | (cid < self.id[row, -1])
        score, row, cid = score[better], row[better], cid[better]
        rows = np.unique(row)
        score, cid = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.id[rows].ravel(), cid])
        row = np.concatenate([np.repeat(rows, self.k), row])
        order = np.lexsort((cid, -score if self.kind != np.int64 else ~score, row))
        row = row[order]
        begin = np.searchsorted(row, rows)
        pick = order[(begin[:, None] + np.arange(self.k)).ravel()]
        self.score[rows], self.id[rows] = score[pick].reshape(-1, self.k), cid[pick].reshape(-1, self.k)

    def found(self):
        """(row, score, id) of all that is held."""
        row, place = np.nonzero(self.score > self.least)
        return row, self.score[row, place].astype(np.int64), self.id[row, place]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "v") -> DataFrame:
    """``query_id, rank, <id_col>, score`` for each row that ``is_query`` holds for.

    ``vec_col`` holds integer components (see ``quantised``)."""
    spark = vectors.sparkSession
    rows = materialize(vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
                       .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<long>").alias("v"),
                               F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    rows = rows.filter(~F.exists("v", lambda x: x.isNull()))
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    s = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("big"), F.max(norm).alias("norm"),
                 F.sum(F.col("q").cast("long")).alias("nq"), F.count(F.lit(1)).alias("n")).first()
    dim, big = max(1, s["dim"] or 1), int(s["big"] or 0)
    if dim * big * big >= 2**62:
        raise ValueError("inner products of these vectors do not fit in 63 bits")
    # no sum of absolute products, whole or in part, is larger (the norm may be rounded)
    bound = min(dim * big * big, int((s["norm"] or 0) * (1 + 1e-6)) + 1)
    # floats compute exactly what stays below the integers that they all hold
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
    stored = next(t for t in (np.int8, np.int16, np.int32, np.int64) if big <= np.iinfo(t).max)
    row_bytes = dim * np.dtype(stored).itemsize + 8
    many = 4 * spark.sparkContext.defaultParallelism
    q_shares = max(1, -(-(s["nq"] or 0) * row_bytes // Q_SHARE))
    c_shares = max(1, -(-s["n"] * row_bytes // C_SHARE), -(-many // q_shares))
    fit = max(1, BLOCK_BYTES // row_bytes)
    c_block = min(C_BLOCK, fit, max(256, s["n"] // (8 * c_shares)))
    queries = rows.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    with small_batches(spark):
        qb = materialize(_blocks(queries, dim, min(Q_BLOCK, fit), stored).select(F.monotonically_increasing_id().alias("qb"), "n", "ids", "mat"), "queries")
        cb = materialize(_blocks(rows, dim, c_block, stored), "candidates")
    cells = q_shares * c_shares
    share = lambda n: F.pmod(F.col("n"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs_c = cb.select(share(c_shares).alias("c"), "ids", "mat", every(q_shares).alias("q")).select(
        (F.col("q") * c_shares + F.col("c")).alias("cell"), F.lit(True).alias("is_c"), "ids", "mat",
        *[F.lit(None).cast("array<long>").alias(x) for x in ("lo", "width", "want")])

    def packed(state: DataFrame) -> DataFrame:
        """The state of each query block's queries, packed in the block's order."""
        def unpack(batches):
            for b in batches:
                for name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    q = np.frombuffer(ids, np.int64)
                    yield pa.RecordBatch.from_pydict({"qb": np.full(len(q), name), "query_id": q, "pos": np.arange(len(q))})
        place = qb.select("qb", "ids").mapInArrow(unpack, "qb long, query_id long, pos long")
        # at most Q_BLOCK rows in a group
        return place.join(state, "query_id", "left").groupBy("qb").agg(F.array_sort(F.collect_list(F.struct(
            "pos", F.coalesce("lo", F.lit(0)).alias("lo"), F.coalesce("width", F.lit(0)).alias("width"),
            F.coalesce("want", F.lit(0)).alias("want")))).alias("state")).select(
            "qb", *[F.col(f"state.{f}").alias(f) for f in ("lo", "width", "want")])

    def met(state: DataFrame) -> DataFrame:
        """A cell's query blocks, with their queries' state, then its candidate blocks; one cell a task."""
        pairs_q = qb.join(packed(state), "qb").select(share(q_shares).alias("q"), "ids", "mat", "lo", "width", "want", every(c_shares).alias("c")).select(
            (F.col("q") * c_shares + F.col("c")).alias("cell"), F.lit(False).alias("is_c"), "ids", "mat", "lo", "width", "want")
        return pairs_q.unionByName(pairs_c).repartitionById(cells, "cell").sortWithinPartitions("is_c")

    def best(batches, last: bool):
        """The best scores of each query of a cell, and the queries' state."""
        ids, mats, state, held = [], [], [], None
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                get = lambda n: b.column(at[n])[i]  # noqa: E731, B023
                i_, m = np.frombuffer(get("ids").as_buffer(), np.int64).copy(), np.frombuffer(get("mat").as_buffer(), stored).reshape(-1, dim)
                if not get("is_c").as_py():
                    ids.append(i_)
                    mats.append(m.astype(kind))
                    state.append([get(n).values.to_numpy() for n in ("lo", "width", "want")])
                    continue
                if not ids:  # a share without queries
                    continue
                if held is None:
                    lo, width, want = (np.concatenate(x) for x in zip(*state))
                    # the k-th value and all above, or the interval only
                    hi = np.full(len(lo), bound + 1) if last else lo + width
                    held, mats = _Best(np.concatenate(ids), np.concatenate(mats), lo, hi, want, k, kind, bound), []
                held.see(i_, m)
        return held and (held, lo, width, want)

    def histogram(batches):
        """Counts of the bins from the top that may hold the k-th value."""
        if (seen := best(batches, False)) is None:
            return
        held, lo, width, want = seen
        row, score, _ = held.found()  # from the top, query by query
        step = np.maximum(1, -(-width // BINS))
        counted = np.arange(len(row)) - np.searchsorted(row, row) < want[row]
        row, score = row[counted], score[counted]
        bins = (score - lo[row]) // step[row]  # falling within a query
        first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(bins, prepend=-1))
        yield pa.RecordBatch.from_pydict({"query_id": held.ids[row[first]], "bin": bins[first], "n": np.diff(first, append=len(row))})

    def above(batches):
        """Scores over the k-th value, and the k smallest ids among those equal to it."""
        if (seen := best(batches, True)) is None:
            return
        row, score, cid = seen[0].found()
        yield pa.RecordBatch.from_pydict({"query_id": seen[0].ids[row], "id": cid, "score": score})

    state = queries.select(F.col("id").alias("query_id"), F.lit(-bound).cast("long").alias("lo"),
                           F.lit(2 * bound + 1).cast("long").alias("width"), F.lit(k).cast("long").alias("want"))
    width = 2 * bound + 1
    with small_batches(spark, 16):  # of blocks
        while width > 1:
            counts = (met(state).mapInArrow(histogram, "query_id long, bin long, n long")
                      .groupBy("query_id", "bin").agg(F.sum("n").alias("n")))
            w = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # k bins a cell at most
            step = F.expr(f"(width + {BINS - 1}) div {BINS}")
            reached = (counts.withColumn("run", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("query_id")))
                       .join(state, "query_id")
                       # the bin in which the k-th falls; with fewer than k scores, the lowest one
                       .withColumn("goal", F.least("want", "all"))
                       .filter((F.col("run") >= F.col("goal")) & (F.col("run") - F.col("n") < F.col("goal")))
                       .select("query_id", (F.col("lo") + F.col("bin") * step).alias("lo"), step.alias("width"),
                               (F.col("goal") - F.col("run") + F.col("n")).alias("want")))
            state = materialize(reached, "kth")
            width = -(-width // BINS)
        found = materialize(met(state).mapInArrow(above, "query_id long, id long, score long"), "found")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score"))
