"""N-gram Jaccard join: documents whose shingle sets reach a similarity, and
the components that these links form.

1. Texts become sets of 64-bit hashes of their distinct 5-word shingles. Equal
   sets are one node (named by a hash of the set), so copies cost nothing more.
2. Two sets of similarity t share one of the first n - ceil(t * n) + 1 shingles
   of each, in any one order; the order puts shingles that very many documents
   share last. Those shingles are the keys that bring nodes together.
3. In the groups of some keys, cut into tiles by size, each node outside the group's largest component
   is paired with the node of another component whose sketch (32 bytes) agrees most; the best of these pairs
   over all keys is intersected exactly, one a node. This is done ``ROUNDS`` times at most,
   with the components found so far, so a large group of near copies is joined without all of its pairs.
4. Groups of any key that these links join to one component are done.
5. In the others, pairs of size-banded tiles are compared by bitmaps; only nodes that these allow to be similar to
   one of another component stay. Those that a key still connects form clusters, which are
   compared whole: every pair of size-banded tiles is one group of rows, in which bitmap signatures bound
   the overlap of every pair across components (a bit of one set that the other lacks is an element it
   lacks, so bit counts bound the overlap from above) and what passes is intersected exactly,
   unless a link found before has joined it. Only links leave the task, fewer than its rows.
6. Clusters of more than ``CLUSTER`` tiles are compared key by key instead: pairs of tiles
   by bitmaps, across components only, then exact intersection.

Texts are read once; sorted hashes are kept, one row a set and task.

No link between different sets is lost: each pair of similarity t or more
shares a key, and is either verified or already in one component. Components
are found by spreading smallest labels with pointer jumping over stored edges.

Shingles of at least 1 / 2**20 of all shingle occurrences are told by summed
counts of every task (at most 2**20 of them, which bounds the broadcast);
these counts set the order and the salts of hot groups only, never results.

Defined results: null or empty texts, and texts without words, have no
shingles and are linked with nothing; with fewer than five words, the whole
sequence is the one shingle. Null ids count as one id below all others and give a null
component; rows of one id are rows each, linked like others. Whole texts are
used. Extra columns are ignored; an empty table gives no rows. Sets and
shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sift.llm.common import MIN_LONG, materialize, order_key, partitions, row_hash, small_batches, word_hash
from sift.llm.links import components

WIDTH = 5
NUM, DEN = 3, 4  # similarity of at least 3 / 4
TILE = 1024
HOT_SHARE, HOT_LEAST = 1 << 20, 64
SALT_ROWS = 20_000
SUMMARY = 16_384  # most frequent shingles that a task reports
STEP_CHARS = 2_000_000
SEEN = 200_000  # sets that a task remembers to have written
SIG_BITS = 2048
SKETCH = 32
LIKELY = 18  # places in which the sketches of a pair agree that is tried early; similar sets agree in 24 on average
ROUNDS = 2
ROUND_KEYS = 4  # rounds look at one key in so many
WANTED_SLOTS = 1 << 20  # bounds the broadcast that tells whose hashes are needed
PAIR_WORDS, PAIRS = 1 << 19, 1 << 20  # words of bitmaps, and pairs, that are looked at together
TILE_BYTES = 4 << 20  # of whole sets in a tile, which has TILE rows at most
CLUSTER = 8  # tiles of whole sets that a cluster may have
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles. bytes.lower and bytes.split
    touch A-Z and the bytes 20, 09-0D only."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    x = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(width, len(h))):
        x = x * _P + h[i:i + n]
    return np.unique(_mixed(x))


def set_name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - 2**63


def bitmap(s: np.ndarray, bits: int = 0) -> bytes:
    """``bits`` (else two or more an element), set by the low bits of the elements' hashes."""
    bits = bits or 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def sketch(s: np.ndarray) -> bytes:
    """The low byte of the least hash in each of SKETCH buckets: similar sets agree in many.
    It only chooses which pairs are tried first."""
    out = np.zeros(SKETCH, np.uint8)
    bucket = (s[::-1] >> np.uint64(32)).astype(np.int64) % SKETCH  # the least comes last and stays
    out[bucket] = (s[::-1] >> np.uint64(8)).astype(np.uint8)
    return out.tobytes()


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps brought down to ``words`` 64-bit words."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] | b[..., half:]
    return b


def may_match(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Whether the bitmaps allow similarity NUM / DEN."""
    w = min(a.shape[-1], b.shape[-1])
    a, b = fold(a, w), fold(b, w)
    most = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return (NUM + DEN) * most >= NUM * (na + nb)


def matches(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact: intersection of sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _in_steps(texts):
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= STEP_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Frequent:
    """The most frequent shingles of a task, in bounded memory."""

    def __init__(self):
        self.buffer, self.held = [], 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, s):
        self.buffer.append(s)
        self.held += len(s)
        if self.held > 1_000_000:
            self.fold()

    def fold(self):
        new, n = np.unique(np.concatenate(self.buffer), return_counts=True) if self.buffer else (self.keys[:0], self.counts[:0])
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        keep = np.nonzero(counts > 1)[0]
        if len(keep) > 4 * SUMMARY:
            keep = keep[np.argpartition(-counts[keep], 4 * SUMMARY)[:4 * SUMMARY]]
            keep.sort()
        self.keys, self.counts, self.buffer, self.held = keys[keep], counts[keep], [], 0

    def top(self):
        self.fold()
        at = np.argsort(-self.counts)[:SUMMARY]
        return self.keys[at].view(np.int64), self.counts[at]


def _slices(batches, rows: int = 256):
    """Few rows at a time, so that only their texts or sets become Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


SURVEY = "k long, h long, n int, node long, at long, mini binary, hashes binary, shingle long, count long"


def _survey(batches):
    """The only pass over texts: (k, h, n, node) of each, with a number of its own, a sketch and the
    sorted hashes for sets that are new to the task; at a task's end (shingle, count) of frequent ones."""
    often, seen = _Frequent(), set()
    at = TaskContext.get().partitionId() << 33  # stored with the rows, so it stays as it is
    names = [f.split()[0] for f in SURVEY.split(", ")]
    for b in _slices(batches):
        ks, hs, texts = b.column(0), b.column(1), b.column(2).to_pylist()
        for lo, hi in _in_steps(texts):
            n, node, own, mini, hashes = [], [], [], [], []
            for t in texts[lo:hi]:
                s = shingles(t)
                often.add(s)
                n.append(len(s))
                name = set_name(s) if len(s) else None
                new = name is not None and name not in seen
                if new:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(name)
                node.append(name)
                at += 1
                own.append(at if new else None)
                mini.append(sketch(s) if new else None)
                hashes.append(s.tobytes() if new else None)
            size = hi - lo
            yield pa.RecordBatch.from_arrays(
                [ks.slice(lo, size), hs.slice(lo, size), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(own, pa.int64()),
                 pa.array(mini, pa.binary()), pa.array(hashes, pa.binary()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())], names)
    word_hash.clear()  # the worker goes on to other tasks
    seen.clear()
    keys, counts = often.top()
    size = len(keys)
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 2]
    yield pa.RecordBatch.from_arrays([*(pa.nulls(size, t) for t in kinds), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names)


def _keys(hot):
    """(key, salt, node, size) of each set's first shingles; salt is 0 for keys that are
    not spread, else 1 or more."""
    def run(batches):
        hot_keys, hot_counts = hot.value
        for b in batches:
            out = []
            for node, held in zip(b.column(0).to_pylist(), b.column(1)):
                s = np.frombuffer(held.as_py(), np.uint64)
                n = len(s)
                p = n - -(-NUM * n // DEN) + 1
                first, count = s[:p], None
                if len(hot_keys):
                    at = np.searchsorted(hot_keys, s)
                    at[at == len(hot_keys)] = 0
                    often = hot_keys[at] == s
                    if often.any():
                        count = np.where(often, hot_counts[at], 0)
                        order = np.argsort(count, kind="stable")[:p]
                        first, count = s[order], count[order]
                salts = np.zeros(p, np.int32)
                if count is not None:
                    spread = -(-count // SALT_ROWS)
                    salts = np.where(spread > 1, 1 + np.abs(node) % np.maximum(spread, 1), 0).astype(np.int32)
                out.append((first, salts, node, n))
                if len(out) == 2000:
                    yield _key_rows(out)
                    out = []
            if out:
                yield _key_rows(out)
    return run


def _key_rows(out):
    sizes = [len(x[0]) for x in out]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), pa.array(np.concatenate([x[1] for x in out])),
         pa.array(np.repeat(np.array([x[2] for x in out], np.int64), sizes)),
         pa.array(np.repeat(np.array([x[3] for x in out], np.int32), sizes))], ["key", "salt", "node", "size"])


MEMBERS = "key long, salt int, tile int, node long, size int"


def _members(batches):
    """Rows sorted by key, salt, size, node -> each node of a group of two or
    more. Of spread keys, whose other salts may hold nodes, all are given."""
    last, waiting = None, None  # the row before (key, salt, node, rank); a group's first node, until it has a second
    names = [f.split()[0] for f in MEMBERS.split(", ")]
    for b in batches:
        key, salt, node, size = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(key):
            continue
        same = np.r_[last is not None and last[:3] == (key[0], salt[0], node[0]),
                     (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (node[1:] == node[:-1])]
        key, salt, node, size = (x[~same] for x in (key, salt, node, size))
        n = len(key)
        if not n:
            continue
        goes_on = last is not None and last[:2] == (key[0], salt[0])
        new = np.r_[not goes_on, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.arange(n) - begin
        if goes_on:
            until = int(np.argmax(new)) if new.any() else n
            rank[:until] += last[3] + 1
        last = tuple(int(x[-1]) for x in (key, salt, node, rank))
        # a first node counts if a second follows; the last row of a batch waits for the next
        second = np.r_[rank[1:] == 1, False]
        at = (rank > 0) | (salt > 0) | second
        cols = [key[at], salt[at], (rank[at] // TILE).astype(np.int32), node[at], size[at]]
        if waiting is not None and goes_on:
            cols = [np.r_[np.array([w], c.dtype), c] for w, c in zip(waiting, cols)]
        waiting = (key[-1], salt[-1], 0, node[-1], size[-1]) if rank[-1] == 0 and salt[-1] == 0 else None
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _grid(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def _bitmaps(batches):
    """(at, hashes) -> (at, bits)."""
    for b in _slices(batches):
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([bitmap(np.frombuffer(h.as_py(), np.uint64)) for h in b.column(1)], pa.binary())], ["at", "bits"])


def _exact_filter(batches):
    for b in _slices(batches):
        keep = [matches(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
                for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])


def _allowed(key, side, node, size, label, bits) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of nodes across components that the bitmaps allow, in groups of rows that stand together
    (``key`` numbers them; of two sides if both occur). A pair that several groups hold is compared once."""
    name, own = np.unique(node, return_inverse=True)
    end = np.searchsorted(key, key, "right")
    other = np.searchsorted(2 * key + side, 2 * key + 1)  # where the other side begins, if there is one
    begin = np.where(other < end, other, np.arange(1, len(key) + 1))
    count = np.where((side == 0) & (end > begin), end - begin, 0)
    until, codes = np.cumsum(count), []
    lo = 0
    while lo < len(key):
        hi = max(lo + 1, int(np.searchsorted(until, (until[lo - 1] if lo else 0) + PAIRS, "right")))
        c = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[lo:hi], c)
        ok = (label[i] != label[j]) & (DEN * size[j] >= NUM * size[i]) & (DEN * size[i] >= NUM * size[j])
        p, q = own[i[ok]], own[j[ok]]
        codes.append(np.unique(np.minimum(p, q) * len(name) + np.maximum(p, q)))
        lo = hi
    p, q = np.divmod(np.unique(np.concatenate(codes)), len(name))
    at = np.zeros(len(name), np.int64)
    at[own] = np.arange(len(node))  # a row of each node; all have the same bitmap
    n, width = size[at], np.array([len(bits[i]) // 8 for i in at.tolist()])
    place, grids = np.zeros(len(name), np.int64), {}
    for w in np.unique(width).tolist():
        some = np.nonzero(width == w)[0]
        place[some], grids[w] = np.arange(len(some)), _grid([bits[i] for i in at[some].tolist()])
    like = np.zeros(len(p), bool)
    for x in grids:
        for y in grids:
            some, words = np.nonzero((width[p] == x) & (width[q] == y))[0], min(x, y)
            if not len(some):
                continue
            left, right, step = fold(grids[x], words), fold(grids[y], words), max(1, PAIR_WORDS // words)
            for k in range(0, len(some), step):
                c = some[k:k + step]
                like[c] = may_match(left[place[p[c]]], n[p[c]], right[place[q[c]]], n[q[c]])
    return name[p[like]], name[q[like]]


def _tiles(pairs: bool):
    """Rows sorted by key, tile pair, side -> pairs across components that the bitmaps allow, or
    only the nodes of such pairs (at most a row each)."""
    def found(cols, bits):
        key, lo, hi, side, node, size, label = cols
        new = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
        whole = (lo == hi) | (np.minimum.reduceat(side, np.nonzero(new)[0])[np.cumsum(new) - 1] != np.maximum.reduceat(side, np.nonzero(new)[0])[np.cumsum(new) - 1])
        side = np.where(whole, side, 1)  # of two tiles only one is there: no pairs
        a, b = _allowed(np.cumsum(new), side, node, size, label, bits)
        cols = (a, b) if pairs else (np.unique(np.concatenate([a, b])),)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"] if pairs else ["node"])

    def run(batches):
        held = bits = None
        for b in _slices(batches, 4000):
            cols, more = [b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(7)], b.column(7).to_pylist()
            if held is not None:
                cols, more = [np.concatenate(c) for c in zip(held, cols)], bits + more
            last = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([c[:cut] for c in cols], more[:cut])
            held, bits = [c[cut:] for c in cols], more[cut:]  # two tiles at most
        if held is not None:
            yield found(held, bits)
    return run


def best_partners(label: np.ndarray, mini: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows outside a group's largest component: (row, partner, agreement) of the row of
    another component whose sketch agrees most, if it agrees much."""
    _, inverse, n = np.unique(label, return_inverse=True, return_counts=True)
    rows = np.nonzero(inverse != n.argmax())[0]
    partner, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    step = max(1, 4_000_000 // mini.size)
    for lo in range(0, len(rows), step):
        some = rows[lo:lo + step]
        agree = (mini[some][:, None, :] == mini[None, :, :]).sum(-1, dtype=np.int64)
        agree[label[some][:, None] == label[None, :]] = -1
        partner[lo:lo + step] = at = agree.argmax(1)
        best[lo:lo + step] = agree[np.arange(len(some)), at]
    likely = best >= LIKELY
    return rows[likely], partner[likely], best[likely]


def _partners(batches):
    """Rows sorted by key, salt and tile -> (node, other, agree), one at most for a row."""
    held = None

    def found(cols):
        key, salt, tile, node, label, mini = cols
        new = np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (tile[1:] != tile[:-1])])[0]
        out = []
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
            if hi - lo > 1 and (label[lo:hi] != label[lo]).any():
                row, other, agree = best_partners(label[lo:hi], mini[lo:hi])
                out.append((node[lo + row], node[lo + other], agree))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [key[:0]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["node", "other", "agree"])

    for b in batches:
        for lo in range(0, b.num_rows, 20_000):
            part = b.slice(lo, 20_000)
            cols = [part.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            cols.append(np.frombuffer(b"".join(part.column(5).to_pylist()), np.uint8).reshape(part.num_rows, SKETCH))
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            last = np.nonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield found([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]  # TILE rows at most
    if held is not None and len(held[0]):
        yield found(held)


def joined_links(node, label, size, sig, hashes, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Verified links between rows ``left`` and ``right`` (positions; equal: within), those
    with the greatest bounds first, of which none joins what labels or earlier links have joined."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    a, b = [], []
    sets: dict[int, np.ndarray] = {}
    get = lambda i: sets.setdefault(i, np.frombuffer(hashes[i], np.uint64))
    step = max(1, 4_000_000 // max(1, len(right) * sig.shape[1]))
    for lo in range(0, len(left), step):
        some = left[lo:lo + step]
        x, y = sig[some][:, None, :], sig[right][None, :, :]
        na, nb = size[some][:, None], size[right][None, :]
        both = np.minimum(na - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))
        ok = ((NUM + DEN) * both >= NUM * (na + nb)) & (label[some][:, None] != label[right][None, :])
        if left is right:
            ok &= some[:, None] < right[None, :]
        i, j = np.nonzero(ok)
        order = np.argsort(-(both[i, j] / (na + nb - both)[i, j]), kind="stable")
        for p, q in zip(some[i[order]].tolist(), right[j[order]].tolist()):
            u, v = find(int(label[p])), find(int(label[q]))
            if u != v and matches(get(p), get(q)):
                root[max(u, v)] = min(u, v)
                a.append(int(node[p]))
                b.append(int(node[q]))
    return a, b


def _clusters(batches):
    """Rows sorted by cluster, tile pair and side -> verified links (a, b), fewer than there are rows."""
    def compare(rows):
        side = np.array([r[3] for r in rows])
        node, size, label = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6))
        sig = np.frombuffer(b"".join(bitmap(np.frombuffer(r[7], np.uint64), SIG_BITS) for r in rows), np.uint64).reshape(len(rows), -1)
        left = np.nonzero(side == 0)[0]
        right = left if rows[0][1] == rows[0][2] else np.nonzero(side == 1)[0]
        if not len(left) or not len(right) or DEN * size[left].max() < NUM * size[right].min():
            return [], []
        return joined_links(node, label, size, sig, [r[7] for r in rows], left, right)

    rows, key, a, b = [], None, [], []
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            for row in zip(*(c.slice(lo, 500).to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if len(rows) > 1:
                        x, y = compare(rows)
                        a, b = a + x, b + y
                    rows, key = [], row[:3]
                rows.append(row)  # two tiles at most
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = [], []
    if len(rows) > 1:
        a, b = compare(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def text_hash(text_col: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


class _Join:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        self.p = partitions(self.spark)
        self.texts = docs.select(order_key(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
        survey = materialize(self.texts.select("k", text_hash("text").alias("h"), "text").mapInArrow(_survey, SURVEY), "survey", compression="uncompressed")  # hashes do not compress
        self.rows = survey.filter(F.col("k").isNotNull()).select("k", "h", "n", "node")
        # every node has a row with its hashes in some task, or in several: one of them carries it
        self.carriers = survey.filter(F.col("hashes").isNotNull()).select("node", "at", "mini", "hashes")
        self.nodes = materialize(survey.filter(F.col("node").isNotNull()).groupBy("node").agg(
            F.min("at").alias("at"), F.min("k").alias("k"), F.min("n").alias("n")), "nodes")
        total = self.rows.agg(F.sum("n")).first()[0] or 0
        least = max(HOT_LEAST, math.ceil(total / HOT_SHARE))
        hot = (survey.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("count").alias("count"))
               .filter(F.col("count") >= least).toPandas())  # at most 2**20 rows
        keys = hot["shingle"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.hot = self.spark.sparkContext.broadcast((keys[order], hot["count"].to_numpy(np.int64)[order]))

    def members(self) -> DataFrame:
        keys = self.carriers.select("node", "hashes").mapInArrow(_keys(self.hot), "key long, salt int, node long, size int")
        return materialize(keys.repartition(self.p, "key", "salt").sortWithinPartitions("key", "salt", "size", "node")
                           .mapInArrow(_members, MEMBERS), "members")

    def carried(self, at: DataFrame, *cols: str) -> DataFrame:
        """``at`` and columns of the carriers that may be among ``at``; rows that
        cannot be are dropped before any shuffle, by a table of hashed numbers of bounded size."""
        slot = lambda: F.pmod(F.xxhash64("at"), F.lit(WANTED_SLOTS)).alias("slot")
        slots = materialize(at.select(slot()).distinct(), "wanted")
        return (self.carriers.select("at", *cols, slot()).join(F.broadcast(slots), "slot", "left_semi").drop("slot"))

    def sides(self, pairs: DataFrame, *cols: str) -> DataFrame:
        """Pairs (a, b) with ``cols`` of both (``a_<col>``, ``b_<col>``)."""
        at = lambda c: self.nodes.select(F.col("node").alias(c), F.col("at").alias(f"{c}_at"))
        named = materialize(pairs.join(at("a"), "a").join(at("b"), "b"), "pairs-at")
        held = self.carried(named.select(F.col("a_at").alias("at")).union(named.select("b_at")), *cols)
        side = lambda c: held.select(F.col("at").alias(f"{c}_at"), *[F.col(x).alias(f"{c}_{x}") for x in cols])
        return named.join(side("b"), "b_at").join(side("a"), "a_at")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of similar sets."""
        return materialize(self.sides(pairs, "hashes").select("a", "b", "a_hashes", "b_hashes").mapInArrow(_exact_filter, "a long, b long"), "links")

    def labels(self, links: DataFrame) -> DataFrame:
        """``node, label`` of every linked node: the smallest node it reaches. Edges shrink as components grow
        (``links.components``), so rounds do not meet all of them again."""
        return components(links)

    def named(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        return materialize(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")

    def partners(self, members: DataFrame, labels: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(members of keys with several components, pairs not decided yet): a pair at most for each node
        outside the largest component of one of its groups, so as many as there are nodes."""
        named = self.named(members, labels)
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        rows = materialize(named.join(mixed, "key", "left_semi"), "mixed-members")
        found = (rows.select("key", "salt", "tile", "node", "label", "mini").repartition(self.p, "key", "salt", "tile")
                 .sortWithinPartitions("key", "salt", "tile").mapInArrow(_partners, "node long, other long, agree long"))
        best = found.groupBy("node").agg(F.max_by("other", "agree").alias("other"))
        pairs = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        return rows.drop("label"), materialize(pairs.join(done, ["a", "b"], "left_anti"), "partners")

    def clusters(self, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links, members left). Nodes that keys with several components connect form a cluster; each
        pair of its tiles is decided in one task, on whole sets, so that pairs never leave it and a node is
        sent once per tile, not per key. Members of clusters of more than ``CLUSTER`` tiles are left."""
        named = self.named(members, labels)
        mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("hub")).filter("lo <> hi")
        rows = materialize(named.join(mixed.select("key", "hub"), "key"), "mixed-members")
        edges = rows.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        share = F.greatest(F.col("n") * 8 / TILE_BYTES, F.lit(1 / TILE))  # of a tile
        cluster = (self.labels(edges).withColumnRenamed("label", "cluster").join(self.nodes.select("node", "n", "at"), "node")
                   .withColumn("share", share))
        sizes = cluster.groupBy("cluster").agg(F.sum("share").alias("m"))
        cluster = materialize(cluster.join(sizes, "cluster").withColumnRenamed("n", "size"), "clusters")
        some = cluster.filter(F.col("m") <= CLUSTER).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        before = Window.partitionBy("cluster").orderBy("size", "node").rowsBetween(Window.unboundedPreceding, -1)  # CLUSTER tiles at most
        some = some.withColumn("t", F.floor(F.coalesce(F.sum("share").over(before), F.lit(0.0))).cast("int"))
        some = some.withColumn("tiles", F.max("t").over(Window.partitionBy("cluster")) + 1)
        pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(
            F.least(F.col("t"), o).alias("lo"), F.greatest(F.col("t"), o).alias("hi"), (F.col("t") > o).cast("int").alias("side")))
        some = materialize(some, "cluster-rows")
        some = some.join(self.carried(some.select("at"), "hashes"), "at")
        found = (some.select("cluster", F.explode(pair).alias("p"), "node", "size", "label", "hashes")
                 .select("cluster", "p.lo", "p.hi", "p.side", "node", "size", "label", "hashes")
                 .repartition(self.p, "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "side", "size", "node")
                 .mapInArrow(_clusters, "a long, b long"))
        large = cluster.filter(F.col("m") > CLUSTER).select("node")
        return materialize(found, "cluster-links"), materialize(rows.drop("label", "hub").join(large, "node", "left_semi"), "large-members")

    def tile_rows(self, members: DataFrame, labels: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pairs of keys with two nodes, rows of tile pairs of larger keys with bitmaps), of keys with several components."""
        named = self.named(members, labels)
        # a group with one component is done
        who = F.struct("node", "size")
        mixed = materialize(named.groupBy("key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), F.max("salt").alias("salts"),
            F.max("tile").alias("tiles"), F.min(who).alias("a"), F.max(who).alias("b")).filter("lo <> hi"), "mixed")
        # two nodes are a pair, which many keys may repeat
        two = (mixed.filter("n = 2").filter(DEN * F.least("a.size", "b.size") >= NUM * F.greatest("a.size", "b.size"))
               .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        rows = named.join(mixed.filter("n > 2").select("key", "salts", "tiles"), "key")
        # tiles of all salts (0, or 1 and more) of a key, numbered together
        rows = rows.withColumn("t", F.greatest(F.col("salt") - 1, F.lit(0)) * (F.col("tiles") + 1) + F.col("tile")).withColumn(
            "all", F.greatest("salts", F.lit(1)) * (F.col("tiles") + 1))
        pair = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda o: F.struct(
            F.least(F.col("t"), o).alias("lo"), F.greatest(F.col("t"), o).alias("hi"), (F.col("t") > o).cast("int").alias("side")))
        rows = (rows.select("key", "node", "size", "label", F.explode(pair).alias("at"))
                .select("key", "at.lo", "at.hi", "at.side", "node", "size", "label").join(self.nodes.select("node", "at"), "node"))
        rows = materialize(rows, "tile-rows")
        rows = rows.join(self.carried(rows.select("at"), "hashes").mapInArrow(_bitmaps, "at long, bits binary"), "at").select("key", "lo", "hi", "side", "node", "size", "label", "bits")
        return two, rows.repartition(self.p, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "side", "size", "node")

    def open_members(self, members: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
        """Members that the bitmaps allow to be similar to a node of another component of a common key."""
        two, rows = self.tile_rows(members, labels, done)
        nodes = rows.mapInArrow(_tiles(False), "node long").union(two.select("a")).union(two.select("b")).distinct()
        return materialize(members.join(materialize(nodes, "open"), "node", "left_semi"), "open-members")

    def rest(self, members: DataFrame, labels: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs across components of one key, by tiles, that the bitmaps allow and are not decided yet."""
        two, rows = self.tile_rows(members, labels, done)
        found = rows.mapInArrow(_tiles(True), "a long, b long").distinct().join(done, ["a", "b"], "left_anti")
        return materialize(found.union(two).distinct(), "rest")

    def run(self) -> tuple[DataFrame, DataFrame]:
        members = self.members()
        none = self.spark.createDataFrame([], "a long, b long")
        links, tried, labels = none, none, none.toDF("node", "label")
        # the same keys for all nodes, so near copies keep most of their common ones; step 5 looks at all
        some = members.filter(F.pmod("key", F.lit(ROUND_KEYS)) == 0)
        minis = self.carriers.join(self.nodes.select("at"), "at", "left_semi").select("node", "mini")
        some = some.join(minis, "node")
        for _ in range(ROUNDS):
            some, pairs = self.partners(some, labels, tried)
            more = self.verified(pairs)
            tried = tried.union(pairs)
            if not more.limit(1).count():
                break
            links = links.union(more)
            labels = self.labels(links)
        members = self.open_members(members, labels, tried)
        more, members = self.clusters(members, labels)
        if more.limit(1).count():
            links = links.union(more)
            labels = self.labels(links)
        if not members.limit(1).count():
            return links, labels
        rest = self.rest(members, labels, tried)
        if rest.limit(1).count():
            links = links.union(self.verified(rest))
            labels = self.labels(links)
        return links, labels


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, links). Membership has one row a document: ``id, n_shingles,
    node, component_id`` (the smallest id reachable by links), ``label`` (the
    component, also where ids are null or repeat; null without words) and
    ``text_hash``. Links are pairs
    ``a, b`` of nodes (different sets) that were verified; with the equal sets
    of a node they span every component."""
    with small_batches(docs.sparkSession):
        j = _Join(docs, id_col, text_col)
        links, labels = j.run()
    named = j.nodes.select("node", "k").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("k").alias("component"))
    of_node = named.join(lowest, "label").select("node", "label", "component")
    # a node that very many rows share is split by adaptive execution
    out = j.rows.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "k"))
    real = lambda c: F.when(F.col(c) != MIN_LONG, F.col(c))
    return out.select(real("k").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "node",
                      real("component").alias("component_id"), "label", F.col("h").alias("text_hash")), links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id (nulls first), of equal ids the
    smallest hash of the text, of rows equal in both any one of the least row hash; texts without words all stay."""
    rows, _ = jaccard_join(docs.select(id_col, text_col), id_col, text_col)
    rows = rows.select(order_key(id_col).alias("k"), F.col("text_hash").alias("h"), "n_shingles", "label")
    worded = rows.filter("n_shingles > 0")
    low = worded.groupBy("label").agg(F.min("k").alias("k"))
    least = worded.join(low, ["label", "k"]).groupBy("label", "k").agg(F.min("h").alias("h"))
    least = materialize(least.select("k", "h", F.lit(True).alias("worded")), "least")
    keep = least.union(rows.filter("n_shingles = 0").select("k", "h", F.lit(False)).distinct()).toDF("__k", "__h", "__worded")
    cols = docs.columns
    marked = docs.select(F.struct(*cols).alias("__row"), order_key(id_col).alias("__k"), text_hash(text_col).alias("__h"), row_hash(docs).alias("__all"))
    kept = marked.join(keep, marked["__k"].eqNullSafe(keep["__k"]) & marked["__h"].eqNullSafe(keep["__h"])).select("__row", marked["__k"], marked["__h"], "__all", "__worded")
    kept = materialize(kept, "kept")
    several = kept.filter("__worded").groupBy("__k", "__h").agg(F.count("*").alias("n"), F.min("__all").alias("__all"))
    if not several.filter("n > 1").limit(1).count():
        return kept.select("__row.*")
    # rows of one id and text: the least row hash, once (null text has no words, so keys are not null)
    one = kept.filter("__worded").join(several.select("__k", "__h", "__all"), ["__k", "__h", "__all"])
    first = one.withColumn("__at", F.monotonically_increasing_id())
    first = materialize(first, "kept-again")
    first = first.join(first.groupBy("__k", "__h").agg(F.min("__at").alias("__at")), ["__k", "__h", "__at"])
    return first.select("__row.*").unionByName(kept.filter("NOT __worded").select("__row.*"))
