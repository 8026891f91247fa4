"""Matching texts with dictionaries of any size.

A needle is a literal, or a pattern with a few literals of which each of its
matches must hold one (``required_forms``, of texts whose runs of whitespace are one space). Every
literal is filed under one run of bytes: the whole of it, or the longest beginning of it whose length ``filed_size`` knows. A text
that matches a needle holds that run, so the runs of a text find every
candidate, whose literal is then compared. What else a needle asks is
tested on those only. There is no nested-loop join and no size limit.

* Texts are matched block by block (``operators.blocks``): a block asks once for each needle
  that some text of it may hold, so the rows shuffled grow with the texts, not with the hits.
* A block asks only for runs that some needle is filed under, told by a bit table of
  16 to 32 bits a needle (``FILTER_BITS`` at most); beyond that it lets more runs
  through, which costs room, never a match.
* Needles without a literal (``\\d+``) are candidates of every text, as in any form.

Bytes of UTF-8 are compared, which finds the same literals as characters do.
"""

from __future__ import annotations

import re
from re import _constants as RC
from re import _parser as RP

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.operators.blocks import in_blocks
from sift.session import stored

GRAM = 4
FILTER_BITS = 1 << 28
MAX_FORMS = 16  # literals that a pattern may be filed under
STEP_BYTES = 1 << 17  # what numpy works on at a time stays in a core's cache
EVERY_TEXT = 0  # the run of needles without a literal
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_PROBES = np.array([1, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)
PLAIN_BITS = 1 << 24  # tables up to here lie in workers with a byte a bit
_BYTES = np.random.default_rng(7).integers(0, 2**63, 256, np.int64).view(np.uint64)


def required_literal(pattern: str) -> str:
    """The longest literal that every match of a regex holds ("": none known)."""
    try:
        tree = RP.parse(pattern)
    except re.error:
        return ""
    if tree.state.flags & re.IGNORECASE:
        return ""
    runs, now = [], []

    def cut():
        runs.append("".join(now))
        now.clear()

    def walk(items):
        for op, arg in items:
            if op is RC.LITERAL:
                now.append(chr(arg))
            elif op is RC.SUBPATTERN:
                _, add, _, inner = arg
                if add & re.IGNORECASE:
                    cut()
                else:
                    walk(inner)
            elif op is RC.ATOMIC_GROUP:
                walk(arg)
            elif op in (RC.MAX_REPEAT, RC.MIN_REPEAT, RC.POSSESSIVE_REPEAT):
                cut()
                if arg[0] > 0:  # at least once: its literals are held, too
                    walk(arg[2])
                    cut()
            elif op not in (RC.AT, RC.ASSERT, RC.ASSERT_NOT):  # these have no width
                cut()

    walk(tree)
    cut()
    return max(runs, key=lambda r: len(r.encode("utf-8", "surrogatepass")))


def _joined(a: str, b: str) -> str:
    """Two pieces of a text in which every run of whitespace is one space."""
    return a + b[1:] if a.endswith(" ") and b.startswith(" ") else a + b


def _space(c: str) -> str:
    return " " if c.isspace() else c


def required_forms(pattern: str) -> list[str]:
    """Literals of which every match of a regex holds at least one, once each run of whitespace
    is one space: ``MAX_FORMS`` at most, the longest known ([""]: none known)."""
    try:
        tree = RP.parse(pattern)
    except re.error:
        return [""]
    if tree.state.flags & re.IGNORECASE:
        return [""]

    def least(forms) -> int:
        return min(len(f.encode("utf-8", "surrogatepass")) for f in forms)

    def members(items) -> set[str] | None:
        """The characters of a class, if it names few."""
        out = set()
        for op, arg in items:
            if op is RC.LITERAL and chr(arg) not in "[]&^-\\":
                out.add(_space(chr(arg)))
            elif op is RC.CATEGORY and arg is RC.CATEGORY_SPACE:
                out.add(" ")
            else:
                return None
        return out if 0 < len(out) <= MAX_FORMS else None

    def exact(items) -> set[str] | None:
        """All that a sequence matches, if that is few literals."""
        now = {""}
        for item in items:
            e = element(item)
            if e is None or len(now) * len(e) > MAX_FORMS:
                return None
            now = {_joined(a, b) for a in now for b in e}
        return now

    def element(item) -> set[str] | None:
        op, arg = item
        if op is RC.LITERAL:
            return {_space(chr(arg))}
        if op is RC.IN:
            return members(arg)
        if op is RC.SUBPATTERN:
            return None if arg[1] & re.IGNORECASE else exact(arg[3])
        if op is RC.ATOMIC_GROUP:
            return exact(arg)
        if op is RC.BRANCH:
            parts = [exact(b) for b in arg[1]]
            return set().union(*parts) if all(p is not None for p in parts) and sum(map(len, parts)) <= MAX_FORMS else None
        if op in (RC.AT, RC.ASSERT, RC.ASSERT_NOT):  # these have no width
            return {""}
        if op in (RC.MAX_REPEAT, RC.MIN_REPEAT, RC.POSSESSIVE_REPEAT):
            inner = exact(arg[2])
            if inner == {" "} and arg[0] > 0:  # whitespace only: one space
                return inner
            if inner is not None and arg[:2] == (0, 1) and len(inner) < MAX_FORMS:
                return inner | {""}
        return None

    runs, now = [], {""}

    def cut():
        nonlocal now
        runs.append(now)
        now = {""}

    def walk(items):
        nonlocal now
        for item in items:
            op, arg = item
            e = element(item)
            if e is not None:
                if len(now) * len(e) > MAX_FORMS:
                    cut()
                now = {_joined(a, b) for a in now for b in e}
            elif op is RC.SUBPATTERN and not arg[1] & re.IGNORECASE:
                walk(arg[3])
            elif op is RC.ATOMIC_GROUP:
                walk(arg)
            else:
                cut()
                if op in (RC.MAX_REPEAT, RC.MIN_REPEAT, RC.POSSESSIVE_REPEAT) and arg[0] > 0:  # at least once
                    walk(arg[2])
                    cut()

    walk(tree)
    cut()
    return sorted(max(runs, key=least))


#: Letters, digits, a few marks, groups, small classes and runs of whitespace: what Java and Python read alike.
_PLAIN = re.compile(r"(?:\w|\\s\+|[(|),;:!']|\[[\w,.;:!]+\])+")


def plain_forms(pattern: str) -> list[str] | None:
    """All that a regex matches, as literals of texts in which each run of whitespace is one space, if a
    match is nothing but one of them: few, of which none begins another, so that one at most fits a place."""
    if not _PLAIN.fullmatch(pattern):
        return None
    try:
        tree = RP.parse(pattern)
    except re.error:
        return None

    def forms(items) -> set[str]:
        now = {""}
        for op, arg in items:
            if op is RC.LITERAL:
                e = {chr(arg)}
            elif op is RC.IN:
                e = {chr(x) for _, x in arg}
            elif op is RC.SUBPATTERN:
                e = forms(arg[3])
            elif op is RC.BRANCH:
                e = set().union(*map(forms, arg[1]))
            else:  # the only repeat: a run of whitespace
                e = {" "}
            now = {a + b for a in now for b in e}
            if len(now) > MAX_FORMS:
                raise OverflowError
        return now

    try:
        found = sorted(forms(tree))
    except OverflowError:
        return None
    if not found[0] or any("  " in f for f in found) or any(b.startswith(a) for a, b in zip(found, found[1:])):
        return None
    return found


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The gram at each position: its length and bytes in one number."""
    n = max(0, len(data) - size + 1)
    g = np.full(n, size, np.int64)
    for i in range(size):
        g = (g << 8) | data[i:i + n]
    return g


def filed_size(n: int) -> int:
    """The longest known length up to ``n``: up to 16 bytes each, then 24, 32, 48, 64, 96, ..."""
    if n <= 16:
        return n
    step = 1 << (n.bit_length() - 1)
    return step + step // 2 if n >= step + step // 2 else step


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    h = (h + np.uint64(size)) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


class _Runs:
    """Numbers of all runs of a length in joined bytes, by one running sum."""

    powers = np.ones(1, np.uint64)
    inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(_Runs.powers) < n:
            up = [np.full(2 * n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
            for u in up:
                u[0] = 1
            _Runs.powers, _Runs.inverse = (np.cumprod(u) for u in up)
        self.data, self.sums = data, np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _Runs.powers[:n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        if size <= GRAM:
            return _mixed(_grams(self.data.astype(np.int64), size).view(np.uint64), size)
        n = max(0, len(self.data) - size + 1)
        h = self.sums[size:size + n] - self.sums[:n]
        h *= _Runs.inverse[:n]
        return h


class _Bits:
    """A bit table asked at several places of a number (a Bloom filter)."""

    def __init__(self, bits: int, packed: np.ndarray | None = None):
        self.bits = bits
        self.packed = np.zeros(bits // 8, np.uint8) if packed is None else packed
        self.plain = None

    def places(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h * _PROBES[probe] if probe else h) >> np.uint64(65 - self.bits.bit_length())).view(np.int64)

    def add(self, h: np.ndarray):
        table = np.zeros(self.bits, bool)
        for probe in range(len(_PROBES)):
            table[self.places(h, probe)] = True
        self.packed = np.packbits(table, bitorder="little")
        return self

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        if self.plain is None and self.bits <= PLAIN_BITS:
            self.plain = np.unpackbits(self.packed, bitorder="little").view(bool)
        found = None
        for probe in range(len(_PROBES)):
            at = self.places(h if found is None else h[found], probe)
            hit = self.plain.take(at) if self.plain is not None else (self.packed.take(at >> 3) >> (at & 7).astype(np.uint8) & 1).view(bool)
            found = np.flatnonzero(hit) if found is None else found[hit]
        return found


def _steps(texts: pa.Array, most: int):
    """(first row, joined bytes, offsets) of texts, about ``most`` bytes at a time; a null is empty."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, data[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo]
        lo = hi


def _found(data: np.ndarray, ends: np.ndarray, sizes: list[int], table: _Bits):
    """(size, places, numbers) of the runs that ``table`` may hold and that may lie in one text."""
    runs = _Runs(data)
    for size in sizes:
        h = runs.of(size)
        at = table.may_hold(h)
        if len(at):
            yield size, at, h[at]


def _rows(ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each place, and whether the run ends in it, too."""
    row = np.searchsorted(ends, at, "right") - 1
    return row, at + size <= ends[row + 1]


def _file(batches):
    """(literal, p) -> the number and length of the run that it is filed under, literal, p."""
    for b in batches:
        h, size = np.full(b.num_rows, EVERY_TEXT, np.uint64), np.zeros(b.num_rows, np.int32)
        for lo, data, ends in _steps(b.column(0), STEP_BYTES):
            length, runs = np.diff(ends), _Runs(data)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                size[lo + at] = filed_size(n)
                if n:
                    h[lo + at] = runs.of(filed_size(n))[ends[at]]
        h = h.view(np.int64)
        places = [(h.view(np.uint64) * x).view(np.int64) for x in _PROBES]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * len(places)), pa.array(np.stack(places, 1).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(size), lists, b.column(0), b.column(1)],
                                         ["__h", "size", "place", "literal", "p"])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct numbers, in order: sorting them is faster than hashing them."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _wanted(table, bits: int, sizes: list[int], every: bool, most: int, clean=None):
    """Each block with the distinct runs of its texts that needles may be filed under."""
    def run(batches):
        block, found = None, []
        bit_table = _Bits(bits, table.value)

        def asked():
            h = _distinct(np.concatenate(found))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, np.int32)), pa.array(h.view(np.int64))], ["__block", "__h"])

        for b in batches:
            at = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if at[lo] != block:
                    if block is not None:
                        yield asked()
                    block, found = at[lo], [np.array([EVERY_TEXT] if every else [], np.uint64)]
                texts = b.column(1).slice(lo, hi - lo)
                for _, data, ends in _steps(clean(texts) if clean else texts, most):
                    found += [_distinct(h) for _, _, h in _found(data, ends, sizes, bit_table)]
                    if len(found) > 1000:
                        found = [_distinct(np.concatenate(found))]
        if block is not None:
            yield asked()
    return run


def _first_of_equal(p: pa.StructArray) -> np.ndarray:
    """For each of the structs, which lie in order, the place of the first that is equal."""
    if len(p) == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(len(p), bool)
    new[0] = True
    for c in p.flatten():
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.if_else(pc.or_(pc.is_null(a), pc.is_null(b)), pc.and_(pc.is_null(a), pc.is_null(b)), pc.equal(a, b))
        new[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)[np.cumsum(new) - 1]


class _Filed:
    """Needles by the number of the run that they are filed under."""

    def __init__(self, h: np.ndarray, size: np.ndarray, literals: pa.Array):
        by = np.argsort(h, kind="stable")
        self.by = by = by[size[by] > 0]
        h = h[by]
        self.h = np.append(h, ~np.uint64(0))  # no run is beyond the last
        self.sizes = np.unique(size[by]).tolist()
        self.table = _Bits(max(64, 1 << (16 * len(h)).bit_length())).add(h)
        bits = (4 * len(h)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount((h >> self.shift).view(np.int64), minlength=1 << bits))])
        first = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        self.many = np.zeros(len(h), np.int64)  # at the first of equal numbers: how many they are
        self.many[first] = np.diff(first, append=len(h))
        _, lits, starts = next(_steps(literals, 1 << 60), (0, np.empty(0, np.uint8), np.zeros(1, np.int64)))
        self.starts, self.length, self.words = starts[:-1], np.diff(starts), _words(lits)

    def held(self, data: np.ndarray, ends: np.ndarray):
        """(place, text, needle) of each literal in joined texts."""
        words = _words(data)
        for n, at, runs in _found(data, ends, self.sizes, self.table):
            first = self.begin[(runs >> self.shift).view(np.int64)]
            low = np.flatnonzero(self.h[first] < runs)
            while len(low):  # a bucket holds few numbers
                first[low] += 1
                low = low[self.h[first[low]] < runs[low]]
            hit = np.flatnonzero((self.h[first] == runs) & (first < len(self.by)))
            at, first = at[hit], first[hit]
            row, inside = _rows(ends, at, n)
            at, row, first = at[inside], row[inside], first[inside]
            many = self.many[first]
            if many.max(initial=1) > 1:
                at, row = np.repeat(at, many), np.repeat(row, many)
                first = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            which = self.by[first]
            begin, length = self.starts[which], self.length[which]
            # equal numbers are not yet equal bytes
            same = (words[at] ^ self.words[begin]) & np.uint64((1 << 8 * min(n, 8)) - 1) == 0
            for i in [*range(8, n - 8, 8), n - 8] if n > 8 else []:
                same &= words[at + i] == self.words[begin + i]
            same &= at + length <= ends[row + 1]
            longer, i = np.flatnonzero(same & (length > n)), n
            while len(longer):  # than the run that they are filed under
                to = np.minimum(i, length[longer] - 8)
                equal = words[at[longer] + to] == self.words[begin[longer] + to]
                same[longer[~equal]] = False
                i += 8
                longer = longer[equal & (length[longer] > i)]
            yield at[same], row[same], which[same]


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _look(most: int, fields: list[str]):
    """Maps texts to ``fields`` of the needles of their block that they hold, in the needles' order."""
    def look(needles: pa.StructArray):
        p, size = needles.field("p"), needles.field("size").to_numpy()
        filed = _Filed(needles.field("h").to_numpy().view(np.uint64), size, needles.field("literal"))
        one = _first_of_equal(p)  # a needle may be there with several literals
        always = np.unique(one[size == 0])
        shown = pa.StructArray.from_arrays([p.field(f) for f in fields], fields)
        width = max(1, len(p))

        def found(texts: pa.Array):
            for lo, data, ends in _steps(texts, most):
                n_rows = len(ends) - 1
                pairs = [(np.arange(n_rows)[:, None] * width + always).ravel()]
                pairs += [row * width + one[which] for _, row, which in filed.held(data, ends)]
                pair = _distinct(np.concatenate(pairs))
                at = np.searchsorted(pair, np.arange(n_rows + 1) * width)
                yield lo, [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), shown.take(pa.array(pair % width)))]
        return found
    return look


_SPACES = np.array([i for i in range(0x3001) if chr(i).isspace()], np.uint32)


_ODD_SPACE = re.compile(r"\s{2,}|[^\S ]")


def one_space(texts: pa.Array) -> pa.Array:
    """Texts with one space for each run of whitespace; bytes that are no UTF-8 stay."""
    return pa.array([None if t is None else _ODD_SPACE.sub(" ", t.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
                     for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _spaced_places(low: str, n: int) -> np.ndarray | None:
    """Where each character, and the end, of a text of ``n`` characters with one space for each run of whitespace
    lies in the text as it was; None if that is not how it was made."""
    if len(low) == n:
        return np.arange(n + 1)
    space = np.isin(np.frombuffer(low.encode("utf-32-le"), "<u4"), _SPACES)
    space[1:] &= space[:-1].copy()
    space[:1] = False
    at = np.append(np.flatnonzero(~space), len(low))
    return at if len(at) == n + 1 else None


def _first_matches(most: int, before: int, after: int, java_of):
    """Maps texts (in lower case, as they are) to the needles that they may match once each run of whitespace is one space:
    of plain ones the first match and the text around it, of others the Java form."""
    def look(needles: pa.StructArray):
        p, size = needles.field("p"), needles.field("size").to_numpy()
        filed = _Filed(needles.field("h").to_numpy().view(np.uint64), size, needles.field("literal"))
        one = _first_of_equal(p)
        always = np.unique(one[size == 0])
        patterns, java = p.field("pattern").to_pylist(), p.field("java")
        plain = java.is_null().to_numpy(zero_copy_only=False).astype(bool)
        names = pa.array([x.strip() for x in patterns], pa.string())
        width = max(1, len(p))

        def found(lows: pa.Array, texts: pa.Array):
            lows, texts = lows.cast(pa.binary()), texts.cast(pa.binary())
            for lo, data, ends in _steps(one_space(lows), most):
                n_rows = len(ends) - 1
                held = list(filed.held(data, ends))
                key = np.concatenate([(np.arange(n_rows)[:, None] * width + always).ravel(), *[row * width + one[which] for _, row, which in held]])
                none = np.zeros(n_rows * len(always), np.int64)
                at = np.concatenate([none, *[x for x, _, _ in held]])
                end = np.concatenate([none, *[x + filed.length[which] for x, _, which in held]])
                order = np.lexsort((at, key))
                order = order[np.diff(key[order], prepend=-1) != 0]
                key, at, end = key[order], at[order], end[order]
                row, which = np.divmod(key, width)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # before each byte
                at, end = chars[at] - chars[ends[row]], chars[end] - chars[ends[row]]
                known, near, hit, other = plain[which], [None] * len(key), [None] * len(key), {}
                edges = np.searchsorted(row, np.arange(n_rows + 1))
                for r in np.unique(row[known]).tolist():
                    some = edges[r] + np.flatnonzero(known[edges[r]:edges[r + 1]])
                    try:
                        low, text = (None if x[lo + r].as_py() is None else x[lo + r].as_py().decode() for x in (lows, texts))
                    except UnicodeDecodeError:
                        low = None
                    places = None if low is None else _spaced_places(low, int(chars[ends[r + 1]] - chars[ends[r]]))
                    if places is None:  # as for other patterns
                        other |= {i: java_of(patterns[which[i]]) for i in some.tolist()}
                        continue
                    for i, a, b in zip(some.tolist(), places[at[some]].tolist(), places[end[some]].tolist()):
                        hit[i] = low[a:b]
                        near[i] = None if text is None else text[max(a - before, 0):min(b + after, len(low))].strip()
                which = pa.array(which)
                forms = java.take(which)
                if other:
                    forms = pa.array([other.get(i, f) for i, f in enumerate(forms.to_pylist())], pa.string())
                items = pa.StructArray.from_arrays([names.take(which), forms, pa.array(near, pa.string()), pa.array(hit, pa.string())], ["name", "java", "near", "hit"])
                yield lo, [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), items)]
        return found
    return look


def with_first_matches(df: DataFrame, text: str, low: str, needles: DataFrame, out: str, before: int, after: int, java_of) -> DataFrame:
    """``df`` with ``out``: structs ``name, java, near, hit`` of the needles (``ord, pattern, java, literal``) of which the
    column ``low`` holds a literal once each run of whitespace is one space, by their ``ord`` and pattern.
    Of plain ones, whose ``java`` is null, ``hit`` is the first match in ``low`` and ``near`` the part of ``text`` from
    ``before`` characters ahead of it to ``after`` behind it, stripped. The others, which may not match, have ``java``;
    ``java_of`` gives it for plain ones of a text whose places are not known (``low`` is no UTF-8)."""
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "java", "near", "hit")])
    return _with_needles(df, low, needles, _first_matches(STEP_BYTES, before, after, java_of), [low, text], (out, T.ArrayType(kind)), one_space)


def with_candidates(df: DataFrame, low: str, needles: DataFrame, out: str, fields: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: structs of the columns of ``needles`` (``literal``, which is never null, left
    out) whose literal the column ``low`` holds, in the order of their fields; a needle with several
    literals (a row each) is there once if any of them is held. Of the columns, ``out`` has ``fields`` (None: all)."""
    columns = [c for c in needles.columns if c != "literal"]
    fields = columns if fields is None else fields
    kind = T.StructType([needles.select(f).schema[0] for f in fields])
    return _with_needles(df, low, needles, _look(STEP_BYTES, fields), [low], (out, T.ArrayType(kind)))


def _with_needles(df: DataFrame, low: str, needles: DataFrame, look, args: list[str], field: tuple, clean=None) -> DataFrame:
    """``df`` with ``field``, which ``look`` makes of the columns ``args``, the first of which is ``low``, and the needles
    of a block; their literals are looked for in what ``clean`` makes of ``low``."""
    payload = F.struct(*[c for c in needles.columns if c != "literal"])
    pairs = needles.select("literal", payload.alias("p")).distinct()
    filed = stored(pairs.mapInArrow(_file, pairs.select(F.lit(0).cast("long").alias("__h"), F.lit(0).alias("size"), F.array(F.lit(0).cast("long")).alias("place"), "literal", "p").schema), "sift-needles")
    bits = min(FILTER_BITS, max(64, 1 << (16 * filed.count()).bit_length()))
    places = filed.select("size", F.explode(F.array(*[F.shiftrightunsigned(F.col("place")[i], 65 - bits.bit_length()) for i in range(len(_PROBES))])).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("x"), F.collect_set("size").alias("sizes")).toPandas()  # at most FILTER_BITS / 64 rows
    packed = np.zeros(bits // 64, np.uint64)
    packed[words["i"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64).view(np.uint64)
    sizes = sorted({int(x) for xs in words["sizes"] for x in xs})
    table = df.sparkSession.sparkContext.broadcast(packed.view(np.uint8))
    run = _wanted(table, bits, [x for x in sizes if x], 0 in sizes, STEP_BYTES, clean)
    return in_blocks(df, F.octet_length(low), lambda rows: rows.sortWithinPartitions("__block").mapInArrow(run, "__block int, __h long"),
                     filed.select("__h", F.struct("p", "literal", F.col("__h").alias("h"), "size").alias("__p")), look,
                     args, [field])


def candidates(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """``key, literal`` of every text that holds a literal: ``texts`` has
    ``key`` and ``low``, ``literals`` distinct, non-null strings ``literal``."""
    found = with_candidates(texts.select("key", "low"), "low", literals.select("literal", F.col("literal").alias("l")), "found")
    return found.select("key", F.explode("found.l").alias("literal"))
